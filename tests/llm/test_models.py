"""Language identification, pseudo-likelihood and nearest neighbours."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from foliospark.llm import scoring
from foliospark.llm.ann import balanced_partition, nearest, neighbours, train_router
from foliospark.llm.language import (FEATURES, SAMPLE, UNKNOWN, decision_values, families, frequencies, identify, is_held_out, linear_svm,
                                     train as train_language)
from foliospark.llm.scoring import (CLASSES, MEMBERS, OFFSETS, RARE, Network, Vocabulary, build_vocabulary, positions,
                                    pseudo_likelihood, score, train as train_network)

EXTRA = "doc_id long, text string, lang string, score int, ids string, held boolean, x string"


def awkward(spark, texts):
    return spark.createDataFrame([(k, t, n, 1, "i", True, "x") for k, t, n in texts], EXTRA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")


def test_held_out_accuracy(documents):
    model = train_language(documents)
    assert sorted(map(sorted, model.groups)) == [["de", "en"], ["es", "fr"]]
    rows = documents.select("doc_id", "lang").join(identify(documents, model), "doc_id").withColumn("held", is_held_out("doc_id")).collect()
    held = [r for r in rows if r["held"] and r["lang_pred"] != UNKNOWN]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_prediction_reads_text_alone(spark, documents):
    model = train_language(documents, sample=400)
    own = [(r["doc_id"], r["text"]) for r in documents.limit(40).collect()]
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(awkward(spark, [(k, t, "fr") for k, t in own]), model).collect()}
    other = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(awkward(spark, [(k, t, None) for k, t in own[::-1]]), model).collect()}
    assert plain == other


def test_language_edges(spark, documents):
    model = train_language(documents, sample=400)
    texts = [(1, None, "en"), (2, "", "en"), (3, " 12 \n!", None), (4, "the " * 200_000, "fr"), (4, "the", "fr"), (None, "la", None)]
    found = sorted((str(r["doc_id"]), r["lang_pred"]) for r in identify(awkward(spark, texts), model).collect())
    assert [p for k, p in found if k in "123"] == [UNKNOWN] * 3
    assert [p for k, p in found if k == "4"] == ["en", "en"]
    signs = [(1, "² ½ ③ Ⅷ ٣ _", None), (2, "\u0301 ++", None), (3, "1 ª", None)]
    assert [r["lang_pred"] == UNKNOWN for r in identify(awkward(spark, signs), model).orderBy("doc_id").collect()] == [True, True, False]
    none = awkward(spark, [])
    assert train_language(none) is None and identify(none, model).count() == 0
    assert {r["lang_pred"] for r in identify(awkward(spark, texts), None).collect()} == {UNKNOWN}
    one = train_language(awkward(spark, [(i, "word", "xx") for i in range(20)]))
    assert identify(awkward(spark, [(1, "other", None)]), one).first()["lang_pred"] == "xx"
    assert train_language(awkward(spark, [(i, "12", "xx") for i in range(20)])) is None


def test_training_keeps_its_size():
    assert (SAMPLE, FEATURES) == (2000, 4096)
    assert frequencies(["word"]).shape == (1, 4096)


def test_decision_values_are_linear_in_frequencies():
    texts = ["Abc def", "é", "x" * 5000, "Ω≈ç√ 1"]
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(FEATURES, 3)), rng.normal(size=3)
    assert np.allclose(decision_values(texts, w, b), frequencies(texts) @ w + b, atol=1e-4)
    assert np.allclose(decision_values(texts[1:2], w, b), decision_values(texts, w, b)[1:2])


def test_families_and_svm():
    rng = np.random.default_rng(0)
    a, b = rng.random(50), rng.random(50)
    near = lambda v: v + 0.05 * rng.random(50)
    assert families({"p": near(a), "q": near(b), "r": near(a), "s": near(b)}) == [["p", "r"], ["q", "s"]]
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + x[:, 1] > 0, 1, -1)
    w, c = linear_svm(x, y)
    assert (np.sign(x @ w + c) == y).mean() > 0.95


def test_conditionals_sum_to_one_and_gradient_is_right():
    rng = np.random.default_rng(1)
    net = Network.unpack(rng.normal(0, 0.3, Network.fresh().pack().size))
    around = rng.integers(0, CLASSES * MEMBERS, (len(OFFSETS), 3))
    every = np.arange(CLASSES * MEMBERS)
    total = np.exp(net.log_probs(np.repeat(around[:, :1], len(every), axis=1), every).astype(np.float64)).sum()
    assert abs(total - 1) < 1e-3
    target = rng.integers(0, CLASSES * MEMBERS, 3)
    grads = [np.zeros_like(p) for p in net.parts()]
    net.log_probs(around, target, grads)
    for part, grad in zip(net.parts(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        step = np.float32(1e-2)
        part[at] += step
        high = net.log_probs(around, target).astype(np.float64).mean()
        part[at] -= 2 * step
        low = net.log_probs(around, target).astype(np.float64).mean()
        part[at] += step
        assert abs(grad[at] + (high - low) / 0.02) < 0.02 * abs(grad[at]) + 1e-3


def test_scoring_divides_only_what_it_reads():
    """Without gradients the same numbers come out, bit by bit; texts reach the words as bytes."""
    rng = np.random.default_rng(5)
    network = Network.fresh()
    network.outer += rng.normal(0, 9, network.outer.shape).astype(np.float32)
    network.inner += rng.normal(0, 9, network.inner.shape).astype(np.float32)
    around, target = (rng.integers(0, CLASSES * MEMBERS, size).astype(np.int32) for size in ((len(OFFSETS), 500), 500))
    with_grads = network.log_probs(around, target, [np.zeros_like(p) for p in network.parts()])
    assert (network.log_probs(around, target) == with_grads).all()
    scores = rng.normal(0, 20, (32, 50)).astype(np.float32)
    row, column = rng.integers(0, 32, 50), np.arange(50)
    assert (scoring._chosen(scores.copy(), row, column) == scoring._softmax(scores.copy())[row, column]).all()
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["\u00e9 \U0001f600", None]})
    assert list(scoring.slices(batch)) == [(0, ["\u00e9 \U0001f600".encode(), b""])]


def test_positions_keep_texts_apart():
    vocabulary = Vocabulary([b"a", b"b", b"c"])
    around, target, sizes = positions([b"a b c", b"", b"c"], vocabulary)
    assert sizes.tolist() == [3, 0, 1] and target.tolist() == [1, 2, 3, 3]
    assert around.T.tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 0, 0]]
    assert positions([], vocabulary)[1].size == 0


def test_trained_network_prefers_real_order(spark, documents):
    train_rows, held = documents.where("doc_id % 5 <> 0"), documents.where("doc_id % 5 = 0 AND length(text) > 400").limit(60)
    vocabulary = build_vocabulary(train_rows)
    fresh, trained = Network.fresh(), train_network(train_rows, vocabulary, rounds=3)
    texts = [(r["doc_id"], r["text"]) for r in held.collect()]
    rng = random.Random(2)
    mixed = [(k, " ".join(rng.sample(t.split(), len(t.split())))) for k, t in texts]
    mean = lambda rows, net: score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, net).agg(
        F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(texts, trained) > mean(texts, fresh) + 0.5
    assert mean(texts, trained) > mean(mixed, trained)


@pytest.mark.parametrize("near", [0, 50, 1 << 16])
def test_words_without_a_token_are_told_apart(spark, near):
    rng = random.Random(3)
    rare = [f"w{i:05d}é" if i % 3 else f"long-{'x' * (i % 40)}{i}" for i in range(900)]
    texts = [(i, " ".join(["the"] * 9 + [f"f{j}" for j in range(766)] * 4 + rng.choices(rare, k=30)), None) for i in range(40)]
    docs = awkward(spark, texts)
    vocabulary = build_vocabulary(docs, near=near)
    frequent = sorted(vocabulary.table, key=vocabulary.table.get)
    assert len(frequent) == CLASSES * MEMBERS - RARE - 1
    network = Network.fresh()
    counts = Counter(w for _, t, _ in texts for w in t.encode().split())
    kind = lambda w: (min(len(w), 16), w[-1] % 16)
    totals = Counter()
    for word, n in counts.items():
        totals[kind(word)] += n * (word not in vocabulary.table)
    assert sum(totals.values()) > 0 and sorted(totals.values())[-16:] == sorted(vocabulary.totals.tolist())[-16:]
    known = texts[:5] + [(100, rare[0] + " neverseen the", None), (100, "zzzzz", None), (None, "the", None), (101, None, None)]
    ask = awkward(spark, known)
    plain = {(r["doc_id"], r["n_tokens"]): r["log_likelihood"] for r in score(ask, Vocabulary(frequent), network).collect()}
    found = score(ask, vocabulary, network).collect()
    assert len(found) == len(known)
    for r in found:
        text = next(t for k, t, _ in known if k == r["doc_id"] and len((t or "").split()) == r["n_tokens"])
        more = sum(np.log(counts.get(w, 1) / (totals[kind(w)] + 1)) for w in (text or "").encode().split() if w not in vocabulary.table)
        assert abs(r["log_likelihood"] - plain[r["doc_id"], r["n_tokens"]] - more) < 1e-6
        assert r["mean_log_prob"] is None if not r["n_tokens"] else abs(r["mean_log_prob"] * r["n_tokens"] - r["log_likelihood"]) < 1e-6


def test_scoring_edges(spark):
    texts = [(1, None, None), (2, " \n", None), (3, "one", None), (3, "one", None), (None, "a b " * 90_000, None)]
    rows = sorted(map(tuple, pseudo_likelihood(awkward(spark, texts)).collect()), key=str)
    by = {r[0]: r for r in rows}
    assert by[1][1:] == (0, 0.0, None) and by[2][1:] == (0, 0.0, None) and by[3][1] == 1 and by[None][1] == 180_000
    assert len(rows) == 5 and all(r[2] <= 0 for r in rows)
    assert pseudo_likelihood(awkward(spark, [])).count() == 0


def brute(vectors, k, every=20):
    out = {}
    for key, v in vectors:
        if key % every == 0:
            scores = sorted((-float(np.dot(v, w)), i) for i, w in vectors if i != key)
            out[key] = [(i, -s) for s, i in scores[:k]]
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(SF.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table.collect()]
    expected = brute(rows, 20)
    for options in ({}, {"sample": 1024, "block": 100}):
        found: dict = {}
        for r in nearest(table, **options).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        assert set(found) == set(expected)
        hits = 0
        for key, near in found.items():
            near.sort()
            assert [n[0] for n in near] == list(range(1, 21))
            assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(near, near[1:]))
            exact = dict(expected[key])
            hits += sum(n[1] in exact for n in near)
            assert all(abs(n[2] - exact[n[1]]) < 1e-12 for n in near if n[1] in exact)
        assert hits / (20 * len(expected)) >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (None, [5.0, 5.0]), (8, [9.0, 9.0, 9.0]), (40, [])]
    df = spark.createDataFrame([(k, v, "p", 1, "d") for k, v in rows], "vec_id long, embedding array<float>, part string, id int, d string")
    found = [tuple(r) for r in nearest(df, k=3).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id IN (3, 4)")).count() == 0


def test_partitions_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 4
    vectors = np.concatenate([c + rng.normal(size=(128, 16)) for c in centres])
    graph = neighbours(vectors, 10)
    label = balanced_partition(vectors, graph, 8)
    assert np.bincount(label).max() <= 1.1 * 128 + 1
    assert (label[graph] == label[:, None]).mean() > 0.7
    assert train_router(vectors).probes < 8
