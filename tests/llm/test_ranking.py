"""Top-k search, resampling and phrases against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliospark.llm.phrases import compacted, longest_grams, mine_phrases, pair_filter, phrase_counts
from foliospark.llm.resampling import bucket_counts, bucket_gains, draw, features, noise, resample, splitters
from foliospark.llm.topk import Lists, best, depths, exact_top_k


def plain_best(rows, k, every):
    whole = set()
    for i, vec in rows:
        if i is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            whole.add((i, tuple(min(max(math.floor(256 * x), -2 ** 63), 2 ** 63 - 1) for x in vec)))
    out = set()
    for qi, q in whole:
        if qi % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != qi and len(v) == len(q))[:k]
            out |= {(qi, rank + 1, i, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for rank, (s, i) in enumerate(scores)}
    return out


def test_lists_bound_what_is_not_read():
    rng = np.random.default_rng(1)
    points, query = rng.integers(-9, 9, (40, 6)).astype(float), rng.integers(-9, 9, 6)
    signed = np.r_[np.maximum(query, 0), np.minimum(query, 0)]
    lists, before = Lists(points), np.inf
    for depth in depths(40):
        lists.read_to(depth)
        most, least = lists.bounds()
        upper, lower, score = most @ signed, least @ signed, points @ query
        assert (lower <= score).all() and (score <= upper).all() and upper.max() <= before
        before = upper.max()
    assert (lower == upper).all()


@pytest.mark.parametrize("scale", [1, 30, 10 ** 6, 2 ** 40])
def test_best_equals_sorting(scale):
    rng = np.random.default_rng(scale % 97)
    for n, dim in ((1, 3), (7, 1), (300, 12)):
        points, ids = rng.integers(-scale, scale + 1, (n, dim)), rng.integers(0, n, n)
        queries, query_ids = rng.integers(-scale, scale + 1, (9, dim)), rng.integers(0, n + 3, 9)
        got = sorted((int(q), -int(s), int(ids[p])) for q, p, s in zip(*best(queries, query_ids, points, ids, 4)))
        want = []
        for q in range(9):
            scores = [(q, -sum(int(a) * int(b) for a, b in zip(queries[q], points[p])), int(ids[p])) for p in range(n) if ids[p] != query_ids[q]]
            want += [(q, max(min(s, 2 ** 63), -2 ** 63 + 1), i) for q, s, i in sorted(scores)[:4]]
        assert got == sorted(want)


def test_exact_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 400)]  # ties
    rows += [(20, [0.1] * 8), (20, [0.1] * 8), (21, [1.0] * 8), (40, [0.0] * 8), (41, [1.0, 2.0]), (60, [-1.0, 2.0]), (80, []), (81, []),
             (None, [1.0] * 8), (100, None), (101, [None] * 8), (102, [float("nan")] * 8), (103, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "own", 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, own string, dim int")
    got = exact_top_k(df, every=20, vector_block=90, query_block=7)
    assert got.columns == ["query_id", "rank", "id", "score"]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == plain_best(rows, 5, 20)
    assert set(map(tuple, exact_top_k(df, every=20).collect())) == set(found)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(few).collect()] == [(0, 1, 1, 131072)]
    assert exact_top_k(df.limit(0)).count() == 0


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, grams=1):
    words = re.findall(WORDS, (text or "").translate(UPPER))
    return [" ".join(words[i:i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, share, least, grams, buckets):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in plain_features(t, grams))
    t = Counter(place(f) for x in target for f in plain_features(x, grams))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        own = plain_features(text, grams)
        weight = sum(gain(place(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(plain_features(text))])
    best_first = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(best_first[:share * len(best_first) // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("text", [None, "", "Ab cD-e9 É_ñ\tx\x85y  z", "\x00 a/b`c{d|e~\x7f", "w " * 50_000])
def test_features(text):
    data = None if text is None else text.encode()
    for grams in (1, 2, 3):
        assert [f.decode() for f in features(data, grams)] == plain_features(text, grams)


@pytest.mark.parametrize("grams", [1, 2])
def test_resample_equals_brute_force(spark, grams):
    rng = random.Random(grams)
    words = [f"w{n}" for n in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(400)]
    docs += [(500, None), (501, ""), (None, " ".join(words)), (502, "a " * 5000), (7, " ".join(words[:30])), (7, "other")]
    target = [" ".join(words[:9] * 3), None, ""]
    df = spark.createDataFrame([(i, t, 3, "e", 9) for i, t in docs], "doc_id long, text string, rank int, eligible string, segment int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(df, aim, share=30, least_words=20, grams=grams, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, target, 30, 20, grams, 500)
    assert resample(df.limit(0), aim).count() == 0
    assert {r["rank"] for r in resample(df, aim.limit(0), least_words=10 ** 6).collect()} == {None}


def test_ranks_by_regular_sampling(spark):
    rows = [(5, 3, i) for i in range(3000)] + [(i % 50, None if i % 9 == 0 else i % 40, 3000 + i) for i in range(2000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, True) for r in rows], "score long, id long, row long, eligible boolean").repartition(9)
    cuts = splitters(df, 8)
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    order = [(-a, a2, b, c) for a, a2, b, c in zip(-cuts[0], cuts[1], cuts[2], cuts[3])]
    keys = [(-r[0], int(r[1] is None), r[1] or 0, r[2]) for r in want]
    places = [keys.index(tuple(map(int, (a, b, c, d)))) for a, b, c, d in order]
    # One score and id in most rows: no segment exceeds twice an even share.
    assert max(np.diff([0, *sorted(places), len(rows)])) <= 2 * len(rows) / 8
    got = {r["row"]: r["rank"] for r in draw(df, 40, segments=8).collect()}
    assert got == {r[2]: (n + 1 if n < 2000 else None) for n, r in enumerate(want)}


def test_gains():
    source, target = np.array([3, 0, 10]), np.array([1, 2, 0])
    assert bucket_gains(source, target).tolist() == [
        math.floor(1000 * math.log((t + 1) * 16 / ((s + 1) * 6))) for s, t in ((3, 1), (0, 2), (10, 0))]
    assert noise(None) == noise("")


def test_bucket_counts(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("B",)], "text string")
    counts = bucket_counts(df, buckets=50)
    assert counts[zlib.crc32(b"a") % 50] == 2 and counts.sum() == 4


def plain_phrases(docs, least, top, share):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        longer = [n for (la, w), n in f.items() if la == lang and n >= least and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * n >= share * a for n in longer):
            continue
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, n + 1, p.decode(), -a, left, right, total[lang], -s)
            for lang, rows in found.items() for n, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def phrase_docs():
    rng = random.Random(11)
    words = ["é", "ß1", *[f"w{n}" for n in range(12)]]
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(rng.choice(["en", "fr", None]), " ".join(rng.choices(words, weights=range(14, 0, -1), k=rng.randrange(60)))) for _ in range(300)]
    docs += [("en", f"x{n} . {passage}, tail{n}") for n in range(40)] + [("en", passage + " mu")] * 8
    docs += [("und", "w0 w1,w2;w0\tw1:W0 w1!w3?w0  w1\nw2\rw0\x0bw1\x0cw4")] * 9
    docs += [("fr", None), ("fr", ""), (None, " \t.,"), ("en", "a b " * 2000), ("xx", "only . one"), ("en", "nb\xa0sp \x1cz  q " * 40)]
    return docs


def test_phrases_equal_brute_force(spark):
    docs = phrase_docs()
    df = spark.createDataFrame([(*d, 1, "p", 3) for d in docs], "lang string, text string, n int, phrase string, size int").repartition(5)
    for least, top, share in ((5, 2000, 80), (30, 10, 80), (3, 50, 100)):
        got = mine_phrases(df, least, top, share)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert set(map(tuple, got.collect())) == plain_phrases(docs, least, top, share)
    assert mine_phrases(df.limit(0)).count() == 0
    assert mine_phrases(df.where("lang = 'xx'")).count() == 0


def test_paths_are_compacted(spark):
    rows = spark.createDataFrame(phrase_docs(), "lang string, text string").fillna({"lang": "und", "text": ""})
    _, inner, totals = phrase_counts(rows, 30)
    own = {r["node"] for r in inner.where("lang = 'en'").collect()}
    assert {"beta gamma delta", "eta theta iota"} <= own and not {"alpha beta gamma", "theta iota kappa"} & own
    edges = longest_grams(rows, 30).where("n >= 30 AND size(split(gram, ' ')) = 4")
    paths = {(r["lang"], r["path"], r["n"]) for r in compacted(edges, inner).collect()}
    assert ("en", "alpha beta gamma delta epsilon zeta eta theta iota kappa", 48) in paths
    assert {r["lang"]: r["n"] for r in totals.collect()}["xx"] == 2


def test_pair_filter_loses_no_frequent_pair(spark):
    rows = spark.createDataFrame([("en", "a b. " * 30 + "c d. " * 29)], "lang string, text string")
    assert np.unpackbits(pair_filter(rows, 30)).sum() == 1
    grams = {(r["gram"], r["n"]) for r in longest_grams(rows, 30).collect()}
    assert grams == {("a b", 30), ("b", 30), ("c", 29), ("d", 29)}
    with pytest.raises(ValueError, match="255"):
        pair_filter(rows, 256)
