import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.operators.sets import index_rows
from foliospark.plans import search as se
from foliospark.plans.segments import SegmentedIndex
from foliospark.plans.vectors import knn_many


@pytest.fixture(scope="module")
def corpus(spark):
    documents = spark.createDataFrame([("c", "doc", "Test RRF")], "corpus string, document_id string, title string")
    chunks = spark.createDataFrame(
        [("c", "bm25_first", "doc", 1, None, "Exercice : fractions à simplifier", None),
         ("c", "bm25_second", "doc", 2, None, "Cours : les fractions et leur définition", None),
         ("c", "vector_only", "doc", 3, None, "bruit", None)],
        "corpus string, chunk_id string, document_id string, page_number int, section_title string, content_markdown string, pedagogical_type string")
    artifacts = spark.createDataFrame(
        [("c", "artifact", "doc", "bm25_first", 1, None, "fractions simplifier", None)],
        "corpus string, artifact_id string, document_id string, chunk_id string, page_number int, caption string, searchable_text string, raw_data string")
    vec = lambda x: [float(x)] + [0.0] * 383
    vectors = spark.createDataFrame(
        [("c", "bm25_first", vec(10)), ("c", "bm25_second", vec(1)), ("c", "vector_only", vec(2))],
        "corpus string, chunk_id string, embedding array<float>")
    return documents, chunks, index_rows(chunks, artifacts, documents), vectors


def test_ranking_regression(corpus):
    documents, chunks, rows, vectors = corpus
    hits = se.hybrid_search(rows, chunks, documents, "fractions simplifier", vectors, [0.0] * 384,
                            settings=se.Settings(bm25_threshold=0.0)).orderBy(F.desc("rrf_score")).collect()
    assert [h.chunk_id for h in hits] == ["bm25_first", "bm25_second"]
    assert hits[0].bm25_rank == 1 and all(h.vec_rank is None for h in hits)


def test_vector_channel_and_no_context(corpus):
    documents, chunks, rows, vectors = corpus
    near = se.hybrid_search(rows, chunks, documents, "absentword", vectors, [2.0] + [0.0] * 383).collect()
    assert [(h.chunk_id, h.vec_rank) for h in near] == [("vector_only", 1)]
    empty = se.rag_context(se.hybrid_search(rows, chunks, documents, "absentword")).first()
    assert empty.no_context and empty.context == ""
    assert se.hybrid_search(rows, chunks, documents, '""').count() == 0


def test_bm25_formula_and_index_agree(spark):
    texts = ["alpha beta beta gamma", "alpha", "delta delta alpha beta", "omega", "psi chi", ""]
    rows = spark.createDataFrame([("x", i, i, t) for i, t in enumerate(texts)], "corpus string, row_id int, chunk_id int, t string")
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)

    def score(doc):
        total = 0.0
        for term in ("beta", "delta"):
            n, f = sum(term in d for d in docs), doc.count(term)
            idf = max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6)
            total -= idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(doc) / avg))
        return total

    want = {i: score(d) for i, d in enumerate(docs) if {"beta", "delta"} & set(d)}
    scan = {r.row_id: r.score for r in se.scan_bm25(rows, "Beta delta", ["t"]).collect()}
    index = se.build_index(rows, ["t"])
    stored = {r.row_id: r.score for r in se.bm25(index, {"q": "beta delta"}).collect()}
    assert scan == pytest.approx(want) and stored == pytest.approx(want)


def test_words_of_a_batch_are_counted_in_slices(monkeypatch):
    """A batch of many words reaches the counting in bounded runs; rows longer than a run and empty ones stay whole."""
    monkeypatch.setattr(se, "SLICE", 5)
    rows = [["a", "b", "a"], [], ["c"] * 7, ["a", "", "b"], ["d"], [], ["e", "f"]]
    batch = pa.record_batch({"row_id": pa.array(range(20, 28)), "w": pa.array([["x"], *rows])}).slice(1)
    parts = list(se._slices(batch))
    assert [p.num_rows for p in parts] == [2, 1, 3, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    found = [r for p in se._count_terms(iter([batch])) for r in p.to_pylist()]
    want = {(21 + n, w): [i for i, x in enumerate(row) if x == w] for n, row in enumerate(rows) for w in row if w}
    assert {(r["row_id"], r["term"]): r["positions"] for r in found} == want and len(found) == len(want)
    assert all(r["tf"] == len(r["positions"]) and r["dl"] == sum(x != "" for x in rows[r["row_id"] - 21]) for r in found)


def test_texts_are_cut_once_for_postings_and_once_for_lengths(spark, tmp_path):
    cut = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            cut.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("c", i, i, f"t{i}") for i in range(8)], "corpus string, row_id int, chunk_id int, t string")
    se.build_index(rows.mapInArrow(seen, rows.schema), ["t"]).write(str(tmp_path / "once"))
    assert cut.value == 16
    index = SegmentedIndex(spark, str(tmp_path / "segments"), ["t"])
    index.edit(rows.mapInArrow(seen, rows.schema))
    assert cut.value == 16 + 16


def test_ranges_of_a_sample_write_the_same_index_in_one_pass(spark, tmp_path, monkeypatch):
    """Postings go straight to their range, without a copy of all of them; rows without words or corpus stay."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("the", "the", "a", f"w{rng.randrange(400)}", "\u00e9t\u00e9", "\U0001f600x")) for _ in range(rng.randrange(40))) for _ in range(300)]
    data = [(("x", "y", None)[i % 3], i % 290, i, t or None) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(data, "corpus string, row_id int, chunk_id int, t string")
    made = se.build_index(rows, ["t"])
    told, staged = [], se.staged
    monkeypatch.setattr(se, "staged", lambda df, label: (told.append(label), staged(df, label))[1])
    monkeypatch.setattr(se, "SAMPLE", 1)
    monkeypatch.setattr("foliospark.session.TASK_ROWS", 60)
    se.build_index(rows, ["t"]).write(str(tmp_path / "ix"))
    assert told == ["sample"]
    back = se.Index.read(spark, str(tmp_path / "ix"))
    plain = lambda df, names: sorted((repr(tuple(r)) for r in df.select(*names).collect()))
    for have, want in ((back.postings, made.postings), (back.lengths, made.lengths)):
        assert plain(have, want.columns) == plain(want, want.columns)
    assert {r.corpus: (r.n_rows, r.avg_dl) for r in back.stats.collect()} == {r.corpus: (r.n_rows, r.avg_dl) for r in made.stats.collect()}
    files = [[r["term"] for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "ix").rglob("corpus=x/*.parquet") if "kind=postings" in str(f)]
    assert len(files) > 4 and all(own == sorted(own, key=str.encode) for own in files)
    ends = sorted((min(own, key=str.encode).encode(), max(own, key=str.encode).encode()) for own in files)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_both_paths_score_phrases_alike(spark, tmp_path):
    texts = [("l'exercice un", "fractions"), ("l exercice l exercice", ""), ("exercice l", None), ("l", "exercice"), ("x", "fractions l'exercice"), (None, "y"), ("z z z", "z z")]
    rows = spark.createDataFrame([("c", i, i, a, b) for i, (a, b) in enumerate(texts)], "corpus string, row_id int, chunk_id int, a string, b string")
    se.build_index(rows, ["a", "b"]).write(str(tmp_path / "ix"))
    index = se.Index.read(spark, str(tmp_path / "ix"))
    for query in ("l'exercice fractions", "l'exercice", "z'z", "z'z l", "absent", "l'absent y"):
        scan = {r.row_id: r.score for r in se.scan_bm25(rows, query, ["a", "b"]).collect()}
        assert scan == pytest.approx({r.row_id: r.score for r in se.index_bm25(index, query).collect()}), query
    assert set(se.index_bm25(index, "l'exercice").toPandas()["row_id"]) == {0, 1, 4}
    plan = se.index_bm25(index, "l'exercice", corpora=["c"])._jdf.queryExecution().toString()
    assert "In(term" in plan and "PartitionFilters: [isnotnull(corpus" in plan
    assert se.index_bm25(index, '""').count() == 0


def test_unreadable_corpus_is_reported(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, 1, "a b")], "corpus string, row_id int, chunk_id int, t string")
    se.build_index(rows, ["t"]).write(str(tmp_path / "good"))
    index, failed = se.read_corpora(spark, {"c": str(tmp_path / "good"), "d": str(tmp_path / "gone")})
    assert list(failed) == ["d"] and se.index_bm25(index, "a").count() == 1
    assert se.read_corpora(spark, {"d": str(tmp_path / "gone")})[0] is None


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 1, "a b a"), ("y", 2, 2, "b c")], "corpus string, row_id int, chunk_id int, t string")
    se.build_index(rows, ["t"]).write(str(tmp_path / "ix"))
    back = se.Index.read(spark, str(tmp_path / "ix"))
    assert sorted((r.term, r.tf) for r in back.postings.where("corpus = 'x'").collect()) == [("a", 2), ("b", 1)]


def test_edits_score_like_a_rebuild(spark, tmp_path):
    """Rows put in, changed, removed and put back by segments, before and after merging; an edit writes one segment."""
    rng = random.Random(6)
    words = [f"w{n}" for n in range(8)]
    schema = "corpus string, row_id int, chunk_id int, t string"
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(9)))
    held = {(c, i): text() for c in ("x", "y") for i in range(30)}
    frame = lambda rows: spark.createDataFrame([(c, i, i, x) for (c, i), x in rows.items()], schema)
    index = SegmentedIndex(spark, str(tmp_path / "ix"), ["t"])
    index.edit(frame(held))

    def agrees():
        for query in ("w1 w2", "w3'w4 w0"):
            want = {(r.corpus, r.row_id): r.score for r in se.scan_bm25(frame(held), query, ["t"]).collect()}
            got = {(r.corpus, r.row_id): r.score for r in se.index_bm25(index.index(), query).collect()}
            assert got == pytest.approx(want)

    old = index.log.load()
    for step in range(3):
        put = {("x", rng.randrange(35)): text() for _ in range(4)} | {("y", 40 + step): text()}
        gone = [k for k in list(held)[::9] if k not in put] + [("x", 999), ("new", 1)]
        for key in gone:
            held.pop(key, None)
        held |= put
        before = index.segments()
        index.edit(frame(put), spark.createDataFrame(gone, "corpus string, row_id int"))
        assert len(index.segments()) == len(before) + 1 and before.items() <= index.segments().items()
        agrees()
    large = max(index.segments().values())
    index.merge(small=large)  # the first segment stays, with its tombstones
    assert len(index.segments()) == 2 and index.log.load().parts["gone"]
    agrees()
    index.merge()
    assert len(index.segments()) == 1 and not index.log.load().parts["gone"]
    agrees()
    assert index.index(old).lengths.count() == 60
    index.edit(frame({}).where("false"), frame(held))
    assert se.index_bm25(index.index(), "w1").count() == 0 and index.index().stats.count() == 0


def test_artifacts_eat_slots_before_dedup(spark):
    """Twenty rows are kept before one rank per chunk is given."""
    data = [("x", f"r{i:02}", 1 if i < 19 else i, "word") for i in range(30)] + [("x", f"z{i}", 100 + i, "other") for i in range(60)]
    rows = spark.createDataFrame(data, "corpus string, row_id string, chunk_id int, t string")
    hits = se.ranked_hits(rows, "word", settings=se.Settings(top_k=50), columns=["t"]).collect()
    assert len(hits) == 2


def test_filter_scope(corpus):
    documents, chunks, rows, vectors = corpus
    only = chunks.where("chunk_id = 'bm25_second'")
    both = se.ranked_hits(rows, "bruit", vectors, [2.0] + [0.0] * 383, only).collect()
    loose = se.ranked_hits(rows, "bruit", vectors, [2.0] + [0.0] * 383, only, se.Settings(filter_scope="bm25")).collect()
    assert both == [] and [h.chunk_id for h in loose] == ["vector_only"]


def test_cosine(spark):
    v = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 2, [1.0, 1.0])], "corpus string, chunk_id int, embedding array<float>")
    got = {r.chunk_id: round(r.score, 6) for r in se.knn(v, [2.0, 0.0], metric="cosine").collect()}
    assert got == {1: 0.0, 2: round(1 - 1 / math.sqrt(2), 6)}


def test_vectors_without_distance_take_no_place(spark):
    rows = [("c", i, [0.0, 0.0]) for i in range(30)] + [("c", 100 + i, [1.0, float(i)]) for i in range(3)] + [("c", 200, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "corpus string, chunk_id int, embedding array<float>").coalesce(1)
    for partition in (None, ["corpus"]):
        got = se.knn(v, [2.0, 0.0], top=5, metric="cosine", partition=partition).collect()
        assert sorted(r.chunk_id for r in got) == [100, 101, 102]
    assert 200 not in {r.chunk_id for r in se.knn(v, [2.0, 0.0], top=40).collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_many_questions_equal_one_by_one(spark, metric):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(30)]
    rows += [(300, [0.0] * 6), (301, None), (302, [float("nan")] * 6), (303, [1.0, 2.0]), (304, [float("inf")] * 6)]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    asked = {"a": rows[3][1], "ties": [1.0] * 6, "short": [1.0, 2.0], "zero": [0.0] * 6, "long": [1.0] * 9}
    questions = spark.createDataFrame([*asked.items(), ("none", None)], "query_id string, embedding array<double>")
    for blocks in ((16_384, 2_048), (40, 2)):
        got: dict = {}
        for r in knn_many(vectors, questions, 20, metric, *blocks).collect():
            got.setdefault(r.query_id, {})[r.chunk_id] = r.score
        for name, vector in asked.items():
            want = {r.chunk_id: r.score for r in se.knn(vectors, vector, 20, metric).collect()}
            assert got.get(name, {}) == pytest.approx(want), name
        assert "none" not in got
    assert knn_many(vectors, questions.limit(0)).count() == 0
