import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import aggregates as agg, joins as j, scans
from foliospark.operators.ranges import range_counts, range_match
from foliospark.plans import curriculum as cur, toc as tc


def test_range_match_against_brute_force(spark):
    rng = random.Random(1)
    points = [(rng.randrange(3), i, rng.choice([rng.randrange(60), rng.randrange(200000)])) for i in range(150)]
    ranges = []
    for i in range(80):
        a = rng.choice([rng.randrange(60), rng.randrange(200000)])
        ranges.append((rng.randrange(3), i, a, rng.choice([None, a, a + rng.randrange(40), a + rng.randrange(100000)])))
    p = spark.createDataFrame(points, "k int, pid int, at int")
    r = spark.createDataFrame(ranges, "k int, rid int, a int, b int")
    inside = lambda pt, rg: pt[0] == rg[0] and rg[2] <= pt[2] and (rg[3] is None or pt[2] <= rg[3])

    def run(pick, order, levels):
        return range_match(p, r, ["k"], "at", "a", "b", ["rid"], order, pick, levels=levels)

    for levels in (4, 6):
        first = {x.pid: x.rid for x in run("first", [F.col("rid")], levels).collect()}
        late = {x.pid: x.rid for x in run("latest", [F.col("a"), F.col("rid")], levels).collect()}
        counts = {x.pid: x.n for x in range_counts(p, r, ["k"], "at", "a", "b", "n", levels).collect()}
        for pt in points:
            hits = [rg for rg in ranges if inside(pt, rg)]
            assert first[pt[1]] == min((h[1] for h in hits), default=None)
            assert late[pt[1]] == (max(hits, key=lambda h: (h[2], h[1]))[1] if hits else None)
            assert counts[pt[1]] == len(hits)


def test_scans_on_a_hot_key(spark):
    """One key holds most rows; every block must join up with the next."""
    rows = [("hot" if i % 5 else f"k{i}", i, i * 7 % 300) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id int, pos int")
    block = F.floor(F.col("pos") / 16)
    got = {r.id: r.n for r in scans.row_number_by(df, ["k"], [F.col("pos"), F.col("id")], block, "n").collect()}
    last = scans.running_last(df, ["k"], ["pos", "id"], block, {"v": F.when(F.col("id") % 4 == 0, F.col("id"))}).collect()
    back = scans.running_last(df, ["k"], ["pos", "id"], -block, {"v": F.when(F.col("id") % 4 == 0, F.col("id"))}, False, True).collect()
    order = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    for k in {r[0] for r in rows}:
        mine = [r for r in order if r[0] == k]
        for n, r in enumerate(mine):
            assert got[r[1]] == n + 1
        value = {x.id: x.v for x in last if x.k == k}
        ahead = {x.id: x.v for x in back if x.k == k}
        for n, r in enumerate(mine):
            assert value[r[1]] == next((x[1] for x in reversed(mine[: n + 1]) if x[1] % 4 == 0), None)
            assert ahead[r[1]] == next((x[1] for x in mine[n + 1:] if x[1] % 4 == 0), None)


def test_positions_by_any_columns(spark):
    """Hot keys, ties, nulls and strings; descending too."""
    rows = [("hot" if i % 5 else None if i % 10 else f"k{i % 7}", "tie" if i % 3 else f"s{i * 7 % 50:03}", None if i % 11 == 0 else i % 13, i)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, s string, v int, id int")
    got = {r.id: r.n for r in scans.position_by(df, ["k"], [F.desc("s"), F.col("v"), F.col("id")], "n").collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        mine.sort(key=lambda r: r[1], reverse=True)
        assert [got[r[3]] for r in mine] == list(range(1, len(mine) + 1))
    whole = {r.id: r.n for r in scans.position_by(df, [], [F.col("s"), F.desc("id")], "n").collect()}
    assert [whole[r[3]] for r in sorted(rows, key=lambda r: (r[1], -r[3]))] == list(range(1, len(rows) + 1))
    assert scans.position_by(df.limit(0), ["k"], [F.col("s")], "n").count() == 0


def test_moving_average_across_slabs(spark):
    rows = [(i, float((i * 37) % 11)) for i in range(100)]
    df = spark.createDataFrame(rows, "t int, v double")
    got = {r.t: r.m for r in scans.moving_average(df, "v", ["t"], 10, "m", slab=16).collect()}
    for t, _ in rows:
        window = [v for u, v in rows if t - 9 <= u <= t]
        assert got[t] == pytest.approx(sum(window) / len(window))


def test_rate_limit_accepted_only(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(600) * 1_000_000, i) for i in range(200)] + [("b", 5, 900)]
    df = spark.createDataFrame(rows, "key string, micros long, request_id int")
    got = {r.request_id: r.allowed for r in scans.rate_limit(df, 3, 60).collect()}
    kept = []
    for _, at, ident in sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[2])):
        kept = [x for x in kept if at - x <= 60_000_000]
        assert got[ident] == (len(kept) < 3)
        if len(kept) < 3:
            kept.append(at)
    assert got[900]


@pytest.fixture(scope="module")
def toy(spark):
    documents = spark.createDataFrame([("doc", "Manuel", 100, "unknown")], "document_id string, title string, total_pages int, doc_type string")
    toc = spark.createDataFrame(
        [("tocA", "doc", None, 1, "Leçon A", 10, 20, 1), ("tocB", "doc", None, 1, "Leçon B", 21, 30, 3), ("secA", "doc", "tocA", 2, "Section A.1", 11, 12, 2)],
        "toc_id string, document_id string, parent_id string, level int, title string, page_start int, page_end int, ord long")
    return documents, toc, chunk_table(spark, BASE)


BASE = [("cA", 11, "course_theory"), ("cB", 22, "course_theory"), ("eA1", 12, "exercise_unsolved"), ("eA2", 15, "exercise_unsolved"),
        ("eB1", 25, "exercise_solved"), ("sA1", 13, "solution_only"), ("sB1", 26, "solution_only")]
CHUNK = "chunk_id string, document_id string, page_number int, chunk_index int, section_title string, pedagogical_type string, linked_solution_chunk_id string"


def chunk_table(spark, rows):
    return spark.createDataFrame([(r[0], "doc", r[1], 0, r[3] if len(r) > 3 else None, r[2], r[4] if len(r) > 4 else None) for r in rows], CHUNK)


def totals(built, chunks):
    row = cur.curriculum_counts(built, chunks).first()
    return (row.lessons, row.exercises, row.solutions, row.assessments)


def test_curriculum_build(spark, toy):
    documents, toc, chunks = toy
    built = cur.build_curriculum(toc, chunks, documents)
    assert totals(built, chunks) == (2, 3, 2, 0)
    kinds = {r.link_type: r["count"] for r in built["links"].groupBy("link_type").count().collect()}
    assert kinds == {"program_term": 2, "course_program": 2, "course_exercise": 3}
    assert built["links"].where("from_id = 'cA' and to_id = 'eA1'").count() == 1
    again = cur.build_curriculum(toc, chunks, documents, built)
    for name in cur.TABLES:
        assert sorted(map(str, again[name].collect())) == sorted(map(str, built[name].collect()))


def test_curriculum_variants(spark, toy):
    documents, toc, _ = toy
    no_course = chunk_table(spark, [r for r in BASE if r[2] != "course_theory"])
    assert cur.build_curriculum(toc, no_course, documents)["links"].where("link_type = 'course_exercise'").count() == 0
    far = chunk_table(spark, [*BASE, ("eX", 999, "exercise_unsolved")])
    assert totals(cur.build_curriculum(toc, far, documents), far)[1] == 3
    exam = chunk_table(spark, [*BASE, ("exam1", 28, "evaluation_exam", "Devoir 1", "corr1")])
    row = cur.build_curriculum(toc, exam, documents)["assessments"].first()
    assert (row.title, row.kind, row.subject_chunk_id, row.correction_chunk_id) == ("Devoir 1", "autre", "exam1", "corr1")
    typed = documents.withColumn("doc_type", F.lit("Sujet"))
    assert cur.build_curriculum(toc, chunk_table(spark, BASE), typed)["assessments"].first().subject_chunk_id is None
    human = {"programs": spark.createDataFrame([("doc", "h1", "t", 1, "Humain", "manual", None)],
             "document_id string, program_id string, term_id string, seq_index int, title string, source string, competencies_json string")}
    assert cur.build_curriculum(toc, chunk_table(spark, BASE), documents, human)["programs"].count() == 3
    empty = cur.build_curriculum(toc.where("false"), chunk_table(spark, BASE).where("false"), documents)
    assert all(df.count() == 0 for df in empty.values())


def test_toc_fold_with_many_headings(spark):
    """A repeated heading gives way to the next one of its chunk, and a new
    level-one title resets level two."""
    text = ["## A\n### s", "## A\n### s", "## A\n### s", "## B\n", "### s", "plain"]
    df = spark.createDataFrame([("d", i + 1, 0, t + "xxx") for i, t in enumerate(text)], "document_id string, page_number int, chunk_index int, content_markdown string")
    df = df.withColumn("content_markdown", F.regexp_replace("content_markdown", "(?m)^(#+ .*)$", "$1 title"))
    got = [(r.page_number, r.level, r.title) for r in tc.toc_entries(tc.heading_rows(df)).orderBy("page_number").collect()]
    assert [(p, lv) for p, lv, _ in got] == [(1, 1), (2, 2), (4, 1), (5, 2)]


def test_build_toc_pages_and_links(spark):
    text = ["## One title", "### Sub title", "text", "## Two title", "## Same page a\n", "end"]
    pages = [1, 2, 3, 4, 4, 9]
    chunks = spark.createDataFrame([(f"c{i}", "d", p, i, t) for i, (p, t) in enumerate(zip(pages, text))], "chunk_id string, document_id string, page_number int, chunk_index int, content_markdown string")
    docs = spark.createDataFrame([("d", 10)], "document_id string, total_pages int")
    toc, linked = tc.build_toc(chunks, docs)
    rows = toc.orderBy("ord").collect()
    assert [(r.title, r.page_start, r.page_end) for r in rows] == [
        ("One title", 1, 3), ("Sub title", 2, 3), ("Two title", 4, 10), ("Same page a", 4, 10)]
    assert rows[1].parent_id == rows[0].toc_id and rows[2].parent_id is None
    ids = {r.toc_id: r.title for r in rows}
    assert {r.chunk_id: ids.get(r.toc_id) for r in linked.collect()} == {
        "c0": "One title", "c1": "One title", "c2": "One title", "c3": "Two title", "c4": "Two title", "c5": "Two title"}


def test_native_page_ends_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, o, rng.randrange(1, 4), rng.randrange(1, 40)) for d in (1, 2) for o in range(60)]
    df = spark.createDataFrame(rows, "document_id int, ord long, level int, page_start int")
    docs = spark.createDataFrame([(1, 50)], "document_id int, total_pages int")
    got = {(r.document_id, r.ord): r.page_end for r in tc.native_page_ends(df, docs).collect()}
    for d, o, lv, p in rows:
        limit = 50 if d == 1 else p
        nxt = next((q for e, k, l2, q in rows if e == d and k > o and l2 <= lv and q > p), None)
        assert got[(d, o)] == max(p, min(nxt - 1 if nxt else limit, limit))


def test_solution_links(spark):
    rows = [("e7", "d", 2, 0, "exercise_unsolved", 7, None), ("e8", "d", 2, 1, "exercise_unsolved", 8, None),
            ("s7", "d", 3, 0, "solution_only", 7, None), ("s7b", "d", 4, 0, "solution_only", 7, None), ("t", "d", 1, 0, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_number int, chunk_index int, pedagogical_type string, pedagogical_index int, linked_solution_chunk_id string").withColumn("has_solution", F.lit(False))
    got = {r.chunk_id: (r.pedagogical_type, r.linked_solution_chunk_id, r.has_solution) for r in j.link_solutions(chunks).collect()}
    assert got["e7"] == ("exercise_solved", "s7", True) and got["e8"] == ("exercise_unsolved", None, False)
    assert len(got) == 5 and j.ambiguous_solutions(chunks).count() == 1


def test_global_counts_fallback(spark):
    docs = spark.createDataFrame([("d", 30)], "document_id string, total_pages int")
    toc = spark.createDataFrame([(1,), (1,), (1,), (2,)], "level int")
    chunks = spark.createDataFrame([("evaluation_exam",), ("evaluation_exam",)], "pedagogical_type string")
    none = spark.createDataFrame([], "x int")
    full = agg.global_counts(docs, toc, chunks, none, none).first()
    assert (full.courses, full.assessments, full.chapters) == (3, 2, 3)
    assert agg.global_counts(docs, toc.where("false"), chunks, none, none).first().courses == 1


def test_telemetry_of_nothing(spark):
    bench = spark.createDataFrame([], "document_id string, execution_time_ms double, confidence_score double, ram_peak_mb double, vlm_provider_used string, fallback_triggered boolean")
    assert tuple(agg.telemetry_averages(bench).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_toc_fold_equals_one_pass_memory(spark):
    """Splitting a document into runs never changes the accepted headings."""
    rng = random.Random(5)
    rows = []
    for doc in ("hot", "cold"):
        for page in range(1, 301 if doc == "hot" else 20):
            n = 1 if rng.random() < 0.8 else 3
            rows.append((doc, page, 0, [(rng.choice([1, 1, 2]), rng.choice("abc")) for _ in range(n)]))
    df = spark.createDataFrame(rows, "document_id string, page_number int, chunk_index int, hs array<struct<level:int,title:string>>")
    assert tc.fresh_starts(df).where("document_id = 'hot'").select("_run").distinct().count() > 10
    got = sorted((r.document_id, r.page_number, r.level, r.title) for r in tc.toc_entries(df).collect())
    want = []
    for doc in ("hot", "cold"):
        memory = {}
        for d, page, _, hs in rows:
            if d != doc:
                continue
            for level, title in hs:
                if memory.get(level) != title:
                    memory[level] = title
                    if level == 1:
                        memory[2] = None
                    want.append((doc, page, level, title))
                    break
    assert got == sorted(want)


def test_contents_rows_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    """More rows than the session's shuffle tasks should hold get more tasks, with the same page ends."""
    from foliospark import session
    from foliospark.catalog.tables import Tables

    lines = [(n % 40, n % 7, 1 + n % 5) for n in range(400)] + [(None, 1, 1), (3, None, 2)]
    spark.createDataFrame(lines, "l_partkey long, l_quantity int, l_linenumber int").selectExpr(
        "l_partkey", "CAST(l_quantity AS DOUBLE) AS l_quantity", "l_linenumber", "'A' AS l_returnflag", "'F' AS l_linestatus",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    documents = spark.createDataFrame([(n, 5) for n in range(0, 40, 2)], "document_id long, total_pages int")
    rows = lambda: Tables(spark, str(tmp_path))["b_toc"].drop("page_end")
    ends = lambda tasks: sorted(tc.toc_page_ends(rows(), documents, tasks).collect(), key=str)
    before = ends(None)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.tasks_for(spark, 5) == least
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.tasks_for(spark, 401) == max(least, 41) and rows().rdd.getNumPartitions() == max(least, 41)
    assert ends(41) == before and tc.toc_page_ends(rows(), documents, 41).rdd.getNumPartitions() == 41
