import pytest
from pyspark.sql import functions as F

from foliospark.operators.joins import finished_batches
from foliospark.operators.scans import rate_limit
from foliospark.plans import corpus_edit as ed, ledger as lg
from foliospark.plans.chunk_corpus import chunk_pages, embed, formula_artifacts, repair
from foliospark.sources.corpus import import_artifacts, import_curriculum, list_files, register_documents, scan_corpus
from foliospark.sources.snapshots import Conflict, Snapshots
from foliospark.sources.store import Store
from foliospark.streaming import jobs as st


def test_ledger(spark):
    jobs = spark.createDataFrame([("a", "d3", 1, "EXTRACTING", "b", 0, None), ("b", "d3", 2, "READY", "b", 0, None)],
                                 "job_id string, document_id string, page_number int, status string, batch_id string, retry_count int, error_log string")
    assert lg.recover(jobs).where("status = 'QUEUED'").count() == 1
    docs = spark.createDataFrame([("d3", 10)], "document_id string, total_pages int")
    toc = spark.createDataFrame([("t", 2, None)], "toc_id string, page_start int, page_end int")
    ask = spark.createDataFrame([("n", "d3", "page_range", 1, 3, None), ("c", "d3", "chapter", None, None, "t")],
                                "batch_id string, document_id string, mode string, page_start int, page_end int, toc_id string")
    new = lg.enqueue(ask, docs, toc, lg.recover(jobs))
    assert sorted(r.page_number for r in new.where("batch_id = 'n'").collect()) == [1, 3]
    report = {r.batch_id: (r.pages_total, r.skipped_ready) for r in lg.enqueue_report(ask, docs, toc, jobs).collect()}
    assert report == {"n": (3, 1), "c": (9, 1)}
    state = lg.recover(jobs)
    out = spark.createDataFrame([("a", False, "boom")], "job_id string, ok boolean, error string")
    for want in ("QUEUED", "QUEUED", "QUARANTINE"):
        state = lg.record_outcomes(state, out)
        assert state.where("job_id = 'a'").first().status == want
    ids = spark.createDataFrame([("a",), ("zz",)], "job_id string")
    assert lg.retry(state, ids).where("job_id = 'a'").first().retry_count == 0
    assert [r.job_id for r in lg.refused(state, ids).collect()] == ["zz"]
    assert lg.cancel(lg.recover(jobs), "b").count() == 1
    batches = spark.createDataFrame([("b",), ("empty",)], "batch_id string")
    assert [r.batch_id for r in finished_batches(batches, jobs).collect()] == ["empty"]


@pytest.fixture(scope="module")
def corpus(spark):
    page = "document_id string, page_number int"
    return {
        "documents": spark.createDataFrame([("d", 3)], "document_id string, total_pages int"),
        "toc": spark.createDataFrame([("t1", "d", 1, 2)], "toc_id string, document_id string, page_start int, page_end int"),
        "chunks": spark.createDataFrame([("c1", "d", 1, 0, False), ("c2", "d", 2, 0, True), ("c3", "d", 2, 1, False), ("c4", "e", 2, 0, False)],
                                        f"chunk_id string, {page}, chunk_index int, is_human_edited boolean"),
        "artifacts": spark.createDataFrame([("a1", "d", 2, "c3", "x", None, False)],
                                           f"artifact_id string, {page}, chunk_id string, raw_data string, raw_binary binary, is_human_edited boolean"),
        "page_scans": spark.createDataFrame([("d", 1, 10), ("d", 2, 10)], f"{page}, width_px int"),
        "jobs": spark.createDataFrame([("j1", "d", 2, "READY", "b", 0, None)], f"job_id string, {page}, status string, batch_id string, retry_count int, error_log string"),
    }


@pytest.mark.parametrize("scope", [
    ed.Scope("page", "d", 2), ed.Scope("page_range", "d", 1, 2), ed.Scope("chapter", "d", toc_id="t1"), ed.Scope("document", "d"),
    ed.Scope("artifacts_only", "d"), ed.Scope("curriculum_only"), ed.Scope("page", "d", 2, preserve_human=False)])
def test_preview_equals_purge(corpus, scope):
    preview = {r.table: r.deleted for r in ed.purge_preview(corpus, scope).collect()}
    after = ed.purge(corpus, scope)
    assert preview == {n: corpus[n].count() - after[n].count() for n in corpus}
    if scope.preserve_human and scope.kind != "curriculum_only":
        assert after["chunks"].where("chunk_id = 'c2'").count() == 1


def test_purge_guards(corpus):
    with pytest.raises(ValueError):
        ed.purge(corpus, ed.Scope("database"), "base", "other")
    assert all(df.count() == 0 for df in ed.purge(corpus, ed.Scope("database"), "base", "base").values())
    with pytest.raises(ValueError):
        ed.Scope("page")
    with pytest.raises(ValueError):
        ed.Scope("artifacts_only")


def test_reprocess(corpus):
    jobs = ed.reprocess(corpus, ed.Scope("page", "d", 2), "again")["jobs"].collect()
    assert [(j.page_number, j.status, j.batch_id) for j in jobs] == [(2, "QUEUED", "again")]


def test_reingest_keeps_human_rows(spark, corpus):
    new = {
        "page_scans": spark.createDataFrame([("d", 2, 99)], "document_id string, page_number int, width_px int"),
        "chunks": spark.createDataFrame([("d", 2, 0), ("d", 2, 1)], "document_id string, page_number int, chunk_index int").withColumn("is_human_edited", F.lit(False)),
        "artifacts": spark.createDataFrame([("n1", "d", 2, "y", None, False), ("n2", "d", 2, None, None, False)],
                                           "artifact_id string, document_id string, page_number int, raw_data string, raw_binary binary, is_human_edited boolean"),
    }
    out = ed.reingest(corpus, new)
    page = out["chunks"].where("document_id = 'd' and page_number = 2").collect()
    assert sorted((c.chunk_index, c.is_human_edited) for c in page) == [(0, True), (1, False)]
    assert [(a.artifact_id, a.chunk_id) for a in out["artifacts"].collect()] == [("n1", None)]
    assert sorted(s.width_px for s in out["page_scans"].collect()) == [10, 99]
    again = ed.reingest({**corpus, **out}, new)
    assert sorted(map(str, again["chunks"].collect())) == sorted(map(str, out["chunks"].collect()))


def test_edits_and_cascade(spark, corpus):
    chunks = corpus["chunks"].withColumn("content_markdown", F.lit("old")).withColumn("updated_at", F.lit(None).cast("timestamp")) \
        .withColumn("section_title", F.lit("s")).withColumn("pedagogical_type", F.lit(None).cast("string"))
    patch = spark.createDataFrame([("c1", "|a|\n|b|c|", None, None)], "chunk_id string, content_markdown string, section_title string, pedagogical_type string")
    edited = ed.apply_edits(chunks, patch, "chunk_id", ed.CHUNK_FIELDS, F.current_timestamp())
    row = edited.where("chunk_id = 'c1'").first()
    assert row.content_markdown.startswith("|a|") and row.section_title == "s" and row.is_human_edited and row.updated_at
    assert not ed.edit_report(edited, patch).first().is_valid
    left = ed.cascade_delete(corpus, spark.createDataFrame([("d",)], "document_id string"))
    assert left["chunks"].count() == 1 and all(left[n].count() == 0 for n in ("artifacts", "page_scans", "jobs", "toc"))


def test_cascade_links_meet_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr("foliospark.session.TASK_ROWS", 100)
    chunks = spark.range(1000).selectExpr("id AS chunk_id", "id % 10 AS document_id", "IF(id % 4 = 0, NULL, id + 1) AS linked_solution_chunk_id")
    artifacts = spark.range(1000).selectExpr("id AS artifact_id", "id % 7 AS document_id", "IF(id % 5 = 0, NULL, id * 2) AS chunk_id")
    twice = chunks.union(chunks.where("chunk_id < 50")).union(spark.createDataFrame([(None, 1, 3)], "chunk_id long, document_id long, linked_solution_chunk_id long"))
    left = ed.cascade_delete({"chunks": twice, "artifacts": artifacts}, spark.createDataFrame([(3,)], "document_id long"))
    alive = {n for n in range(1000) if n % 10 != 3}
    own = [(n, n + 1 if n % 4 and n + 1 in alive else None) for n in sorted([*alive, *(n for n in alive if n < 50)])] + [(None, 3 if 3 in alive else None)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, left["chunks"].select("chunk_id", "linked_solution_chunk_id").collect()), key=key) == sorted(own, key=key)
    assert sorted(map(tuple, left["artifacts"].select("artifact_id", "chunk_id").collect()), key=key) == sorted(
        [(n, 2 * n if n % 5 and 2 * n in alive else None) for n in range(1000) if n % 7 != 3], key=key)
    linked = left["chunks"].where("linked_solution_chunk_id IS NOT NULL OR chunk_id % 4 <> 0")
    largest = linked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 150


PAGES = [
    ("d", 1, "Cours : Théorème de Pythagore\n\nDéfinition : si $a^2 + b^2 = c^2$ alors."),
    ("d", 2, "## Exercice n° 7\n\nAvec $3x$ et\n\n$$x^2 - 1 = (x-1)(x+1)$$"),
    ("d", 3, "Correction de l'exercice n° 7\n\n$c = \\sqrt{3^2 + 4^2} = 5$"),
]


def test_pages_to_chunks(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, content_markdown string")
    chunks = chunk_pages(pages).orderBy("page_number").collect()
    assert [(c.pedagogical_type, c.pedagogical_index) for c in chunks] == [("course_theory", None), ("exercise_unsolved", 7), ("solution_only", 7)]
    assert formula_artifacts(pages).count() >= 3


def test_models_never_stop_the_job(spark):
    rows = spark.createDataFrame([("a", "latex_formula", "$x", False, "x"), ("b", "latex_formula", "$y$", False, "y"), ("c", "matrix", "{", False, "")],
                                 "block_id_ref string, artifact_type string, raw_data string, needs_vlm boolean, searchable_text string")
    fixed = {r.block_id_ref: (r.repair_state, r.raw_data) for r in repair(rows, lambda s: s + "$" if s == "$x" else 1 / 0).collect()}
    assert fixed == {"a": ("repaired", "$x$"), "b": ("valid", "$y$"), "c": ("failed", "{")}

    def broken():
        raise RuntimeError("no model")

    assert embed(rows, broken, "raw_data").where("embedding is null").count() == 3


STREAMED = "document_id string, page_number int, total_pages int, content_markdown string"


def test_stream_ingest_resumes_and_links(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    rows = [(d, p, 3, t) for d, p, t in PAGES]
    log = Snapshots(spark, sink)
    spark.createDataFrame(rows[:2], STREAMED).write.parquet(src)
    st.stream_ingest(spark, src, sink, ck)
    first = log.read("chunks").count()
    assert log.read("solution_links").count() == 0
    spark.createDataFrame(rows[1:], STREAMED).write.mode("append").parquet(src)  # page 2 comes again
    st.stream_ingest(spark, src, sink, ck)
    st.stream_ingest(spark, src, sink, ck)
    assert log.read("jobs").count() == 3 and first == 2 and log.read("chunks").count() == 3
    assert st.latest_per_document(spark, sink, "solution_links").count() == 1
    toc = st.latest_per_document(spark, sink, "toc").collect()
    assert [(t.title, t.page_start, t.page_end) for t in toc] == [("Exercice n° 7", 2, 3)]
    assert log.load().marks == {"ingest": 1, "contents": 1}


def test_stream_contents_leave_the_plan_to_the_batch(spark, tmp_path, monkeypatch):
    """Contents are planned outside the stream's session, and a document's state tells its rows as one text."""
    asked, contents = [], st.toc_of_headings

    def watched(heads, totals):
        asked.append((heads.sparkSession.conf.get("spark.sql.adaptive.enabled"), heads.count()))
        return contents(heads, totals)

    monkeypatch.setattr(st, "toc_of_headings", watched)
    marks = [("d", 1, 2, 0, "c1", "exercise_unsolved", 7, '[{"level":1,"title":"\u00c9t\u00e9 \\"a\\" \U0001f600"}]'), ("d", 2, 2, 0, "c2", "solution_only", 7, None),
             ("e", 4, None, None, None, None, None, None), (None, 1, 1, 0, "c3", None, None, '[{"level":1,"title":"x"}]')]
    spark.createDataFrame(marks, st.MARKS).write.parquet(str(tmp_path / "marks"))
    st.stream_contents(spark, str(tmp_path / "marks"), str(tmp_path / "sink"), str(tmp_path / "checkpoint"))
    assert asked == [("true", 2)]
    toc = st.latest_per_document(spark, str(tmp_path / "sink"), "toc").where("document_id = 'd'").collect()
    assert [(r.title, r.page_start, r.page_end) for r in toc] == [('\u00c9t\u00e9 "a" \U0001f600', 1, 2)]
    links = Snapshots(spark, str(tmp_path / "sink")).read("solution_links").collect()
    assert [(r.chunk_id, r.linked_solution_chunk_id) for r in links] == [("c1", "c2")]


def test_stream_contents_need_no_stored_text(spark, tmp_path):
    """Contents of a document are rebuilt from its new page and the state, with its stored files gone; folders stay few."""
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    log = Snapshots(spark, sink)
    for n in range(1, 6):
        page = [("d", n, 9, f"## Part {n}\n\ntext"), (f"e{n}", 1, 1, None), (None, n, 1, "# none")]
        spark.createDataFrame(page, STREAMED).coalesce(1).write.mode("append").parquet(src)
        if n == 5:
            for part in (tmp_path / "sink" / "chunks").rglob("part-*.parquet"):
                part.write_bytes(b"broken")
        st.stream_ingest(spark, src, sink, ck, most_parts=2 if n < 5 else 99)
        assert all(len(p) <= 4 for p in log.load().parts.values())
    toc = st.latest_per_document(spark, sink, "toc").where("document_id = 'd'").orderBy("page_start").collect()
    assert [(t.title, t.page_start, t.page_end) for t in toc] == [(f"Part {n}", n, n if n < 5 else 9) for n in range(1, 6)]
    assert log.read("jobs").count() == 15
    left = [p for p in (tmp_path / "sink-marks").rglob("part-*.parquet")]
    assert len(left) <= 8  # read files of the queue go


def test_stream_killed_after_its_commit(spark, tmp_path, monkeypatch):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    spark.createDataFrame([("d", 1, 1, "## Part one\n\ntext")], STREAMED).write.parquet(src)

    def dies(*args):
        raise Killed

    monkeypatch.setattr(st, "_queue", dies)
    with pytest.raises(Exception, match="Killed"):
        st.stream_ingest(spark, src, sink, ck)
    monkeypatch.undo()
    assert Snapshots(spark, sink).read("jobs").count() == 1
    st.stream_ingest(spark, src, sink, ck)
    assert Snapshots(spark, sink).read("chunks").count() == Snapshots(spark, sink).read("jobs").count() == 1
    assert [t.title for t in st.latest_per_document(spark, sink, "toc").collect()] == ["Part one"]


def test_rate_limit_state(spark, tmp_path):
    """Batches with late requests equal the batch operator on top of what was accepted; keys that idle leave the state."""
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = "key string, micros long, request_id int"
    second = 1_000_000
    parts = [[("a", t) for t in (0, 10, 20, 30, 61, 62)] + [("idle", 5), (None, 7), (None, 8), (None, 9)],
             [("a", t) for t in (40, 75, 63, 200)] + [("b", t) for t in (70, 71, 72, 90)],
             [("a", t) for t in (190, 260, 900)], [("b", 2000)]]
    numbers, accepted, want, rows_held = iter(range(99)), None, {}, []
    for part in parts:
        df = spark.createDataFrame([(k, (10 ** 6 + t) * second, next(numbers)) for k, t in part], schema).coalesce(1)
        df.write.mode("append").parquet(src)
        twin = [tuple(r) for r in rate_limit(df, 2, 60, accepted=accepted).collect()]
        want |= {ident: allowed for _, _, ident, allowed in twin}
        kept = [(k, t) for k, t, _, allowed in twin if allowed] + ([tuple(r) for r in accepted.collect()] if accepted is not None else [])
        accepted = spark.createDataFrame(kept, "key string, micros long")
        query = st.stream_rate_limit(spark.readStream.schema(schema).parquet(src), sink, ck, 2, 60, lateness=100)
        rows_held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert {r.request_id: r.allowed for r in spark.read.parquet(sink).collect()} == want
    assert rows_held[0] == 3 and rows_held[-1] == 1


def test_updates_keep_the_newest(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 5, 0)], "k string, n int, batch long")
    assert sorted((r.k, r.n) for r in st.latest(rows, ["k"]).collect()) == [("a", 2), ("b", 5)]


SCANS = "corpus string, document_id string, page_number int, width_px int"


def test_store_upsert(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.append("page_scans", spark.createDataFrame([("a", f"d{i}", 1, 10) for i in range(20)] + [("b", "d0", 1, 1)], SCANS))
    store.upsert_scans("a", spark.createDataFrame([("d3", 1, 99), ("d3", 2, 98)], "document_id string, page_number int, width_px int"))
    got = {(r.document_id, r.page_number): r.width_px for r in store.read("page_scans", "a").collect()}
    assert len(got) == 21 and got["d3", 1] == 99 and got["d3", 2] == 98 and store.read("page_scans", "b").count() == 1
    assert store.read("page_scans", "a", ["d3", "d4"]).count() == 3 and store.read("page_scans", "a", []).count() == 0
    assert store.read("page_scans", "none").count() == 0
    with pytest.raises(FileNotFoundError):
        store.read("nothing")


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["stage", "_put"])
def test_killed_change_leaves_one_whole_snapshot(spark, tmp_path, monkeypatch, step):
    """A change over two tables that dies before its manifest stands has not happened, in either table."""
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    pages = spark.createDataFrame([("a", f"d{i}", i, 10) for i in range(6)], SCANS)
    for table in ("page_scans", "chunks"):
        store.append(table, pages)
    calls = []
    real = getattr(store.log, step)

    def dies(*args):
        calls.append(args)
        if step == "_put" or len(calls) == 2:
            raise Killed
        return real(*args)

    monkeypatch.setattr(store.log, step, dies)
    new = pages.withColumn("width_px", F.lit(77))
    with pytest.raises(Killed):
        store.change("a", {"page_scans": new, "chunks": new})
    monkeypatch.undo()
    assert all(r.width_px == 10 for t in ("page_scans", "chunks") for r in store.read(t, "a").collect())
    store.change("a", {"page_scans": new, "chunks": new})
    assert all(r.width_px == 77 for t in ("page_scans", "chunks") for r in store.read(t, "a").collect())
    assert store.log.vacuum() >= 2 and store.read("chunks").count() == 6


def test_second_writer_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.createDataFrame([("a", "d", 1, 10)], SCANS)
    store.append("page_scans", rows)
    base = store.log.load()
    store.change("a", {"page_scans": rows.withColumn("width_px", F.lit(11))}, base=base)
    with pytest.raises(Conflict):
        store.change("a", {"page_scans": rows.withColumn("width_px", F.lit(12))}, base=base)
    assert [r.width_px for r in store.read("page_scans").collect()] == [11]
    # A reader of the older snapshot still sees it.
    assert [r.width_px for r in store.read("page_scans", snapshot=base).collect()] == [10]
    with pytest.raises(ValueError, match="columns"):
        store.append("page_scans", rows.withColumn("more", F.lit(1)))


def test_compaction_bounds_folders(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "s"))
    for n in range(12):
        log.commit(log.load(), {"t": log.stage("t", spark.createDataFrame([(n, n % 3)], "n int, k int"))}, marks={"w": n})
        log.compact("t", most=4)
        assert len(log.load().parts["t"]) <= 5
    assert sorted(r.n for r in log.read("t").collect()) == list(range(12)) and log.load().marks == {"w": 11}
    log.commit(log.load(), {"t": log.stage("t", spark.createDataFrame([(99, 1)], "n int, k int"))})
    newest = lambda df: df.groupBy("k").agg(F.max("n").alias("n")).select("n", "k")
    log.compact("t", most=0, collapse=newest)
    assert sorted((r.n, r.k) for r in log.read("t").collect()) == [(9, 0), (11, 2), (99, 1)]


def test_sources_and_store(spark, tmp_path):
    base = tmp_path / "sources" / "math" / "1AM"
    base.mkdir(parents=True)
    (base / "book.pdf").write_bytes(b"%PDF-")
    (base / "map.json").write_text("{}")
    root = str(tmp_path / "sources")
    empty = spark.createDataFrame([], "source_path string")
    found = scan_corpus(list_files(spark, root), empty, root)
    row = found.first()
    assert (row.corpus, row.academic_level, row.ingested, row.file_size_bytes) == ("math_1AM", "1AM", False, 5)
    docs = register_documents(found)
    assert (docs.first().title, docs.first().doc_source) == ("book", "math/1AM")
    assert register_documents(scan_corpus(list_files(spark, root), docs, root)).count() == 0
    ask = spark.createDataFrame([(str(base / "map.json"), "d", None, 1, "geo", "geojson_map", None), (str(base / "book.pdf"), "d", None, 1, "geo", "cad_3d_model", "cap")],
                                "path string, document_id string, chunk_id string, page_number int, domain string, artifact_type string, caption string")
    absent = spark.createDataFrame([(str(base / "none.json"), "d", None, 1, "geo", "geojson_map", None)], ask.schema)
    made, refused = import_artifacts(spark, ask.union(absent), root)
    got = {r.artifact_type: r for r in made.collect()}
    assert len(got) == 2 and [r.reason for r in refused.collect()] == ["missing"]
    small, refused = import_artifacts(spark, ask, root, max_bytes=3)
    assert {r.reason for r in refused.collect()} == {"too_large"} and refused.count() == 1
    assert got["geojson_map"].raw_data == "{}" and got["cad_3d_model"].raw_binary == b"%PDF-"
    assert got["cad_3d_model"].searchable_text == "cap book.pdf"

    store = Store(spark, str(tmp_path / "store"), buckets=3)
    table = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2), ("b", "d3", 3)], "corpus string, document_id string, n int")
    store.append("documents", table)
    store.rewrite("documents", "a", store.read("documents", "a").where("n = 2"))
    assert sorted(r.n for r in store.read("documents").collect()) == [2, 3]
    assert [r.n for r in store.read("documents", "a", ["d2"]).collect()] == [2]
    store.duplicate("a", "z", ["documents"])
    assert store.read("documents", "z").count() == 1
    with pytest.raises(FileExistsError):
        store.duplicate("a", "z", ["documents"])
    store.export("b", str(tmp_path / "out"), ["documents"])
    with pytest.raises(Exception):
        store.export("b", str(tmp_path / "out"), ["documents"])


def test_curriculum_import_modes(spark):
    old = {"terms": spark.createDataFrame([("t1", "a"), ("t2", "b")], "term_id string, label string")}
    new = {"terms": spark.createDataFrame([("t2", "B"), ("t3", "c")], "term_id string, label string")}
    merged = {r.term_id: r.label for r in import_curriculum(old, new)["terms"].collect()}
    assert merged == {"t1": "a", "t2": "B", "t3": "c"}
    assert import_curriculum(old, new, "replace")["terms"].count() == 2
    with pytest.raises(ValueError):
        import_curriculum(old, {"users": new["terms"]})
