"""Corpus building and mutation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foliospark.catalog.q_text import _ANSWER, _LETTERS, _RAW, _TYPES, boxed, letter_encoder
from foliospark.catalog.q_listing import _SIZED
from foliospark.catalog.tables import Tables, register
from foliospark.functions.artifacts import first_json
from foliospark.operators.aggregates import count_if
from foliospark.plans.chunk_corpus import embed
from foliospark.plans import artifact_jobs as aj, corpus_edit as ed, layout_boxes, ledger as lg


def _corpus(t: Tables) -> dict[str, DataFrame]:
    return {
        "documents": t["b_documents"], "chunks": t["b_chunks"], "artifacts": t["b_artifacts"],
        "page_scans": t["b_scans"], "jobs": t["v_jobs"], "toc": t["b_toc"], "benchmarks": t["v_benchmarks"],
        "links": t["b_links"],
    }


# One shape for the rows of all tables: a name and a value, as text that both engines read.
_NAMED = {
    "chunks": ("CAST(chunk_id AS STRING)", "CAST(is_human_edited AS INT)"),
    "artifacts": ("CAST(artifact_id AS STRING)", "CAST(is_human_edited AS INT)"),
    "page_scans": ("CAST(document_id AS STRING) || ':' || CAST(page_number AS STRING)", "CAST(width_px AS INT)"),
    "jobs": ("CAST(job_id AS STRING) || status", "CAST(retry_count AS INT)"),
    "toc": ("CAST(toc_id AS STRING)", "CAST(page_start AS INT)"),
    "benchmarks": ("CAST(event_id AS STRING)", "CAST(page_number AS INT)"),
    "links": ("link_id || from_id || to_id", "CAST(length(link_type) AS INT)"),
    "documents": ("CAST(document_id AS STRING)", "CAST(total_pages AS INT)"),
}


def _rows(tables: dict[str, DataFrame], named: dict[str, tuple[str, str]] = _NAMED) -> DataFrame:
    """Name and value of every row of some tables."""
    return reduce(DataFrame.unionByName, [
        df.selectExpr(f"'{name}' AS table", f"{named[name][0]} AS id", f"{named[name][1]} AS value") for name, df in tables.items()])


def _rows_sql(name: str, source: str, where: str = "TRUE", named: dict[str, tuple[str, str]] = _NAMED) -> str:
    return f"""SELECT '{name}' AS "table", {named[name][0]} AS id, {named[name][1]} AS value FROM {source} WHERE {where}"""


_SCOPE = "document_id = 7 AND page_number BETWEEN 5 AND 40"


@register("agg_purge_preview", f"""
    SELECT 'chunks' AS "table", count(*) FILTER (WHERE NOT is_human_edited) AS deleted,
           count(*) FILTER (WHERE is_human_edited) AS preserved_human FROM @b_chunks WHERE {_SCOPE}
    UNION ALL SELECT 'artifacts', count(*) FILTER (WHERE NOT is_human_edited), count(*) FILTER (WHERE is_human_edited)
    FROM @b_artifacts WHERE {_SCOPE}
    UNION ALL SELECT 'page_scans', count(*), 0 FROM @b_scans WHERE {_SCOPE}
    UNION ALL SELECT 'jobs', count(*), 0 FROM @v_jobs WHERE {_SCOPE}
    UNION ALL SELECT unnest(['documents', 'toc', 'benchmarks', 'links']), 0, 0""")
def agg_purge_preview(t: Tables) -> DataFrame:
    return ed.purge_preview(_corpus(t), ed.Scope("page_range", 7, 5, 40))


_DOC = "document_id = 7"


@register("job_purge_scope", " UNION ALL ".join([
    *[_rows_sql(n, f"@{v}", f"NOT ({_DOC} AND NOT is_human_edited)") for n, v in (("chunks", "b_chunks"), ("artifacts", "b_artifacts"))],
    *[_rows_sql(n, f"@{v}", f"NOT ({_DOC})") for n, v in (
        ("page_scans", "b_scans"), ("jobs", "v_jobs"), ("toc", "b_toc"), ("benchmarks", "v_benchmarks"))],
    _rows_sql("links", "@b_links"), _rows_sql("documents", "@b_documents")]))
def job_purge_scope(t: Tables) -> DataFrame:
    """All that a purge of one document leaves, row by row."""
    return _rows(ed.purge(_corpus(t), ed.Scope("document", 7)))


@register("job_purge_chapter", """
    WITH r AS (SELECT page_start, coalesce(page_end, 1000000) AS page_end FROM @b_toc WHERE document_id = 9
               AND toc_id = (SELECT min(toc_id) FROM @b_toc WHERE document_id = 9))
    SELECT chunk_id FROM @b_chunks, r WHERE NOT (document_id = 9 AND page_number BETWEEN r.page_start AND r.page_end
           AND NOT is_human_edited)""")
def job_purge_chapter(t: Tables) -> DataFrame:
    entry = t["b_toc"].where("document_id = 9").agg(F.min("toc_id")).first()[0]
    kept = ed.purge(_corpus(t), ed.Scope("chapter", 9, toc_id=entry))
    return kept["chunks"].select("chunk_id")


@register("job_reprocess_scope", """
    SELECT document_id, page_number, status, batch_id FROM @v_jobs WHERE NOT (document_id = 7 AND page_number BETWEEN 5 AND 40)
    UNION ALL SELECT 7, CAST(p AS INT), 'QUEUED', 'again' FROM range(5, 41) AS r(p)""")
def job_reprocess_scope(t: Tables) -> DataFrame:
    jobs = ed.reprocess(_corpus(t), ed.Scope("page_range", 7, 5, 40), "again")["jobs"]
    return jobs.select("document_id", "page_number", "status", "batch_id")


@register("job_reingest_scope", """
    WITH pg AS (SELECT s.document_id, s.page_number FROM @b_scans s JOIN @b_documents d ON d.document_id = s.document_id
                WHERE d.doc_type = 'Sujet'),
    kept AS (SELECT chunk_id, document_id, page_number, chunk_index, is_human_edited FROM @b_chunks c
             WHERE is_human_edited OR NOT EXISTS (SELECT 1 FROM pg WHERE pg.document_id = c.document_id
                   AND pg.page_number = c.page_number)),
    fresh AS (SELECT document_id, page_number, k AS chunk_index FROM pg, (SELECT unnest([0, 1]) AS k)),
    added AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM kept h WHERE h.is_human_edited
              AND h.document_id = f.document_id AND h.page_number = f.page_number AND h.chunk_index = f.chunk_index))
    SELECT 'chunks' AS "table", CAST(chunk_id AS STRING) AS id, CAST(is_human_edited AS STRING) AS value FROM kept
    UNION ALL SELECT 'chunks', CAST(-(document_id * 100000 + page_number * 10 + chunk_index) AS STRING), 'false' FROM added
    UNION ALL SELECT 'artifacts', CAST(artifact_id AS STRING), NULL FROM @b_artifacts a WHERE is_human_edited OR NOT EXISTS
              (SELECT 1 FROM pg WHERE pg.document_id = a.document_id AND pg.page_number = a.page_number)
    UNION ALL SELECT 'artifacts', CAST(-(p.document_id * 100000 + p.page_number * 10) AS STRING),
              CASE WHEN f.document_id IS NOT NULL THEN CAST(-(p.document_id * 100000 + p.page_number * 10) AS STRING) END
              FROM pg p LEFT JOIN added f ON f.document_id = p.document_id AND f.page_number = p.page_number AND f.chunk_index = 0
    UNION ALL SELECT 'page_scans', CAST(document_id AS STRING) || ':' || CAST(page_number AS STRING), CAST(width_px AS STRING)
              FROM @b_scans""")
def job_reingest_scope(t: Tables) -> DataFrame:
    """Every page of the exam documents comes in again with two chunks and one
    artifact."""
    again = t["b_documents"].where("doc_type = 'Sujet'").select("document_id")
    pages = t["b_scans"].join(again, "document_id", "left_semi")
    key = F.col("document_id") * 100000 + F.col("page_number") * 10
    chunks = pages.select(
        "document_id", "page_number", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), key.alias("_k")
    ).select(
        "document_id", "page_number", "chunk_index", (-(F.col("_k") + F.col("chunk_index"))).alias("chunk_id"),
        F.lit(False).alias("is_human_edited"),
    )
    artifacts = pages.select(
        "document_id", "page_number", (-key).alias("artifact_id"), F.lit("$x$").alias("raw_data"),
        F.lit(None).cast("binary").alias("raw_binary"), F.lit(None).cast("long").alias("chunk_id"),
        F.lit(False).alias("is_human_edited"),
    )
    out = ed.reingest(
        {"chunks": t["b_chunks"], "artifacts": t["b_artifacts"], "page_scans": t["b_scans"]},
        {"chunks": chunks, "artifacts": artifacts, "page_scans": pages},
    )
    return _rows(out, {
        "chunks": (_NAMED["chunks"][0], "CAST(is_human_edited AS STRING)"),
        # New artifacts hang on the first new chunk of their page.
        "artifacts": (_NAMED["artifacts"][0], "CASE WHEN artifact_id < 0 THEN CAST(chunk_id AS STRING) END"),
        "page_scans": (_NAMED["page_scans"][0], "CAST(width_px AS STRING)"),
    })


@register("job_edit_chunk", """
    SELECT chunk_id, CASE WHEN pedagogical_type = 'solution_only' THEN 'edited' ELSE section_title END AS section_title,
           pedagogical_type, CAST(is_human_edited OR coalesce(pedagogical_type = 'solution_only', FALSE) AS INT) AS is_human_edited
    FROM @b_chunks""")
def job_edit_chunk(t: Tables) -> DataFrame:
    chunks = t["b_chunks"].withColumn("updated_at", F.lit(None).cast("timestamp"))
    patches = t["b_chunks"].where("pedagogical_type = 'solution_only'").select(
        "chunk_id", F.lit("edited").alias("section_title"),
        F.lit(None).cast("string").alias("pedagogical_type"),
    )
    edited = ed.apply_edits(chunks, patches, "chunk_id", ("section_title", "pedagogical_type"), F.current_timestamp())
    return edited.select(
        "chunk_id", "section_title", "pedagogical_type", F.col("is_human_edited").cast("int").alias("is_human_edited")
    )


# A third of the corrections hold a ragged table.
_CORRECTED = "CASE WHEN chunk_id % 3 = 0 THEN '|a|' || chr(10) || '|b|c|' ELSE 'corrected text' END"


def _corrections(t: Tables) -> tuple[DataFrame, DataFrame]:
    chunks = t["v_chunks"].withColumn("updated_at", F.lit(None).cast("timestamp"))
    patches = t["v_chunks"].where("pedagogical_type = 'solution_only'").select(
        "chunk_id", F.expr(_CORRECTED).alias("content_markdown"))
    return ed.apply_edits(chunks, patches, "chunk_id", ("content_markdown",), F.current_timestamp()), patches


@register("job_edit_report", """
    SELECT chunk_id, CAST(chunk_id % 3 = 0 AS INT) AS n_errors, CAST(chunk_id % 3 <> 0 AS INT) AS is_valid
    FROM @v_chunks WHERE pedagogical_type = 'solution_only'""")
def job_edit_report(t: Tables) -> DataFrame:
    """Lint result of every corrected chunk."""
    report = ed.edit_report(*_corrections(t))
    return report.select("chunk_id", "n_errors", F.col("is_valid").cast("int").alias("is_valid"))


@register("job_reembed", f"""
    WITH x AS (SELECT chunk_id, 'passage: ' || CASE WHEN pedagogical_type = 'solution_only' THEN {_CORRECTED} ELSE content_markdown END
               AS x, unnest(range(26)) AS n FROM @v_chunks)
    SELECT chunk_id, CAST(n AS INT) AS dim,
           CAST(length(x) - length(replace(x, substr('{_LETTERS}', CAST(n + 1 AS INT), 1), '')) AS DOUBLE) AS value FROM x""")
def job_reembed(t: Tables) -> DataFrame:
    """Corrected chunks embedded again; half of them had no vector yet."""
    edited, patches = _corrections(t)
    old = embed(t["v_chunks"].where("pedagogical_type <> 'solution_only' OR chunk_id % 2 = 0").select(
        "chunk_id", "content_markdown"), letter_encoder).select("chunk_id", "embedding")
    vectors = ed.reembed(old, edited, patches, letter_encoder)
    return vectors.select("chunk_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


@register("job_edit_artifact", """
    SELECT artifact_id, CASE WHEN artifact_type = 'data_table' THEN 'fixed' ELSE raw_data END AS raw_data, caption,
           CASE WHEN artifact_type = 'data_table' THEN 'fixed' ELSE searchable_text END AS searchable_text FROM @b_artifacts""")
def job_edit_artifact(t: Tables) -> DataFrame:
    artifacts = t["b_artifacts"].withColumn("updated_at", F.lit(None).cast("timestamp"))
    none = F.lit(None).cast("string")
    patches = t["events"].where("event_type = 'view'").select(
        F.col("event_id").alias("artifact_id"), F.lit("fixed").alias("raw_data"), none.alias("caption"),
        none.alias("render_config_json"),
    )
    edited = ed.apply_edits(artifacts, patches, "artifact_id", ed.ARTIFACT_FIELDS, F.current_timestamp())
    return edited.select("artifact_id", "raw_data", "caption", "searchable_text")


@register("job_curriculum_crud", """
    SELECT program_id, term_id, CASE WHEN program_id IN ('p1', 'p2') THEN 'renamed' ELSE title END AS title FROM @b_programs
    WHERE program_id NOT IN (SELECT 'p1' || CAST(r_regionkey AS STRING) FROM @region)
    UNION ALL SELECT 'n' || CAST(r_regionkey AS STRING), 't0', r_name FROM @region""")
def job_curriculum_crud(t: Tables) -> DataFrame:
    """Create five programs, rename two, delete five."""
    region = lambda prefix: F.concat(F.lit(prefix), F.col("r_regionkey").cast("string")).alias("program_id")
    created = t["region"].select(region("n"), F.lit("t0").alias("term_id"), F.col("r_name").alias("title"))
    renamed = t["b_programs"].where("program_id in ('p1', 'p2')").withColumn("title", F.lit("renamed"))
    rows = ed.upsert(t["b_programs"], created.unionByName(renamed), ["program_id"])
    return ed.delete(rows, t["region"].select(region("p1")), ["program_id"])


@register("job_cascade_delete", """
    WITH g AS (SELECT c_custkey AS d FROM @customer WHERE c_mktsegment = 'BUILDING'),
    ch AS (SELECT * FROM @b_chunks WHERE document_id NOT IN (SELECT d FROM g)),
    ar AS (SELECT * FROM @b_artifacts WHERE document_id NOT IN (SELECT d FROM g))
    SELECT 'chunks' AS "table", chunk_id AS id,
           CASE WHEN linked_solution_chunk_id IN (SELECT chunk_id FROM ch) THEN linked_solution_chunk_id END AS link FROM ch
    UNION ALL SELECT 'artifacts', artifact_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM ch) THEN chunk_id END FROM ar
    UNION ALL SELECT 'toc', toc_id, NULL FROM @b_toc WHERE document_id NOT IN (SELECT d FROM g)""")
def job_cascade_delete(t: Tables) -> DataFrame:
    gone = t["customer"].where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("document_id"))
    left = ed.cascade_delete({"chunks": t["b_chunks"], "artifacts": t["b_artifacts"], "toc": t["b_toc"]}, gone)
    links = {"chunks": ("chunk_id", "linked_solution_chunk_id"), "artifacts": ("artifact_id", "chunk_id"),
             "toc": ("toc_id", "CAST(NULL AS BIGINT)")}
    return _rows(left, links).withColumnRenamed("value", "link")


# ── ledger ─────────────────────────────────────────────────────────────────


def _requests(t: Tables) -> DataFrame:
    """One request per document, the mode by its kind."""
    first = t["b_toc"].groupBy("document_id").agg(F.min("toc_id").alias("first_toc"))
    docs = t["b_documents"].join(first, "document_id", "left")
    mode = F.when(F.col("document_id") % 3 == 0, "document").when(F.col("document_id") % 3 == 1, "page_range").otherwise("chapter")
    return docs.select(
        F.concat(F.lit("n"), F.col("document_id").cast("string")).alias("batch_id"), "document_id", mode.alias("mode"),
        F.lit(-2).alias("page_start"), (F.col("document_id") % 90).cast("int").alias("page_end"),
        F.when(mode == "chapter", F.col("first_toc")).alias("toc_id"),
    )


_ENQUEUE = """
    f AS (SELECT document_id, min(toc_id) AS toc_id FROM @b_toc GROUP BY document_id),
    s AS (SELECT 'n' || CAST(d.document_id AS STRING) AS batch_id, d.document_id,
                 CASE d.document_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE e.page_start END AS a,
                 CASE d.document_id % 3 WHEN 0 THEN 60 WHEN 1 THEN least(60, d.document_id % 90) ELSE coalesce(e.page_end, 60) END AS b
          FROM @b_documents d LEFT JOIN f ON f.document_id = d.document_id
          LEFT JOIN @b_toc e ON e.toc_id = f.toc_id AND e.document_id = d.document_id),
    p AS (SELECT batch_id, document_id, unnest(range(a, b + 1)) AS page_number FROM s WHERE a IS NOT NULL),
    q AS (SELECT p.*, EXISTS (SELECT 1 FROM @v_jobs r WHERE r.status = 'READY' AND r.document_id = p.document_id
                              AND r.page_number = p.page_number) AS done FROM p)"""


@register("job_enqueue", f"""
    WITH {_ENQUEUE}
    SELECT sha256('job:' || batch_id || ':' || CAST(document_id AS STRING) || ':' || CAST(page_number AS STRING)) AS job_id,
           batch_id, document_id, CAST(page_number AS INT) AS page_number, 'QUEUED' AS status FROM q WHERE NOT done""")
def job_enqueue(t: Tables) -> DataFrame:
    new = lg.enqueue(_requests(t), t["b_documents"], t["b_toc"], t["v_jobs"])
    return new.select("job_id", "batch_id", "document_id", "page_number", "status")


@register("job_enqueue_report", f"""
    WITH {_ENQUEUE}
    SELECT s.batch_id, greatest(0, b - a + 1) AS pages_total,
           (SELECT count(*) FROM q WHERE q.batch_id = s.batch_id AND done) AS skipped_ready FROM s WHERE a IS NOT NULL""")
def job_enqueue_report(t: Tables) -> DataFrame:
    return lg.enqueue_report(_requests(t), t["b_documents"], t["b_toc"], t["v_jobs"])


@register("ledger_recover", """
    SELECT CASE WHEN status = 'EXTRACTING' THEN 'QUEUED' ELSE status END AS status, count(*) AS n FROM @v_jobs GROUP BY 1""")
def ledger_recover(t: Tables) -> DataFrame:
    return lg.recover(t["v_jobs"]).groupBy("status").agg(F.count("*").alias("n"))


@register("job_ledger_update", """
    WITH o AS (SELECT o_orderkey AS job_id, o_orderpriority = '1-URGENT' AS ok, o_orderpriority = '5-LOW' AS bad FROM @orders)
    SELECT job_id, CASE WHEN ok THEN 'READY' WHEN NOT bad THEN status
                        WHEN retry_count + 1 >= 3 THEN 'QUARANTINE' ELSE 'QUEUED' END AS status,
           CASE WHEN bad THEN retry_count + 1 ELSE retry_count END AS retry_count,
           CASE WHEN bad THEN 'late' ELSE error_log END AS error_log FROM @v_jobs JOIN o USING (job_id)""")
def job_ledger_update(t: Tables) -> DataFrame:
    """Urgent jobs succeed, low ones fail, the others have no news."""
    outcomes = t["orders"].where("o_orderpriority in ('1-URGENT', '5-LOW')").select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_orderpriority") == "1-URGENT").alias("ok"), F.lit("late").alias("error")
    )
    done = lg.record_outcomes(t["v_jobs"], outcomes)
    return done.select("job_id", "status", "retry_count", "error_log")


@register("ledger_retry", """
    SELECT job_id, CASE WHEN status IN ('QUARANTINE') THEN 'QUEUED' ELSE status END AS status,
           CASE WHEN status = 'QUARANTINE' THEN 0 ELSE retry_count END AS retry_count,
           CASE WHEN status = 'QUARANTINE' THEN NULL ELSE error_log END AS error_log FROM @v_jobs""")
def ledger_retry(t: Tables) -> DataFrame:
    asked = t["orders"].where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id"))
    return lg.retry(t["v_jobs"], asked).select("job_id", "status", "retry_count", "error_log")


@register("ledger_refused", """
    SELECT job_id FROM @v_jobs WHERE status = 'INVALID_SOURCE'""")
def ledger_refused(t: Tables) -> DataFrame:
    asked = t["orders"].where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id"))
    return lg.refused(t["v_jobs"], asked)


@register("ledger_cancel", """
    SELECT batch_id, count(*) AS n FROM @v_jobs WHERE NOT (batch_id = 'b10' AND status = 'QUEUED') GROUP BY batch_id""")
def ledger_cancel(t: Tables) -> DataFrame:
    return lg.cancel(t["v_jobs"], "b10").groupBy("batch_id").agg(F.count("*").alias("n"))


# ── artifacts ──────────────────────────────────────────────────────────────


def _classifier(artifact_id: str) -> str | None:
    """Stand-in model: its answer is a function of the id alone."""
    number = int(artifact_id)
    if number % 5 == 4:
        raise TimeoutError("no answer")
    kind = ("geometry", "photo")[number % 2]
    return f'Sure {{"type": "{kind}", "semantic": "illustration", "caption_ar": "c{number}", "svg": "<svg>{number}</svg>"}}'


_REQUALIFIED = f"""
    z AS ({_SIZED}),
    c AS (SELECT artifact_id FROM z WHERE artifact_type = 'dense_illustration' AND has_binary AND artifact_id % 7 > 2
          AND ratio <= 0.7 ORDER BY page_number, artifact_id LIMIT 300)"""


def _requalified(t: Tables) -> tuple[DataFrame, DataFrame]:
    return aj.requalify(boxed(t["b_artifacts"]), t["b_scans"], _classifier, 300, "2024-01-01")


@register("job_requalify", f"""
    WITH {_REQUALIFIED}
    SELECT a.artifact_id, CASE WHEN c.artifact_id IS NULL OR a.artifact_id % 5 = 4 OR a.artifact_id % 2 = 1 THEN artifact_type
                               ELSE 'geometry_vector' END AS artifact_type,
           CASE WHEN c.artifact_id IS NULL OR a.artifact_id % 5 = 4 THEN caption ELSE 'c' || CAST(a.artifact_id AS STRING) END
               AS caption,
           CAST(c.artifact_id IS NOT NULL AND a.artifact_id % 5 <> 4 OR a.artifact_id % 7 = 1 AS INT) AS qualified,
           CAST(c.artifact_id IS NOT NULL AND a.artifact_id % 5 = 4 OR a.artifact_id % 7 = 0 AS INT) AS failed
    FROM @b_artifacts a LEFT JOIN c ON c.artifact_id = a.artifact_id""")
def job_requalify(t: Tables) -> DataFrame:
    updated, _ = _requalified(t)
    has = lambda key: F.get_json_object("render_config_json", f"$.{key}").isNotNull().cast("int")
    return updated.select(
        "artifact_id", "artifact_type", "caption", has("qualified_at").alias("qualified"), has("failed_at").alias("failed")
    )


@register("agg_requalify_report", f"""
    WITH {_REQUALIFIED}
    SELECT CASE WHEN artifact_id % 5 = 4 THEN 'failed' WHEN artifact_id % 2 = 0 THEN 'geometry_vector' ELSE 'dense_illustration' END
           AS new_type, CASE WHEN artifact_id % 5 <> 4 THEN 'illustration' END AS semantic, count(*) AS n FROM c GROUP BY ALL""")
def agg_requalify_report(t: Tables) -> DataFrame:
    return aj.requalify_report(_requalified(t)[1])


_CHILD = """
    e AS (SELECT event_id, event_type, props, value, CAST(event_id % 60 AS DOUBLE) AS ex, CAST(event_id % 45 AS DOUBLE) AS ey,
                 CASE WHEN event_id % 9 = 0 THEN 10.0 ELSE 1.0 END AS unit FROM @events)"""


@register("job_explode_frames", f"""
    WITH f AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h,
                      CASE WHEN artifact_id % 9 = 0 THEN 1000.0 ELSE 100.0 END AS s,
                      CASE WHEN artifact_id % 9 = 0 THEN 10.0 ELSE 1.0 END AS u FROM @b_artifacts WHERE has_binary),
    g AS (SELECT artifact_id, document_id, page_number, x0 AS ox, y0 AS oy, greatest(0, floor(w * (artifact_id % 60) * u / s)) AS a,
                 greatest(0, floor(h * (artifact_id % 45) * u / s)) AS b, least(w, floor(w * (artifact_id % 60 + 41) * u / s)) AS c,
                 least(h, floor(h * (artifact_id % 45 + 56) * u / s)) AS d FROM f)
    SELECT artifact_id AS parent_id, document_id, page_number, ox + a AS x0, oy + b AS y0, ox + c AS x1, oy + d AS y1 FROM g
    WHERE c - a >= 20 AND d - b >= 20""")
def job_explode_frames(t: Tables) -> DataFrame:
    """One detected element per crop, given in percent or per mille."""
    frames = boxed(t["b_artifacts"].where("has_binary")).select("artifact_id", "document_id", "page_number", "bbox")
    unit = F.when(F.col("event_id") % 9 == 0, 10.0).otherwise(1.0)
    col = lambda base, add: ((F.col("event_id") % base + add) * unit)
    elements = t["events"].select(
        F.col("event_id").alias("frame_id"), F.lit(0).alias("element_no"), first_json(F.expr(_ANSWER)).alias("answer"),
        col(60, 0).alias("x0"), col(45, 0).alias("y0"), col(60, 41).alias("x1"), col(45, 56).alias("y1"),
    )
    children = aj.explode_elements(frames, elements)
    return children.select("parent_id", "document_id", "page_number", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@register("job_merge_boxes")
def job_merge_boxes(t: Tables) -> DataFrame:
    """Regions of every page from its artifact boxes (an iterative merge)."""
    boxes = t["b_artifacts"].select(
        "document_id", "page_number", F.col("artifact_id").alias("box_no"), "x0", "y0",
        (F.col("x0") + (F.col("x1") - F.col("x0")) / 6).alias("x1"), (F.col("y0") + (F.col("y1") - F.col("y0")) / 6).alias("y1"),
        (F.col("artifact_type") == "data_table").alias("is_text"), F.lit(2480).alias("width_px"), F.lit(3508).alias("height_px"),
    )
    return layout_boxes.merge_boxes(boxes)


@register("job_anchor_artifacts", """
    SELECT count(*) AS chunks, count(*) FILTER (WHERE document_id IN (SELECT user_id FROM @events)
           AND page_number IN (1, 2)) AS anchored FROM @v_chunks""")
def job_anchor_artifacts(t: Tables) -> DataFrame:
    """Artifacts of the first two pages anchored in the text of those pages."""
    media = boxed(t["b_artifacts"]).withColumn("page_number", (1 + F.col("artifact_id") % 2).cast("int"))
    scans = t["v_chunks"].select("document_id", "page_number", F.lit(3508).alias("height_px"))
    text = aj.anchor_artifacts(t["v_chunks"], media.select("document_id", "page_number", "artifact_id", "caption", "bbox"), scans)
    return text.agg(
        F.count("*").alias("chunks"), count_if(F.col("content_markdown").contains("asset://artifacts/")).alias("anchored")
    )
