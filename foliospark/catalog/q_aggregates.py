"""Aggregates, telemetry and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.catalog.q_text import _LINT, _lint_inputs
from foliospark.catalog.tables import Tables, register
from foliospark.functions.lint import confidence
from foliospark.operators import aggregates as agg
from foliospark.plans.chunk_corpus import lint_pages_table, telemetry_rows


@register("agg_facets", """
    SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM @b_artifacts GROUP BY domain
    UNION ALL SELECT 'artifact_type', artifact_type, count(*) FROM @b_artifacts GROUP BY artifact_type
    UNION ALL SELECT 'pedagogical_type', pedagogical_type, count(*) FROM @b_chunks WHERE pedagogical_type IS NOT NULL
    GROUP BY pedagogical_type""")
def agg_facets(t: Tables) -> DataFrame:
    return agg.facets(t["b_artifacts"], t["b_chunks"])


_METRICS = """
    d AS (SELECT corpus, count(*) AS documents, sum(total_pages)::BIGINT AS pages FROM @b_documents GROUP BY corpus),
    c AS (SELECT corpus, count(*) AS chunks FROM @b_chunks GROUP BY corpus),
    a AS (SELECT corpus, count(*) AS artifacts FROM @b_artifacts GROUP BY corpus),
    jb AS (SELECT corpus, count(*) AS ready_jobs FROM @v_jobs WHERE status = 'READY' GROUP BY corpus),
    m AS (SELECT corpus, coalesce(documents, 0) AS documents, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks,
                 coalesce(artifacts, 0) AS artifacts, coalesce(ready_jobs, 0) AS ready_jobs
          FROM d FULL JOIN c USING (corpus) FULL JOIN a USING (corpus) FULL JOIN jb USING (corpus))"""


def _metrics(t: Tables) -> DataFrame:
    return agg.corpus_metrics(t["b_documents"], t["b_chunks"], t["b_artifacts"], t["v_jobs"])


@register("agg_corpus_metrics", f"WITH {_METRICS} SELECT * FROM m")
def agg_corpus_metrics(t: Tables) -> DataFrame:
    return _metrics(t)


@register("agg_corpus_totals", f"""
    WITH {_METRICS}
    SELECT corpus, sum(documents)::BIGINT AS documents, sum(pages)::BIGINT AS pages, sum(chunks)::BIGINT AS chunks,
           sum(artifacts)::BIGINT AS artifacts, sum(ready_jobs)::BIGINT AS ready_jobs FROM m GROUP BY ROLLUP (corpus)""")
def agg_corpus_totals(t: Tables) -> DataFrame:
    return agg.corpus_totals(_metrics(t))


@register("agg_term_counts", """
    WITH cp AS (SELECT p.term_id, l.from_id AS course FROM @b_links l JOIN @b_programs p ON p.program_id = l.to_id
                WHERE l.link_type = 'course_program'),
    ex AS (SELECT DISTINCT cp.term_id, l.to_id, l.from_id FROM @b_links l JOIN cp ON cp.course = l.from_id
           WHERE l.link_type = 'course_exercise')
    SELECT t.term_id, (SELECT count(*) FROM @b_programs p WHERE p.term_id = t.term_id) AS programs,
           (SELECT count(*) FROM @b_assessments a WHERE a.term_id = t.term_id) AS assessments,
           (SELECT count(DISTINCT course) FROM cp WHERE cp.term_id = t.term_id) AS courses,
           (SELECT count(*) FROM ex WHERE ex.term_id = t.term_id) AS exercises FROM @b_terms t""")
def agg_term_counts(t: Tables) -> DataFrame:
    return agg.term_counts(t["b_terms"], t["b_programs"], t["b_assessments"], t["b_links"])


@register("agg_global_counts", """
    SELECT CASE WHEN (SELECT count(*) FROM @b_toc WHERE level = 1) > 0 THEN (SELECT count(*) FROM @b_toc WHERE level = 1)
                ELSE (SELECT count(*) FROM @b_documents) END AS courses,
           greatest((SELECT count(*) FROM @b_assessments),
                    (SELECT count(*) FROM @b_chunks WHERE pedagogical_type = 'evaluation_exam')) AS assessments,
           (SELECT count(*) FROM @b_chunks WHERE pedagogical_type IN ('exercise_solved', 'exercise_unsolved')) AS exercises,
           (SELECT count(*) FROM @b_chunks WHERE pedagogical_type = 'solution_only') AS solutions,
           (SELECT count(*) FROM @b_scans) AS scans, (SELECT count(*) FROM @b_toc WHERE level = 1) AS chapters""")
def agg_global_counts(t: Tables) -> DataFrame:
    return agg.global_counts(t["b_documents"], t["b_toc"], t["b_chunks"], t["b_assessments"], t["b_scans"])


@register("agg_page_manifest", """
    WITH m AS (SELECT p.document_id, p.page_number, r.toc_id, r.title,
                      row_number() OVER (PARTITION BY p.document_id, p.page_number ORDER BY r.page_start DESC) AS k
               FROM @b_scans p JOIN @b_toc r ON p.document_id = r.document_id
                    AND p.page_number BETWEEN r.page_start AND coalesce(r.page_end, 1000000000) WHERE r.level = 1),
    x AS (SELECT document_id, page_number, count(*) AS n FROM @b_chunks
          WHERE pedagogical_type IN ('exercise_solved', 'exercise_unsolved') GROUP BY ALL)
    SELECT p.document_id, p.page_number, width_px, height_px, m.toc_id AS chapter_id, m.title AS chapter_title,
           coalesce(x.n, 0) AS exercises_count
    FROM @b_scans p LEFT JOIN m ON m.document_id = p.document_id AND m.page_number = p.page_number AND k = 1
    LEFT JOIN x ON x.document_id = p.document_id AND x.page_number = p.page_number""")
def agg_page_manifest(t: Tables) -> DataFrame:
    return agg.page_manifest(t["b_scans"], t["b_toc"], t["b_chunks"])


@register("agg_benchmarks", """
    SELECT round(avg(execution_time_ms), 1) AS avg_latency_ms, round(avg(confidence_score), 3) AS avg_confidence,
           round(avg(ram_peak_mb), 1) AS avg_ram_mb,
           round(avg(CASE WHEN vlm_provider_used IS NOT NULL THEN 1.0 ELSE 0 END), 3) AS vlm_rate,
           round(avg(CASE WHEN fallback_triggered THEN 1.0 ELSE 0 END), 3) AS fallback_rate FROM @v_benchmarks""")
def agg_benchmarks(t: Tables) -> DataFrame:
    return agg.telemetry_averages(t["v_benchmarks"])


@register("agg_batch_progress", """
    SELECT b.batch_id, count(*) FILTER (WHERE status = 'READY') AS ready, count(job_id) AS total,
           count(DISTINCT document_id) AS documents,
           CAST(count(*) FILTER (WHERE status = 'READY') = count(job_id) AS INT) AS success
    FROM @v_batches b LEFT JOIN @v_jobs jb ON jb.batch_id = b.batch_id GROUP BY b.batch_id""")
def agg_batch_progress(t: Tables) -> DataFrame:
    return agg.batch_progress(t["v_batches"], t["v_jobs"]).withColumn("success", F.col("success").cast("int"))


@register("agg_queue_state", """
    SELECT count(*) FILTER (WHERE status = 'QUEUED') AS queued,
           count(*) FILTER (WHERE status = 'READY' AND CAST(updated_at AS DATE) = (SELECT max(CAST(updated_at AS DATE)) FROM @v_jobs))
           AS ready_today FROM @v_jobs""")
def agg_queue_state(t: Tables) -> DataFrame:
    """"Today" is the last day of the data."""
    today = t["v_jobs"].agg(F.max(F.to_date("updated_at"))).scalar()
    return agg.queue_state(t["v_jobs"], today)


@register("agg_lint_report", _LINT + " SELECT error_type, severity, count(*) AS n FROM e GROUP BY ALL")
def agg_lint_report(t: Tables) -> DataFrame:
    return agg.lint_report(lint_pages_table(*_lint_inputs(t)))


@register("agg_lint_pages", _LINT + """
    SELECT d.doc_id AS document_id, count(e.severity) FILTER (WHERE severity = 'ERROR') AS n_errors,
           count(e.severity) FILTER (WHERE severity = 'WARNING') AS n_warnings, CAST(count(e.severity) = 0 AS INT) AS is_valid,
           CAST(count(e.severity) FILTER (WHERE severity = 'ERROR') = 0 AS INT) AS skip_vlm
    FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id""")
def agg_lint_pages(t: Tables) -> DataFrame:
    pages = agg.lint_pages(lint_pages_table(*_lint_inputs(t)))
    return pages.select(
        "document_id", "n_errors", "n_warnings", F.col("is_valid").cast("int").alias("is_valid"),
        F.col("skip_vlm").cast("int").alias("skip_vlm"),
    )


@register("agg_confidence", """
    SELECT event_id, CAST(round(greatest(0.0, 1.0 - least(0.5, 0.15 * (event_id % 4) + 0.05 * (event_id % 3))
           - CASE WHEN event_type = 'click' THEN 0.0 ELSE 0.1 END
           - CASE WHEN event_type <> 'click' AND value < 80 THEN 0.15 ELSE 0.0 END
           - CASE WHEN event_id % 10 = 0 THEN 0.3 ELSE 0.0 END), 2) AS DOUBLE) AS confidence FROM @events""")
def agg_confidence(t: Tables) -> DataFrame:
    score = confidence(
        F.col("event_id") % 4, F.col("event_id") % 3, F.col("event_type") == "click", F.col("value"),
        F.when(F.col("event_id") % 10 == 0, " ").otherwise("text"),
    )
    return t["events"].select("event_id", score.alias("confidence"))


@register("job_telemetry_rows", _LINT + """
    , n AS (SELECT d.doc_id, count(e.severity) FILTER (WHERE severity = 'ERROR') AS er,
                   count(e.severity) FILTER (WHERE severity = 'WARNING') AS wa
            FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT document_id, 'text' AS engine_used, file_size_bytes AS execution_time_ms,
           CAST(round(greatest(0.0, 1.0 - least(0.5, 0.15 * er + 0.05 * wa) - CASE WHEN lang = 'en' THEN 0.0 ELSE 0.1 END
           - CASE WHEN lang <> 'en' AND file_size_bytes % 200 < 80 THEN 0.15 ELSE 0.0 END
           - CASE WHEN trim(body, ' ' || chr(9) || chr(10)) = '' THEN 0.3 ELSE 0.0 END), 2) AS DOUBLE) AS confidence_score
    FROM @v_documents JOIN n ON n.doc_id = document_id""")
def job_telemetry_rows(t: Tables) -> DataFrame:
    counts = agg.lint_pages(lint_pages_table(*_lint_inputs(t)))
    pages = t["v_documents"].select(
        "document_id", F.lit(1).alias("page_number"), F.lit("text").alias("engine_used"),
        F.col("file_size_bytes").alias("execution_time_ms"), (F.col("lang") == "en").alias("is_native_vector"),
        (F.col("file_size_bytes") % 200).alias("blur_score"), F.lit(0.0).alias("deskew_angle"),
        F.col("body").alias("content_markdown"),
    )
    return telemetry_rows(pages, counts).select("document_id", "engine_used", "execution_time_ms", "confidence_score")


@register("agg_throughput_eta", """
    WITH l AS (SELECT execution_time_ms AS v FROM @v_benchmarks ORDER BY created_at DESC, page_number DESC LIMIT 10),
    a AS (SELECT avg(v) AS m FROM l), n AS (SELECT count(*) AS c FROM @v_benchmarks)
    SELECT round(m, 4) AS avg_ms, CAST(round(3600000 / m) AS BIGINT) AS pages_per_hour,
           greatest(0, 500000 - c) AS remaining, CAST(round(greatest(0, 500000 - c) * m / 1000) AS BIGINT) AS seconds_left
    FROM a, n""")
def agg_throughput_eta(t: Tables) -> DataFrame:
    return agg.throughput_eta(t["v_benchmarks"], 500000, F.current_timestamp()).drop("finish_at")


@register("agg_duplicates", """
    SELECT document_id, page_number, chunk_index, count(*) AS n FROM @b_chunks GROUP BY ALL HAVING count(*) > 1""")
def agg_duplicates(t: Tables) -> DataFrame:
    return agg.duplicates(t["b_chunks"], ["document_id", "page_number", "chunk_index"])


@register("agg_evaluation_groups", """
    WITH s AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index, chunk_id) AS k
               FROM @b_chunks WHERE pedagogical_type = 'evaluation_exam'),
    c AS (SELECT document_id, chunk_id FROM @b_chunks WHERE pedagogical_type = 'solution_only')
    SELECT c.document_id, s.chunk_id AS subject_id, c.chunk_id AS correction_id FROM c
    LEFT JOIN s ON s.document_id = c.document_id AND k = 1
    UNION ALL SELECT document_id, chunk_id, NULL FROM s
    WHERE k > 1 OR NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = s.document_id)""")
def agg_evaluation_groups(t: Tables) -> DataFrame:
    return agg.evaluation_groups(t["b_chunks"])


@register("agg_page_reading_order", """
    SELECT document_id, page_number, chunk_id, chunk_index,
           row_number() OVER (PARTITION BY document_id, page_number ORDER BY chunk_index, chunk_id) AS position FROM @b_chunks""")
def agg_page_reading_order(t: Tables) -> DataFrame:
    return agg.reading_order(t["b_chunks"])


@register("agg_distinct_values", "SELECT DISTINCT artifact_type FROM @b_artifacts")
def agg_distinct_values(t: Tables) -> DataFrame:
    return agg.distinct_values(t["b_artifacts"], "artifact_type")


@register("agg_table_census", """
    WITH c AS (SELECT corpus, 'documents' AS tb FROM @b_documents UNION ALL SELECT corpus, 'chunks' FROM @b_chunks
               UNION ALL SELECT corpus, 'artifacts' FROM @b_artifacts),
    s AS (SELECT corpus, round(sum(file_size_bytes) / 1048576.0, 2) AS size_mb FROM @v_documents GROUP BY ROLLUP (corpus))
    SELECT c.corpus, count(*) FILTER (WHERE tb = 'documents') AS documents, count(*) FILTER (WHERE tb = 'chunks') AS chunks,
           count(*) FILTER (WHERE tb = 'artifacts') AS artifacts, count(*) AS total_rows, count(DISTINCT tb) AS tables,
           any_value(size_mb) AS size_mb
    FROM (SELECT * FROM c UNION ALL SELECT NULL, tb FROM c) c LEFT JOIN s ON s.corpus IS NOT DISTINCT FROM c.corpus
    GROUP BY c.corpus""")
def agg_table_census(t: Tables) -> DataFrame:
    tables = {"documents": t["b_documents"], "chunks": t["b_chunks"], "artifacts": t["b_artifacts"]}
    sizes = t["v_documents"].select("corpus", F.col("file_size_bytes").alias("size_bytes"))
    return agg.table_census(tables, sizes)


_MATRIX = """
    i AS (SELECT term_id, 'course' AS kind, c.course_id AS item_id, coalesce(n, 0) AS exercises FROM @b_courses c
          LEFT JOIN (SELECT course_id, count(*) AS n FROM @b_exercises GROUP BY course_id) x ON x.course_id = c.course_id
          UNION ALL SELECT term_id, 'sequence', program_id, 0 FROM @b_programs
          UNION ALL SELECT term_id, 'assessment', assessment_id, 0 FROM @b_assessments)"""


def _matrix(t: Tables) -> DataFrame:
    counts = t["b_exercises"].groupBy("course_id").agg(F.count("*").alias("exercises_count"))
    courses = t["b_courses"].join(counts, "course_id", "left").withColumn(
        "exercises_count", F.coalesce("exercises_count", F.lit(0))
    )
    return agg.term_matrix(t["b_terms"], courses, t["b_programs"], t["b_assessments"])


@register("agg_term_matrix", f"""
    WITH {_MATRIX} SELECT t.term_id, kind, item_id, CAST(exercises AS BIGINT) AS exercises FROM @b_terms t LEFT JOIN i USING (term_id)""")
def agg_term_matrix(t: Tables) -> DataFrame:
    return _matrix(t)


@register("agg_term_matrix_counts", f"""
    WITH {_MATRIX}
    SELECT t.term_id, count(*) FILTER (WHERE kind = 'course') AS courses, count(*) FILTER (WHERE kind = 'sequence') AS sequences,
           count(*) FILTER (WHERE kind = 'assessment') AS assessments, coalesce(sum(exercises), 0)::BIGINT AS exercises
    FROM @b_terms t LEFT JOIN i USING (term_id) GROUP BY t.term_id""")
def agg_term_matrix_counts(t: Tables) -> DataFrame:
    return agg.term_matrix_counts(_matrix(t))


@register("agg_latency_share", """
    SELECT event_id, round(execution_time_ms / max(execution_time_ms) OVER (PARTITION BY document_id, page_number), 4) AS share
    FROM @v_benchmarks""")
def agg_latency_share(t: Tables) -> DataFrame:
    return agg.latency_share(t["v_benchmarks"]).select("event_id", F.round("share", 4).alias("share"))


@register("top_latency_pages", """
    SELECT event_id, document_id, page_number, execution_time_ms FROM @v_benchmarks
    ORDER BY page_number, document_id, event_id LIMIT 60""")
def top_latency_pages(t: Tables) -> DataFrame:
    """First sixty bench rows in page order."""
    from foliospark.operators.topk import top_k

    first = top_k(t["v_benchmarks"], 60, [F.asc("page_number"), F.asc("document_id"), F.asc("event_id")])
    return first.select("event_id", "document_id", "page_number", "execution_time_ms")
