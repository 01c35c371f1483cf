"""Test tables seen as corpus tables.

Each view is one SELECT that Spark and DuckDB both read; ``@name`` refers to a
base table or another view.  Where the dialects differ, a pair is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.session import tasks_for

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
# Tables whose rows are costly to work on.
TEXT = ("documents", "conversations", "pages", "embeddings")
# Views that group very many rows: the table, and what its rows are dealt out by.
GROUPED = {"b_toc": ("lineitem", ["l_partkey", "CAST(l_quantity AS INT)"])}
S = "CAST({} AS STRING)".format

_HEAD = "substring(replace(text, chr(10), ' '), 1, 40)"

VIEWS: dict[str, str | tuple[str, str]] = {
    # ── text corpus ──
    "v_documents": f"""
        SELECT source AS corpus, doc_id AS document_id, 'doc-' || {S('doc_id')} AS title,
               'doc-' || {S('doc_id')} || '.pdf' AS filename,
               '/sources/' || lang || '/' || source || '/doc-' || {S('doc_id')} || '.pdf' AS source_path,
               CAST(1 + FLOOR(n_chars / 500) AS INT) AS total_pages, n_chars AS file_size_bytes,
               CASE WHEN doc_id % 10 = 0 THEN 'Examen' WHEN doc_id % 10 = 1 THEN 'sujet' ELSE 'manuel' END AS doc_type,
               lang, text AS body, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS created_on
        FROM @documents""",
    "v_rows": """
        SELECT source AS corpus, doc_id AS row_id, doc_id AS chunk_id, text AS search_content FROM @documents""",
    "v_doc_chunks": f"""
        SELECT doc_id AS chunk_id, doc_id AS document_id, 1 AS page_number, lang AS section_title,
               text AS content_markdown, source AS pedagogical_type
        FROM @documents""",
    "v_vectors": f"""
        SELECT 'src' || {S('vec_id % 20')} AS corpus, vec_id AS chunk_id, embedding FROM @embeddings""",
    "v_chunks": f"""
        SELECT 'src' || {S('conv_id % 20')} AS corpus, conv_id * 1000 + turn AS chunk_id, conv_id AS document_id,
               CAST(turn + 1 AS INT) AS page_number, 0 AS chunk_index,
               CASE WHEN role = 'user' THEN {_HEAD} END AS section_title,
               CASE WHEN role = 'user' THEN '## ' || {_HEAD} || chr(10) || chr(10) || text ELSE text END
                   AS content_markdown,
               CASE role WHEN 'user' THEN 'exercise_unsolved' WHEN 'assistant' THEN 'solution_only'
                    ELSE 'course_theory' END AS pedagogical_type,
               CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INT)
                   AS pedagogical_index,
               FALSE AS has_solution, CAST(NULL AS BIGINT) AS linked_solution_chunk_id,
               (conv_id % 7 = 0) AS is_human_edited
        FROM @conversations""",
    # ── structured corpus, larger ──
    "b_documents": f"""
        SELECT 'src' || {S('c_custkey % 25')} AS corpus, c_custkey AS document_id, c_name AS title,
               60 AS total_pages,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Sujet' WHEN 'MACHINERY' THEN 'examen' ELSE 'manuel' END
                   AS doc_type
        FROM @customer""",
    "b_chunks": f"""
        SELECT 'src' || {S('o_custkey % 25')} AS corpus, o_orderkey AS chunk_id, o_custkey AS document_id,
               CAST(1 + (o_orderkey * 7) % 50 AS INT) AS page_number, CAST(o_orderkey % 3 AS INT) AS chunk_index,
               CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS section_title,
               CASE o_orderkey % 8 WHEN 0 THEN 'course_theory' WHEN 1 THEN 'proof_demonstration'
                    WHEN 2 THEN 'exercise_unsolved' WHEN 3 THEN 'exercise_solved' WHEN 4 THEN 'solution_only'
                    WHEN 5 THEN 'evaluation_exam' WHEN 6 THEN 'practical_work' END AS pedagogical_type,
               CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 5 + 1 AS INT) END AS pedagogical_index,
               (o_orderkey % 8 = 3) AS has_solution,
               CASE WHEN o_orderkey % 40 = 3 THEN o_orderkey + 1 END AS linked_solution_chunk_id,
               (o_orderkey % 11 = 0) AS is_human_edited, CAST(o_orderkey % 512 AS INT) AS token_count
        FROM @orders""",
    "b_toc": """
        SELECT l_partkey AS document_id, l_partkey * 100 + CAST(l_quantity AS INT) AS toc_id,
               CAST(NULL AS BIGINT) AS parent_id,
               CASE WHEN MIN(l_linenumber) <= 2 THEN 1 WHEN MIN(l_linenumber) <= 4 THEN 2 ELSE 3 END AS level,
               MIN(l_returnflag) || MIN(l_linestatus) AS title, CAST(l_quantity AS INT) AS page_start,
               CASE WHEN (l_partkey + CAST(l_quantity AS INT)) % 5 = 0 THEN NULL
                    ELSE CAST(CAST(l_quantity AS INT) + l_partkey % 13 AS INT) END AS page_end,
               CAST((CAST(l_quantity AS INT) * 7) % 53 AS BIGINT) AS ord
        FROM @lineitem GROUP BY l_partkey, CAST(l_quantity AS INT)""",
    "b_scans": """
        SELECT DISTINCT o_custkey AS document_id, CAST(1 + (o_orderkey * 7) % 50 AS INT) AS page_number,
               2480 AS width_px, 3508 AS height_px
        FROM @orders""",
    "b_artifacts": f"""
        SELECT 'src' || {S('user_id % 25')} AS corpus, event_id AS artifact_id, user_id AS document_id,
               CAST(1 + event_id % 50 AS INT) AS page_number,
               CASE WHEN event_id % 4 > 0 THEN event_id + 1 END AS chunk_id,
               CASE event_type WHEN 'click' THEN 'math' WHEN 'view' THEN 'physics' ELSE 'general' END AS domain,
               CASE event_type WHEN 'click' THEN 'latex_formula' WHEN 'view' THEN 'data_table'
                    WHEN 'purchase' THEN 'geometry_vector' ELSE 'dense_illustration' END AS artifact_type,
               CASE WHEN event_type IN ('click', 'view', 'purchase') THEN props END AS raw_data,
               event_type IN ('error', 'signup', 'purchase') AS has_binary,
               CASE WHEN event_id % 3 = 0 THEN 'fig ' || {S('event_id')} END AS caption,
               event_type || ' ' || props AS searchable_text,
               '{{"renderer": "openseadragon"' || CASE event_id % 7 WHEN 0 THEN ', "failed_at": "t"'
                    WHEN 1 THEN ', "qualified_at": "t"' WHEN 2 THEN ', "exploded_at": "t"' ELSE '' END || '}}'
                   AS render_config_json,
               CAST(event_id % 100 AS DOUBLE) AS x0, CAST(event_id % 200 AS DOUBLE) AS y0,
               CAST(event_id % 100 + 100 + (event_id * 37) % 2400 AS DOUBLE) AS x1,
               CAST(event_id % 200 + 100 + (event_id * 53) % 3400 AS DOUBLE) AS y1,
               (event_id % 13 = 0) AS is_human_edited
        FROM @events""",
    "b_terms": f"""
        SELECT 't' || {S('r_regionkey')} AS term_id, r_regionkey AS term_index, r_name AS label FROM @region""",
    "b_programs": f"""
        SELECT 'p' || {S('n_nationkey')} AS program_id, 't' || {S('n_regionkey')} AS term_id, n_name AS title
        FROM @nation""",
    "b_links": f"""
        SELECT 'pt' || {S('n_nationkey')} AS link_id, 'program_term' AS link_type,
               'p' || {S('n_nationkey')} AS from_id, 't' || {S('n_regionkey')} AS to_id FROM @nation
        UNION ALL
        SELECT 'cp' || {S('c_custkey')}, 'course_program', 'c' || {S('c_custkey')}, 'p' || {S('c_nationkey')}
        FROM @customer
        UNION ALL
        SELECT 'ce' || {S('o_orderkey')}, 'course_exercise', 'c' || {S('o_custkey')}, 'e' || {S('o_orderkey')}
        FROM @orders""",
    "b_edges": f"""
        SELECT 's' || {S('o_orderkey')} AS link_id, 'course_exercise' AS link_type,
               CASE WHEN o_orderkey % 2 = 0 THEN {S('o_orderkey')} ELSE {S('o_orderkey + 9')} END AS from_id,
               CASE WHEN o_orderkey % 2 = 0 THEN {S('o_orderkey + 2')} ELSE {S('o_orderkey')} END AS to_id
        FROM @orders""",
    "b_assessments": f"""
        SELECT 'a' || {S('s_suppkey')} AS assessment_id, 't' || {S('s_nationkey % 5')} AS term_id,
               s_suppkey * 3 AS subject_chunk_id, s_suppkey * 5 + 1 AS correction_chunk_id
        FROM @supplier""",
    "b_courses": f"""
        SELECT 'c' || {S('c_custkey')} AS course_id, 'p' || {S('c_nationkey')} AS program_id,
               't' || {S('c_nationkey % 7')} AS term_id, c_name AS course_title, c_custkey % 40 AS page_start,
               c_custkey % 40 + c_nationkey % 9 AS page_end, c_custkey % 50 AS book_id,
               CAST(c_nationkey % 3 + 1 AS INT) AS term
        FROM @customer""",
    "b_exercises": f"""
        SELECT 'e' || {S('o_orderkey')} AS exercise_id, 'c' || {S('o_custkey')} AS course_id,
               o_orderstatus AS state
        FROM @orders""",
    "b_subjects": f"""
        SELECT 't' || {S('r_regionkey')} AS subject_id, r_name AS subject_name FROM @region""",
    # ── operations ──
    "v_benchmarks": """
        SELECT user_id AS document_id, CAST(event_id % 500 AS INT) AS page_number, event_id, event_type,
               value AS execution_time_ms, (event_type = 'error') AS fallback_triggered,
               CASE WHEN event_type = 'purchase' THEN 'provider' END AS vlm_provider_used,
               CAST(event_id % 100 AS DOUBLE) / 100 AS confidence_score,
               CAST(100 + event_id % 400 AS DOUBLE) AS ram_peak_mb, ts AS created_at
        FROM @events""",
    "v_jobs": f"""
        SELECT 'src' || {S('o_custkey % 25')} AS corpus, o_orderkey AS job_id, o_custkey AS document_id,
               CAST(1 + (o_orderkey * 7) % 50 AS INT) AS page_number,
               CASE o_orderstatus WHEN 'F' THEN 'READY'
                    WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'EXTRACTING' ELSE 'QUEUED' END
                    ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'INVALID_SOURCE' ELSE 'QUARANTINE' END END AS status,
               'b' || {S('o_custkey')} AS batch_id, CAST(o_orderkey % 3 AS INT) AS retry_count,
               CASE WHEN o_orderstatus = 'P' THEN 'boom' END AS error_log, o_orderdate AS updated_at
        FROM @orders""",
    "v_batches": f"""
        SELECT 'b' || {S('c_custkey')} AS batch_id FROM @customer""",
    "v_requests": (
        "SELECT user_id AS key, unix_micros(CAST(ts AS TIMESTAMP)) AS micros, event_id AS request_id FROM @events",
        "SELECT user_id AS key, epoch_us(ts) AS micros, event_id AS request_id FROM @events",
    ),
}


class Tables:
    """Base tables and views of one data folder.

    ``tasks`` deals the text tables out to that many partitions, for tables that lie in a single
    input split; without it they are read as they lie.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tasks: int | None = None):
        self.spark, self.sf_dir, self.tasks = spark, sf_dir.rstrip("/"), tasks
        self._prefix = "fs_" + hashlib.md5(self.sf_dir.encode()).hexdigest()[:8] + "_"

    def _register(self, text: str, rows: DataFrame | None = None, suffix: str = "") -> str:
        def name(match: re.Match) -> str:
            table = self._prefix + match.group(1) + suffix
            (rows if suffix else self[match.group(1)]).createOrReplaceTempView(table)
            return table

        return re.sub(r"@(\w+)", name, text)

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return df.repartition(self.tasks) if self.tasks and name in TEXT else df
        view = VIEWS[name]
        if name in GROUPED:
            base, keys = GROUPED[name]
            rows = self[base]
            rows = rows.repartition(tasks_for(self.spark, rows.count()), *map(F.expr, keys))
            return self.spark.sql(self._register(view, rows, f"_{name}"))
        return self.spark.sql(self._register(view if isinstance(view, str) else view[0]))


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def add(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return add


def oracle(text: str) -> str:
    """Stand-alone DuckDB text: the views used become leading CTEs."""
    ctes: dict[str, str] = {}

    def need(body: str) -> str:
        def name(match: re.Match) -> str:
            table = match.group(1)
            if table not in BASE and table not in ctes:
                view = VIEWS[table]
                ctes[table] = need(view if isinstance(view, str) else view[1])
            return table

        return re.sub(r"@(\w+)", name, body)

    body = need(text).strip()
    if not ctes:
        return body
    head = "WITH " + ", ".join(f"{n} AS ({b.strip()})" for n, b in ctes.items())
    if re.match(r"WITH RECURSIVE\s", body):
        return f"WITH RECURSIVE {head[5:]}, {body[15:]}"
    if re.match(r"WITH\s", body):
        return f"{head}, {body[5:]}"
    return f"{head} {body}"
