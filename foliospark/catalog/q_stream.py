"""Streams run to the end of their input and read back, so each has a batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from foliospark.catalog.tables import Tables, register
from foliospark.session import shared_dir
from foliospark.sources.snapshots import Snapshots
from foliospark.streaming import jobs as st


def _stream(t: Tables, table: str) -> DataFrame:
    """A base table as file stream."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/{table}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)


def _run(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """Drain a stream into the shared folder: all its batches, each row with its ``batch``."""
    root = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    st.run_available(
        stream, f"{root}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), mode
    )
    return t.spark.read.schema(schema.add("batch", "long")).parquet(f"{root}/out")


@register("str_progress", """
    SELECT batch_id, status, count(*) AS n, arg_max(page_number, updated_at) AS latest_page FROM
    (SELECT o_orderpriority AS batch_id, o_orderstatus AS status, CAST(o_orderkey AS INT) AS page_number,
            CAST(epoch_us(o_orderdate) AS HUGEINT) * 1000000 + o_orderkey AS updated_at FROM @orders) GROUP BY ALL""")
def str_progress(t: Tables) -> DataFrame:
    events = _stream(t, "orders").select(
        F.col("o_orderpriority").alias("batch_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").cast("int").alias("page_number"), F.col("o_orderdate").alias("updated_at"),
    )
    return st.latest(_run(t, st.stream_progress(events), "update"), ["batch_id", "status"]).drop("batch")


@register("str_throughput", """
    SELECT epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS pages, round(avg(value), 4) AS avg_ms,
           CAST(round(3600000 / avg(value)) AS BIGINT) AS pages_per_hour FROM @events GROUP BY 1""")
def str_throughput(t: Tables) -> DataFrame:
    events = _stream(t, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("execution_time_ms")
    )
    out = st.latest(_run(t, st.stream_throughput(events), "update"), ["window_start"])
    return out.select(
        F.unix_micros("window_start").alias("window_us"), "pages", F.round("avg_ms", 4).alias("avg_ms"), "pages_per_hour"
    )


@register("str_rate_limit", """
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY micros, request_id) AS k FROM @v_requests),
    f AS (SELECT key, k, micros, request_id, [micros] AS acc, TRUE AS allowed FROM o WHERE k = 1
          UNION ALL
          SELECT o.key, o.k, o.micros, o.request_id,
                 CASE WHEN len(list_filter(f.acc, lambda x: o.micros - x <= 3600000000)) < 2
                      THEN list_append(list_filter(f.acc, lambda x: o.micros - x <= 3600000000), o.micros)
                      ELSE list_filter(f.acc, lambda x: o.micros - x <= 3600000000) END,
                 len(list_filter(f.acc, lambda x: o.micros - x <= 3600000000)) < 2
          FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
    SELECT request_id, CAST(allowed AS INT) AS allowed FROM f""")
def str_rate_limit(t: Tables) -> DataFrame:
    requests = _stream(t, "events").select(
        F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.col("event_id").alias("request_id"),
    )
    root = f"{shared_dir(t.spark)}/limit-{uuid.uuid4().hex}"
    st.stream_rate_limit(requests, f"{root}/sink", f"{root}/checkpoint", 2, 3600)
    out = t.spark.read.parquet(f"{root}/sink")
    return out.select("request_id", F.col("allowed").cast("int").alias("allowed"))


def _ingested(t: Tables, text: F.Column | None = None) -> str:
    """All turns written as page files, then ingested by the stream."""
    root = f"{shared_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    totals = t["v_chunks"].groupBy("document_id").agg(F.max("page_number").alias("total_pages"))
    pages = t["v_chunks"].join(totals, "document_id").select(
        F.col("document_id").cast("string").alias("document_id"), "page_number", "total_pages",
        (F.col("content_markdown") if text is None else text).alias("content_markdown"),
    )
    pages.write.parquet(f"{root}/pages")
    st.stream_ingest(t.spark, f"{root}/pages", f"{root}/sink", f"{root}/checkpoint")
    return f"{root}/sink"


@register("str_ingest", """
    SELECT CAST(document_id AS STRING) AS document_id, count(*) AS pages FROM @v_chunks GROUP BY document_id""")
def str_ingest(t: Tables) -> DataFrame:
    jobs = Snapshots(t.spark, _ingested(t)).read("jobs")
    return jobs.groupBy("document_id").agg(F.count("*").alias("pages"))


@register("str_toc_incremental", """
    WITH e AS (SELECT document_id, page_number, trim(regexp_replace(trim(section_title), '\\s+', ' ', 'g'), '*# ')
               AS title FROM @v_chunks WHERE section_title IS NOT NULL AND length(section_title) >= 3),
    n AS (SELECT *, lead(page_number) OVER (PARTITION BY document_id ORDER BY page_number) AS nxt FROM e),
    d AS (SELECT document_id, max(page_number) AS total_pages FROM @v_chunks GROUP BY document_id)
    SELECT CAST(document_id AS STRING) AS document_id, title, page_number AS page_start,
           CAST(coalesce(nxt - 1, total_pages) AS INT) AS page_end FROM n JOIN d USING (document_id)""")
def str_toc_incremental(t: Tables) -> DataFrame:
    toc = st.latest_per_document(t.spark, _ingested(t), "toc")
    return toc.select("document_id", "title", "page_start", "page_end")


@register("str_solution_link", """
    WITH s AS (SELECT document_id, pedagogical_index, min(page_number) AS page FROM @v_chunks
               WHERE pedagogical_type = 'solution_only' AND pedagogical_index > 0 GROUP BY ALL)
    SELECT CAST(c.document_id AS STRING) AS document_id, c.page_number AS exercise_page, s.page AS solution_page
    FROM @v_chunks c JOIN s USING (document_id, pedagogical_index) WHERE c.pedagogical_type = 'exercise_unsolved'""")
def str_solution_link(t: Tables) -> DataFrame:
    """User turns become numbered exercises and assistant turns solutions;
    links are made once a document's last page is in."""
    number = F.col("pedagogical_index").cast("string")
    head = F.when(F.col("pedagogical_type") == "exercise_unsolved", F.concat(F.lit("Exercice n° "), number)).when(
        (F.col("pedagogical_type") == "solution_only") & (F.col("pedagogical_index") > 0),
        F.concat(F.lit("Correction de l'exercice n° "), number),
    ).otherwise("Cours")
    sink = _ingested(t, F.concat(head, F.lit("\n\n"), F.replace(F.col("content_markdown"), F.lit("## "), F.lit(""))))
    links = st.latest_per_document(t.spark, sink, "solution_links")
    page = Snapshots(t.spark, sink).read("chunks").select("chunk_id", "page_number")
    return (
        links.join(page.withColumnRenamed("page_number", "exercise_page"), "chunk_id")
        .join(page.select(F.col("chunk_id").alias("linked_solution_chunk_id"), F.col("page_number").alias("solution_page")),
              "linked_solution_chunk_id")
        .select("document_id", "exercise_page", "solution_page")
    )
