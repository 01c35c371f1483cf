"""The work ledger: which page of which document is in which state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.sets import pages_of, pages_to_do
from foliospark.plans.curriculum import key_id
from foliospark.schema import TRANSIENT_STATUSES

MAX_RETRY = 3


def recover(jobs: DataFrame) -> DataFrame:
    """After a stop: transient states go back to the queue."""
    stuck = F.col("status").isin(*TRANSIENT_STATUSES)
    return jobs.withColumn("status", F.when(stuck, "QUEUED").otherwise(F.col("status")))


def record_outcomes(jobs: DataFrame, outcomes: DataFrame, max_retry: int = MAX_RETRY) -> DataFrame:
    """``outcomes(job_id, ok, error)``: success is READY, failure counts a
    retry and is quarantined at the last one."""
    joined = jobs.join(outcomes.select("job_id", "ok", "error"), "job_id", "left")
    retry = F.col("retry_count") + 1
    failed = ~F.coalesce("ok", F.lit(True))
    status = (
        F.when(F.col("ok"), "READY")
        .when(failed & (retry >= max_retry), "QUARANTINE")
        .when(failed, "QUEUED")
        .otherwise(F.col("status"))
    )
    new = {
        "status": status,
        "retry_count": F.when(failed, retry).otherwise(F.col("retry_count")),
        "error_log": F.when(failed, F.col("error")).otherwise(F.col("error_log")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Manual retry; jobs with an invalid source are refused."""
    marked = jobs.join(ids.select("job_id").distinct().withColumn("_asked", F.lit(True)), "job_id", "left")
    go = F.coalesce("_asked", F.lit(False)) & (F.col("status") != "INVALID_SOURCE")
    new = {
        "status": F.when(go, "QUEUED").otherwise(F.col("status")),
        "retry_count": F.when(go, 0).otherwise(F.col("retry_count")),
        "error_log": F.when(~go, F.col("error_log")),
    }
    return marked.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def refused(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    known = jobs.where("status <> 'INVALID_SOURCE'").select("job_id")
    return ids.select("job_id").distinct().join(known, "job_id", "left_anti")


def cancel(jobs: DataFrame, batch_id: str) -> DataFrame:
    """Queued jobs of the batch vanish; finished ones stay."""
    return jobs.where(~((F.col("batch_id") == batch_id) & (F.col("status") == "QUEUED")))


def cancel_batches(batches: DataFrame, batch_id: str) -> DataFrame:
    stop = (F.col("batch_id") == batch_id) & F.col("status").isin("QUEUED", "RUNNING")
    return batches.withColumn("status", F.when(stop, "STOPPED").otherwise(F.col("status")))


def page_interval(requests: DataFrame, documents: DataFrame, toc: DataFrame) -> DataFrame:
    """Pages of each request by mode: the whole document (also for a folder,
    which names its documents), a chapter's range, or a clipped page range."""
    totals = documents.select("document_id", "total_pages")
    entries = toc.select(
        "toc_id", F.col("page_start").alias("_ts"), F.coalesce("page_end", F.lit(None).cast("int")).alias("_te")
    )
    joined = requests.join(totals, "document_id").join(entries, "toc_id", "left")
    mode = F.col("mode")
    start = F.when(mode == "page_range", F.greatest(F.lit(1), F.col("page_start"))).when(
        mode == "chapter", F.col("_ts")
    ).otherwise(1)
    end = F.when(mode == "page_range", F.least("total_pages", "page_end")).when(
        mode == "chapter", F.coalesce("_te", "total_pages")
    ).otherwise(F.col("total_pages"))
    return joined.select(
        "batch_id", "document_id", "mode", start.cast("int").alias("page_start"), end.cast("int").alias("page_end")
    ).where("page_start is not null")


def enqueue(requests: DataFrame, documents: DataFrame, toc: DataFrame, jobs: DataFrame) -> DataFrame:
    """New QUEUED rows: one per requested page that is not READY."""
    pages = pages_of(page_interval(requests, documents, toc))
    todo = pages_to_do(pages, jobs)
    return todo.select(
        key_id("job", F.col("batch_id"), F.col("document_id"), F.col("page_number")).alias("job_id"),
        "batch_id", "document_id", F.col("page_number").cast("int").alias("page_number"),
        F.lit("QUEUED").alias("status"), F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error_log"),
    )


def enqueue_report(requests: DataFrame, documents: DataFrame, toc: DataFrame, jobs: DataFrame) -> DataFrame:
    """pages_total and skipped_ready per batch."""
    spans = page_interval(requests, documents, toc)
    size = F.greatest(F.lit(0), F.col("page_end") - F.col("page_start") + 1)
    total = spans.groupBy("batch_id").agg(F.sum(size).cast("long").alias("pages_total"))
    new = enqueue(requests, documents, toc, jobs).groupBy("batch_id").agg(F.count("*").alias("_new"))
    return total.join(new, "batch_id", "left").select(
        "batch_id", "pages_total", (F.col("pages_total") - F.coalesce("_new", F.lit(0))).alias("skipped_ready")
    )
