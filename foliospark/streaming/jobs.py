"""Incremental work as Structured Streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.joins import link_solutions
from foliospark.plans.chunk_corpus import chunk_pages
from foliospark.plans.curriculum import key_id
from foliospark.plans.toc import heading_rows, toc_of_headings
from foliospark.session import scratch
from foliospark.sources.snapshots import Part, Snapshot, Snapshots

PAGES = "document_id string, page_number int, total_pages int, content_markdown string"
HEADINGS = "array<struct<level:int,title:string>>"
# What the contents and the links of a document need of its chunks: no text but its headings.
MARKS = (
    "document_id string, page_number int, total_pages int, chunk_index int, chunk_id string, pedagogical_type string,"
    " pedagogical_index int, headings string"
)
KEPT = ("chunk_index", "chunk_id", "pedagogical_type", "pedagogical_index", "headings")
TOLD = (
    "total_pages int, complete boolean, rows array<struct<page_number:int,chunk_index:int,chunk_id:string,"
    "pedagogical_type:string,pedagogical_index:int,headings:string>>"
)


def run_available(
    stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process what is there, batch by batch, then stop; a restart with the
    same checkpoint resumes after the last committed batch."""
    query = (
        stream.writeStream.foreachBatch(on_batch).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


# ── ingest ─────────────────────────────────────────────────────────────────


def stream_ingest(
    spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, files_per_batch: int = 1000, most_parts: int = 16,
) -> StreamingQuery:
    """New page files become chunks exactly once; contents and solution links follow from the new pages alone.

    The pages that have come are keys in the state store, so a batch reads no sink: its cost does not
    grow with what is stored.  Pages, chunks and jobs of a batch are one commit in ``sink_dir`` (see ``Snapshots``),
    marked with the batch, so a replay after a crash adds nothing.  More than ``most_parts`` small folders of a
    table are joined.  What the contents need of the chunks goes to a queue of files for ``stream_contents``, which
    then runs over them.
    """
    stream = (
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
        .dropDuplicates(["document_id", "page_number"])
    )
    log = Snapshots(spark, sink_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        base = log.load()
        if base.marks.get("ingest", -1) < batch_id:
            pages = log.stage("pages", batch.withColumn("batch", F.lit(batch_id).cast("long")))
            stored = log.read("pages", base, pages[1]) if "pages" in base.schemas else spark.read.schema(
                f"{PAGES}, batch long").parquet(*[f"{log.root}/{p.path}" for p in pages[1]])
            chunks = log.stage("chunks", chunk_pages(stored.drop("total_pages", "batch")).select(
                key_id("chunk", F.col("document_id"), F.col("page_number"), F.col("chunk_index")).alias("chunk_id"), "*",
                F.lit(batch_id).cast("long").alias("batch")))
            done = log.stage("jobs", stored.select("document_id", "page_number", "total_pages", F.lit("READY").alias("status"), "batch"))
            base = log.commit(base, {"pages": pages, "chunks": chunks, "jobs": done}, marks={"ingest": batch_id})
            _queue(log, batch_id, {"chunks": chunks[1], "jobs": done[1]}).write.mode("overwrite").parquet(f"{sink_dir}-marks/batch={batch_id}")
            for table in ("pages", "chunks", "jobs"):
                log.compact(table, most=most_parts)
        else:
            # Committed, but perhaps killed before the queue was written; the reader knows pages it has seen.
            _replayed(batch)
            _queue(log, batch_id).write.mode("overwrite").parquet(f"{sink_dir}-marks/batch={batch_id}")

    query = run_available(stream, checkpoint, on_batch)
    if log.load().version:
        stream_contents(spark, f"{sink_dir}-marks", sink_dir, f"{checkpoint}-contents", files_per_batch, most_parts)
    return query


def _replayed(batch: DataFrame) -> None:
    """Run a batch whose rows are stored already, so that its state is stored too."""
    batch.write.format("noop").mode("overwrite").save()


def _queue(log: Snapshots, batch_id: int, parts: dict[str, list[Part]] | None = None) -> DataFrame:
    """Rows of MARKS for the chunks of one batch, read from its own parts; a page without chunks has a row of its own."""
    own = lambda table: log.read(table, parts=(parts or {}).get(table)).where(F.col("batch") == batch_id).drop("batch")
    chunks = own("chunks").where("content_markdown IS NOT NULL")
    found = heading_rows(chunks).select("document_id", "page_number", "chunk_index", F.to_json("hs").alias("headings"))
    keys = ["document_id", "page_number"]
    marks = chunks.drop("content_markdown").join(found, [*keys, "chunk_index"], "left")
    rows = own("jobs").drop("status").join(marks, keys, "left")
    return rows.select("document_id", "page_number", "total_pages", "chunk_index", "chunk_id", "pedagogical_type", "pedagogical_index", "headings")


def stream_contents(
    spark: SparkSession, marks_dir: str, sink_dir: str, checkpoint: str, files_per_batch: int = 1000, most_parts: int = 16,
) -> StreamingQuery:
    """Contents of the documents a batch touched, and solution links of those whose last page has come in.

    The state of a document is what its pages said of headings, open exercises and solutions, and which pages there
    were; it is updated by new pages alone.  Pages seen before change nothing, so the queue may deliver one twice.
    Tables ``toc`` (newest batch of a document counts) and ``solution_links`` (newest batch too) grow by one
    commit a batch; read files leave the queue.
    """
    rows = (
        spark.readStream.schema(MARKS).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", "delete")
        .option("recursiveFileLookup", "true").parquet(marks_dir)
    )
    # A row travels as one text each way: a frame of many columns for every document costs more than the work on it.
    told = rows.select("document_id", F.to_json(F.struct(*rows.columns[1:])).alias("row")).groupBy("document_id").applyInPandasWithState(
        _remember, "document_id string, told string", "seen string", "append", GroupStateTimeout.NoTimeout)
    told = told.select("document_id", F.from_json("told", TOLD).alias("t")).select(
        "document_id", "t.total_pages", "t.complete", F.explode("t.rows").alias("r")).select(
        *[F.col(c) if c in ("document_id", "total_pages") else F.col(f"r.{c}") for c in rows.columns], "complete")
    log = Snapshots(spark, sink_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        base = log.load()
        if base.marks.get("contents", -1) >= batch_id:
            return _replayed(batch)
        # Read back outside the stream's own session, which fixes all joins and partition counts beforehand.
        path = scratch(spark, "told")
        batch.write.option("compression", "zstd").parquet(path)
        try:
            _contents(log, base, spark.read.schema(batch.schema).parquet(path), batch_id, most_parts)
        finally:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return run_available(told, checkpoint, on_batch)


def _contents(log: Snapshots, base: Snapshot, batch: DataFrame, batch_id: int, most_parts: int) -> None:
    """One commit of the contents and links of the documents in a batch."""
    totals = batch.groupBy("document_id").agg(F.max("total_pages").alias("total_pages"))
    heads = batch.where("headings IS NOT NULL").select(
        "document_id", "page_number", "chunk_index", F.from_json("headings", HEADINGS).alias("hs"))
    mark = F.lit(batch_id).cast("long").alias("batch")
    add = {"toc": log.stage("toc", toc_of_headings(heads, totals).select("*", mark))}
    numbered = batch.where("complete AND chunk_id IS NOT NULL").withColumns(
        {"has_solution": F.lit(False), "linked_solution_chunk_id": F.lit(None).cast("string")})
    linked = link_solutions(numbered).where("linked_solution_chunk_id IS NOT NULL")
    add["solution_links"] = log.stage("solution_links", linked.select("document_id", "chunk_id", "linked_solution_chunk_id", mark))
    log.commit(base, add, marks={"contents": batch_id})
    for table in add:
        # Contents of one batch replace those of the batches before: only the newest are kept.
        log.compact(table, most=most_parts, collapse=lambda df: latest(df, ["document_id"]))


def _remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add the pages of a batch to a document's state and tell all the state holds, if anything is new."""
    seen = json.loads(state.get[0]) if state.exists else {"pages": {}, "total": None}
    new: dict[str, list] = {}
    for frame in frames:
        for row in map(json.loads, frame["row"]):
            page = str(row.get("page_number"))
            if page not in seen["pages"]:
                if row.get("total_pages") is not None:
                    seen["total"] = max(row["total_pages"], seen["total"] or 0)
                kept = [row.get(c) for c in KEPT]
                own = new.setdefault(page, [])
                # Of a chunk, what has neither headings nor a number is not needed again.
                if kept[0] is not None and (row.get("headings") is not None or row.get("pedagogical_index") is not None):
                    own.append(kept)
    if not new:
        return
    seen["pages"].update(new)
    state.update((json.dumps(seen),))
    complete = seen["total"] is not None and len(seen["pages"]) >= seen["total"]
    out = [{"page_number": int(page), **dict(zip(KEPT, chunk, strict=True))}
           for page, chunks in seen["pages"].items() for chunk in chunks or [[None] * len(KEPT)]]
    told = json.dumps({"total_pages": seen["total"], "complete": complete, "rows": out})
    yield pd.DataFrame({"document_id": [key[0]], "told": [told]})


def latest_per_document(spark: SparkSession, sink_dir: str, table: str) -> DataFrame:
    """Rows of the newest batch of each document in a rebuilt table."""
    return latest(Snapshots(spark, sink_dir).read(table), ["document_id"]).drop("batch")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written batch by batch, those of each key's newest batch."""
    newest = updates.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return updates.join(newest, [*keys, "batch"])


# ── feeds ──────────────────────────────────────────────────────────────────


def stream_progress(events: DataFrame) -> DataFrame:
    """Jobs per batch and status, and the latest page seen."""
    return events.groupBy("batch_id", "status").agg(
        F.count("*").alias("n"), F.max_by("page_number", F.struct("updated_at", "page_number")).alias("latest_page")
    )


def stream_throughput(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Mean latency and pages per hour per event-time window."""
    return (
        events.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", window).alias("w"))
        .agg(F.count("*").alias("pages"), F.avg("execution_time_ms").alias("avg_ms"))
        .select(
            F.col("w.start").alias("window_start"), "pages", "avg_ms",
            F.round(F.lit(3.6e6) / F.col("avg_ms")).cast("long").alias("pages_per_hour"),
        )
    )


def decide_requests(requests: DataFrame, per_window: int, seconds: int = 60, lateness: int = 600) -> DataFrame:
    """(key, micros, request_id, allowed) of a stream ``requests(key, micros, request_id)``: at most ``per_window`` accepted ones per window.

    The state of a key is its accepted times, kept in the state store as long as a request could still come that they
    count for: ``seconds`` and ``lateness`` back from its newest.  An event-time timer drops the key after that, so
    idle keys hold nothing, and no batch reads what earlier ones wrote.  Requests of a batch are decided in time order
    on top of what was accepted before, as ``rate_limit`` does.  A request that comes over ``lateness``
    seconds behind the newest of an earlier batch is left to the watermark, which drops it.
    """
    span, delay = seconds * 1_000_000, lateness * 1_000_000
    key, ident = requests.schema["key"].dataType.simpleString(), requests.schema["request_id"].dataType.simpleString()

    def decide(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        asked = pd.concat(list(frames)).sort_values(["micros", "request_id"], kind="stable")
        before = sorted(state.get[0]) if state.exists else []
        times, flags, carried = [], [], 0
        first = 0
        for at in asked["micros"].tolist():
            while carried < len(before) and before[carried] <= at:
                times.append(before[carried])
                carried += 1
            while first < len(times) and at - times[first] > span:
                first += 1
            flags.append(len(times) - first < per_window)
            if flags[-1]:
                times.append(at)
        times += before[carried:]
        mark = state.getCurrentWatermarkMs() * 1000
        newest = max([mark + delay, *times])
        kept = [at for at in times if at > newest - delay - span]
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(kept[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [name[0]] * len(asked), "micros": asked["micros"], "request_id": asked["request_id"], "allowed": flags})

    timed = requests.withColumn("at", F.timestamp_micros("micros")).withWatermark("at", f"{lateness} seconds")
    return timed.groupBy("key").applyInPandasWithState(
        decide, f"key {key}, micros long, request_id {ident}, allowed boolean", "accepted array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_rate_limit(
    requests: DataFrame, sink_dir: str, checkpoint: str, per_window: int, seconds: int = 60, lateness: int = 600,
) -> StreamingQuery:
    """Append the decisions of ``decide_requests`` to a folder; its own log makes each batch appear once and whole."""
    query = (
        decide_requests(requests, per_window, seconds, lateness).writeStream.format("parquet").outputMode("append")
        .option("path", sink_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
