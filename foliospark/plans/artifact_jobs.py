"""Re-typing of crops, frame explosion and layout-box post-processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.artifacts import first_json, map_answer
from foliospark.functions.anchoring import anchor_safe
from foliospark.operators.filters import requalify_candidates
from foliospark.plans.chunk_corpus import call_model
from foliospark.plans.curriculum import key_id
from foliospark.session import checkpointed

MIN_SIDE = 20


def mark(config: Column, key: str, value: Column) -> Column:
    """Add a key to a JSON text object."""
    body = F.regexp_replace(F.coalesce(config, F.lit("{}")), r"\}\s*$", "")
    pair = F.concat(F.lit(f'"{key}": "'), value, F.lit('"}'))
    return F.concat(body, F.when(body.rlike(r"\{\s*$"), "").otherwise(", "), pair)


def requalify(
    artifacts: DataFrame, scans: DataFrame, fn: Callable[[str], str | None], limit: int, stamp: str,
    retry_failed: bool = False, key: str = "artifact_id",
) -> tuple[DataFrame, DataFrame]:
    """Ask the classifier about the candidates and merge its answers.

    Returns the updated artifacts and one report row per candidate.  ``fn``
    maps an artifact id to the model's text; it never stops the job.
    """
    todo = requalify_candidates(artifacts, scans, limit, retry_failed).select(F.col(key).alias("_id"))
    # The limit leaves one partition; model calls are dealt out again, and the
    # answers are kept so that no candidate is asked twice.
    tasks = max(1, min(limit, artifacts.sparkSession.sparkContext.defaultParallelism))
    asked = checkpointed(call_model(todo.repartition(tasks, "_id"), fn, F.col("_id").cast("string"), "_text"))
    answer = asked.select("_id", map_answer(first_json("_text")).alias("_a"))
    merged = artifacts.join(answer.withColumn("_asked", F.lit(True)), F.col(key) == F.col("_id"), "left")
    asked_, ok = F.coalesce("_asked", F.lit(False)), F.col("_a").isNotNull()
    config = F.coalesce("_a.render_config_json", "render_config_json")
    new = {
        "artifact_type": F.coalesce("_a.artifact_type", "artifact_type"),
        "raw_data": F.coalesce("_a.raw_data", "raw_data"),
        "caption": F.coalesce("_a.caption", "caption"),
        "searchable_text": F.coalesce("_a.searchable_text", "searchable_text"),
        "render_config_json": F.when(asked_ & ok, mark(config, "qualified_at", F.lit(stamp)))
        .when(asked_, mark(F.col("render_config_json"), "failed_at", F.lit(stamp)))
        .otherwise(F.col("render_config_json")),
    }
    updated = merged.select(*[new.get(c, F.col(c)).alias(c) for c in artifacts.columns])
    report = answer.select(
        F.col("_id").alias(key),
        F.coalesce("_a.artifact_type", F.when(F.col("_a").isNull(), "failed").otherwise("dense_illustration")).alias("new_type"),
        F.col("_a.semantic").alias("semantic"),
    )
    return updated, report


def requalify_report(report: DataFrame) -> DataFrame:
    return report.groupBy("new_type", "semantic").agg(F.count("*").alias("n"))


def explode_elements(frames: DataFrame, elements: DataFrame, max_elements: int | None = None) -> DataFrame:
    """Children of full-page frames from a table of detected elements.

    ``elements(frame_id, element_no, answer, x0, y0, x1, y1)`` gives relative
    positions in percent or per mille.  All elements of a frame stay unless
    ``max_elements`` names how many of its first ones to take.
    """
    scale = F.when(F.greatest("x0", "y0", "x1", "y1") > 100, 1000.0).otherwise(100.0)
    placed = (
        (elements if max_elements is None else elements.where(F.col("element_no") < max_elements))
        .join(frames, elements["frame_id"] == frames["artifact_id"])
        .withColumn("_s", scale)
        .withColumn("_w", F.col("bbox.x1") - F.col("bbox.x0"))
        .withColumn("_h", F.col("bbox.y1") - F.col("bbox.y0"))
    )
    whole = lambda side, c: F.floor(F.col(side) * F.col(c) / F.col("_s")).cast("double")
    boxed = (
        placed.withColumn("_x0", F.greatest(F.lit(0.0), whole("_w", "x0")))
        .withColumn("_y0", F.greatest(F.lit(0.0), whole("_h", "y0")))
        .withColumn("_x1", F.least(F.col("_w"), whole("_w", "x1")))
        .withColumn("_y1", F.least(F.col("_h"), whole("_h", "y1")))
        .where((F.col("_x1") - F.col("_x0") >= MIN_SIDE) & (F.col("_y1") - F.col("_y0") >= MIN_SIDE))
        .withColumn("_a", map_answer(F.col("answer")))
    )
    kind = F.coalesce("_a.artifact_type", F.lit("dense_illustration"))
    corner = lambda off, c: (F.col(f"bbox.{off}") + F.col(c)).alias(c[1:])
    return boxed.select(
        key_id("element", F.col("frame_id"), F.col("element_no")).alias("artifact_id"),
        "document_id", "page_number", F.col("frame_id").alias("parent_id"),
        kind.alias("artifact_type"), F.col("_a.raw_data").alias("raw_data"), F.col("_a.caption").alias("caption"),
        F.coalesce("_a.caption", kind).alias("searchable_text"), F.col("_a.semantic").alias("semantic"),
        F.struct(corner("x0", "_x0"), corner("y0", "_y0"), corner("x0", "_x1"), corner("y0", "_y1")).alias("bbox"),
    )


def mark_exploded(artifacts: DataFrame, frames: DataFrame, stamp: str) -> DataFrame:
    done = frames.select("artifact_id").distinct().withColumn("_done", F.lit(True))
    joined = artifacts.join(done, "artifact_id", "left")
    fresh = F.coalesce("_done", F.lit(False)) & F.get_json_object("render_config_json", "$.exploded_at").isNull()
    config = F.when(fresh, mark(F.col("render_config_json"), "exploded_at", F.lit(stamp))).otherwise(
        F.col("render_config_json")
    )
    return joined.select(*[config.alias(c) if c == "render_config_json" else F.col(c) for c in artifacts.columns])


def anchor_artifacts(chunks: DataFrame, artifacts: DataFrame, scans: DataFrame) -> DataFrame:
    """Anchor each artifact of a page in the page's first chunk, one artifact
    after another in reading order, never inside a math block."""
    page = ["document_id", "page_number"]
    marks = artifacts.groupBy(*page).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), F.col("artifact_id").alias("id"), "caption"
        ))).alias("_marks")
    )
    first = chunks.groupBy(*page).agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("_first"))
    joined = (
        chunks.join(first, page)
        .join(marks, page, "left")
        .join(scans.select(*page, F.col("height_px").alias("_h")), page, "left")
    )
    text = F.aggregate("_marks", F.col("content_markdown"), lambda t, a: anchor_safe(t, a, F.col("_h")))
    here = (F.col("chunk_id") == F.col("_first")) & F.col("_marks").isNotNull()
    return joined.select(*[
        F.when(here, text).otherwise(F.col(c)).alias(c) if c == "content_markdown" else F.col(c)
        for c in chunks.columns
    ])
