"""Listing filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.artifacts import AREA_RATIO_MAX, area_ratio, raw_area_ratio
from foliospark.operators.joins import with_page_dims
from foliospark.operators.topk import top_k

EXERCISES = ("exercise_solved", "exercise_unsolved")


def type_is(kind: str) -> Column:
    """``exercise`` is a shortcut for both exercise types."""
    return F.col("pedagogical_type").isin(*(EXERCISES if kind == "exercise" else (kind,)))


def filter_chunks(
    chunks: DataFrame, *, document_id=None, page=None, page_from=None, page_to=None,
    pedagogical_type: str | None = None, toc_id=None, has_solution: bool | None = None,
) -> DataFrame:
    """Conjunction of the filters given."""
    if document_id is not None:
        chunks = chunks.where(F.col("document_id") == document_id)
    if page is not None:
        chunks = chunks.where(F.col("page_number") == page)
    if page_from is not None:
        chunks = chunks.where(F.col("page_number") >= page_from)
    if page_to is not None:
        chunks = chunks.where(F.col("page_number") <= page_to)
    if pedagogical_type is not None:
        chunks = chunks.where(type_is(pedagogical_type))
    if toc_id is not None:
        chunks = chunks.where(F.col("toc_id") == toc_id)
    if has_solution is not None:
        chunks = chunks.where(F.col("has_solution") == has_solution)
    return chunks


def filter_artifacts(
    artifacts: DataFrame, scans: DataFrame, *, chunk_id=None, document_id=None, page=None, cap: int | None = None
) -> DataFrame:
    """Artifact listing; tells whether a binary exists without reading it.  ``cap`` keeps the first so many by page."""
    for name, value in (("chunk_id", chunk_id), ("document_id", document_id), ("page_number", page)):
        if value is not None:
            artifacts = artifacts.where(F.col(name) == value)
    listed = artifacts.drop("raw_binary")
    if cap is not None:
        listed = top_k(listed, cap, [F.asc("page_number"), F.asc("artifact_id")])
    dims = with_page_dims(listed, scans)
    return dims.withColumn("area_ratio", area_ratio(F.col("bbox"), F.col("width_px"), F.col("height_px")))


def quarantine(jobs: DataFrame, cap: int | None = None) -> DataFrame:
    """Jobs that stopped for good; ``cap`` keeps the latest so many."""
    bad = jobs.where(F.col("status").isin("QUARANTINE", "INVALID_SOURCE"))
    return bad if cap is None else top_k(bad, cap, [F.desc("updated_at"), F.asc("job_id")])


def content_media(artifacts: DataFrame, ratio: Column) -> DataFrame:
    """Displayable artifacts, near-full-page frames told from primary ones."""
    shown = artifacts.where(F.col("has_binary") | (F.coalesce("raw_data", F.lit("")) != ""))
    return shown.withColumn("placement", F.when(ratio > AREA_RATIO_MAX, "full_page").otherwise("primary"))


def _ratio() -> Column:
    return raw_area_ratio(F.col("bbox"), F.col("width_px"), F.col("height_px"))


def _mark(name: str) -> Column:
    return F.get_json_object("render_config_json", f"$.{name}")


def requalify_candidates(
    artifacts: DataFrame, scans: DataFrame, limit: int, retry_failed: bool = False
) -> DataFrame:
    """Unsorted crops small enough to be figures, first by page.

    Already exploded ones never come back; failed or qualified ones only on
    request.
    """
    todo = artifacts.where(
        (F.col("artifact_type") == "dense_illustration") & F.col("has_binary") & _mark("exploded_at").isNull()
    )
    if not retry_failed:
        todo = todo.where(_mark("failed_at").isNull() & _mark("qualified_at").isNull())
    sized = with_page_dims(todo, scans).withColumn("ratio", _ratio())
    return top_k(sized.where(F.col("ratio") <= AREA_RATIO_MAX), limit, [F.asc("page_number"), F.asc("artifact_id")])


def explode_frames(artifacts: DataFrame, scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Near-full-page crops never exploded before, the first ``limit`` by page when given."""
    todo = artifacts.where(
        (F.col("artifact_type") == "dense_illustration") & F.col("has_binary") & _mark("exploded_at").isNull()
    )
    sized = with_page_dims(todo, scans).withColumn("ratio", _ratio())
    frames = sized.where(F.col("ratio") > AREA_RATIO_MAX)
    return frames if limit is None else top_k(frames, limit, [F.asc("page_number"), F.asc("artifact_id")])


SECTIONS = "struct<terms:array<map<string,string>>,programs:array<map<string,string>>,assessments:array<map<string,string>>,links:array<map<string,string>>>"


def import_sections(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Accept a payload whose known sections are all lists and not all empty."""
    v = F.try_parse_json(text)
    names = ("terms", "programs", "assessments", "links")
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    bad = F.lit(False)
    size = F.lit(0)
    for n in names:
        given = F.try_variant_get(v, f"$.{n}", "variant").isNotNull()
        bad = bad | (given & ~F.coalesce(kind(n).startswith("ARRAY"), F.lit(False)))
        items = F.try_variant_get(v, f"$.{n}", "array<variant>")
        size = size + F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0))
    ok = F.coalesce(v.isNotNull() & ~bad & (size > 0), F.lit(False))
    return payloads.withColumn("rows_found", size).withColumn("accepted", ok)
