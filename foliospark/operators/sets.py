"""Unions and differences of corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def index_rows(chunks: DataFrame, artifacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the search index: one per chunk and one per artifact.  An
    artifact shows its caption as section and inherits its chunk's type."""
    titles = documents.select("document_id", "title")
    none = F.lit(None).cast("string")
    from_chunks = chunks.join(titles, "document_id", "left").select(
        "corpus", F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("row_id"),
        "chunk_id", none.alias("artifact_id"), "document_id", "page_number", "title", "section_title",
        "pedagogical_type", F.col("content_markdown").alias("search_content"),
    )
    kinds = chunks.select("chunk_id", "pedagogical_type")
    text = F.concat(F.coalesce("searchable_text", F.lit("")), F.lit(" "), F.coalesce("raw_data", F.lit("")))
    from_artifacts = (
        artifacts.join(kinds, "chunk_id", "left").join(titles, "document_id", "left").select(
            "corpus", F.concat(F.lit("a"), F.col("artifact_id").cast("string")).alias("row_id"),
            "chunk_id", F.col("artifact_id").cast("string").alias("artifact_id"), "document_id", "page_number",
            "title", F.col("caption").alias("section_title"), "pedagogical_type", text.alias("search_content"),
        )
    )
    return from_chunks.unionByName(from_artifacts)


def unprotected(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks whose place is not held by a human-edited row."""
    held = existing.where("is_human_edited").select("document_id", "page_number", "chunk_index")
    return new.join(held, ["document_id", "page_number", "chunk_index"], "left_anti")


def pages_of(requests: DataFrame) -> DataFrame:
    """One row per page of each requested interval."""
    return requests.select(
        "*", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_number")
    ).where("page_start <= page_end")


def pages_to_do(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested pages minus READY ones."""
    ready = jobs.where("status = 'READY'").select("document_id", "page_number")
    return pages.join(ready, ["document_id", "page_number"], "left_anti")


def manifest_items(pages: DataFrame, media: DataFrame, term: Column | None = None) -> DataFrame:
    """Book pages and exam media in one listing, of one term if asked."""
    book = pages.select(
        F.lit("page").alias("kind"), F.col("document_id").cast("string").alias("owner_id"),
        F.col("page_number").cast("string").alias("item"), "term_id",
    )
    exam = media.select(
        F.lit("exam").alias("kind"), F.col("assessment_id").cast("string").alias("owner_id"),
        F.concat_ws(":", "role", F.col("artifact_id").cast("string")).alias("item"), "term_id",
    )
    both = book.unionByName(exam)
    return both if term is None else both.where(F.col("term_id") == term)


def ingested_paths(documents: DataFrame) -> DataFrame:
    return documents.select("source_path").distinct()
