"""Pages to chunks, lint, repair, telemetry and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.chunking import MAX_TOKENS, enforce_max, pack_units, split_units
from foliospark.functions.classify import PATTERNS, qualify
from foliospark.functions.lint import confidence, lint_artifact, lint_chunk, svg_problem
from foliospark.functions.text import formula_raw, formulas, section_title, token_len

DIMENSIONS = 384


def chunk_pages(
    pages: DataFrame, patterns: list[tuple[str, str]] = PATTERNS, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Narrow job: each page becomes its chunks where it lies, no shuffle.

    The page text is cut once and exploded before classification, so every
    chunk is classified as a row of its own.
    """
    units = enforce_max(split_units(F.col("content_markdown")), max_tokens)
    keys = [c for c in pages.columns if c != "content_markdown"]
    cut = pages.select(
        *keys, section_title(F.col("content_markdown")).alias("section_title"),
        F.posexplode(pack_units(units, max_tokens)).alias("chunk_index", "content_markdown"),
    )
    text = F.col("content_markdown")
    return cut.withColumn("q", qualify(text, patterns)).select(
        *keys, "chunk_index", "section_title", "content_markdown",
        "q.pedagogical_type", "q.pedagogical_index", token_len(text).alias("token_count"),
    )


def formula_artifacts(pages: DataFrame) -> DataFrame:
    """Formulas written in the page text as ``latex_formula`` artifacts."""
    keys = [c for c in pages.columns if c != "content_markdown"]
    found = pages.where(F.col("content_markdown").contains("$")).select(
        *keys, F.explode(formulas(F.col("content_markdown"))).alias("f")
    )
    return found.select(
        *keys,
        F.format_string("md_f%02d", "f.n").alias("block_id_ref"),
        F.lit("math").alias("domain"),
        F.lit("latex_formula").alias("artifact_type"),
        formula_raw(F.col("f.latex"), F.col("f.display")).alias("raw_data"),
        F.concat(
            F.lit('{"renderer": "katex", "displayMode": '), F.col("f.display").cast("string"),
            F.lit(', "throwOnError": false}'),
        ).alias("render_config_json"),
        F.col("f.latex").alias("searchable_text"),
    )


# ── models plugged in as callables ─────────────────────────────────────────


def embed(
    chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "content_markdown",
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``embedding`` of the whole text, or of its first ``max_chars`` for models with a
    window.  ``encoder`` is a picklable factory called once per Python worker; a failing batch
    yields nulls and never stops the job."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = encoder()
        except Exception:
            model = None
        for batch in batches:
            out = [None] * len(batch)
            try:
                if model is not None:
                    out = [np.asarray(v, dtype=np.float32)[:DIMENSIONS] for v in model(list(batch))]
            except Exception:
                out = [None] * len(batch)
            yield pd.Series(out)

    body = F.coalesce(text, F.lit(""))
    passage = body if max_chars is None else F.substring(body, 1, max_chars)
    return chunks.withColumn("embedding", vectors(F.concat(F.lit("passage: "), passage)))


def call_model(df: DataFrame, fn: Callable[[str], str | None], column: Column, name: str) -> DataFrame:
    """Add the answer of a per-text callable; an exception becomes null."""

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def safe(text):
            try:
                return None if text is None else fn(text)
            except Exception:
                return None

        for batch in batches:
            yield batch.map(safe)

    return df.withColumn(name, answers(column))


# ── lint, repair, telemetry ────────────────────────────────────────────────


def lint_pages_table(chunks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All lint errors, one row per checked block: ``errors`` array."""
    from_chunks = chunks.select(
        "document_id", "page_number",
        F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")).alias("block_id_ref"),
        lint_chunk(F.col("content_markdown")).alias("errors"),
    )
    svg = artifacts.withColumn("_svg", svg_problem(F.col("artifact_type"), F.col("raw_data")))
    from_artifacts = svg.select(
        "document_id", "page_number", F.col("block_id_ref").cast("string"),
        lint_artifact(F.col("artifact_type"), F.col("raw_data"), F.col("needs_vlm"), F.col("_svg")).alias("errors"),
    )
    return from_chunks.unionByName(from_artifacts)


def repair(artifacts: DataFrame, fn: Callable[[str], str | None]) -> DataFrame:
    """Send rows with an ERROR to the repair callable; a null answer flags the
    row and keeps its data.  Only those rows reach Python."""
    checked = artifacts.withColumn("_svg", svg_problem(F.col("artifact_type"), F.col("raw_data"))).withColumn(
        "_errors",
        lint_artifact(F.col("artifact_type"), F.col("raw_data"), F.col("needs_vlm"), F.col("_svg")),
    )
    broken = F.exists("_errors", lambda e: e["severity"] == "ERROR")
    good = checked.where(~broken).select(*artifacts.columns, F.lit("valid").alias("repair_state"))
    bad = checked.where(broken).select(*artifacts.columns)
    asked = call_model(bad, fn, F.coalesce("raw_data", F.lit("")), "_answer")
    done = F.col("_answer").isNotNull()
    new = {
        "raw_data": F.coalesce("_answer", "raw_data"),
        "searchable_text": F.coalesce("_answer", "searchable_text"),
    }
    fixed = asked.select(
        *[new.get(c, F.col(c)).alias(c) for c in artifacts.columns],
        F.when(done, "repaired").otherwise("failed").alias("repair_state"),
    )
    return good.unionByName(fixed)


def telemetry_rows(pages: DataFrame, lint_counts: DataFrame) -> DataFrame:
    """One bench row per page; ``lint_counts`` comes from ``lint_pages``."""
    joined = pages.join(
        lint_counts.select("document_id", "page_number", "n_errors", "n_warnings"),
        ["document_id", "page_number"], "left",
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "document_id", "page_number", "engine_used", "execution_time_ms",
        confidence(
            zero("n_errors"), zero("n_warnings"), F.col("is_native_vector"), F.col("blur_score"),
            F.col("content_markdown"),
        ).alias("confidence_score"),
        "blur_score", "deskew_angle",
    )
