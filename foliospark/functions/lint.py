"""Deterministic quality checks, each an ``array<struct<error_type,details,severity>>``."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from foliospark.functions.text import occurrences, strip

ERRORS = "array<struct<error_type:string,details:string,severity:string>>"
# Which artifact types get which check.
LATEX_TYPES = ("latex_formula", "matrix", "tensor")
SVG_TYPES = ("geometry_vector", "circuit_schematic", "technical_blueprint")


def _none() -> Column:
    return F.from_json(F.lit("[]"), ERRORS)


def _when(condition: Column, code: str, details: Column, severity: str) -> Column:
    error = F.array(
        F.struct(F.lit(code).alias("error_type"), details.alias("details"), F.lit(severity).alias("severity"))
    )
    return F.when(condition, error).otherwise(_none())


def lint_latex(c: Column) -> Column:
    opening, closing = occurrences(c, "{"), occurrences(c, "}")
    begins = F.regexp_extract_all(c, F.lit(r"(?U)\\begin\{(\w+)\}"), F.lit(1))
    ends = F.regexp_extract_all(c, F.lit(r"(?U)\\end\{(\w+)\}"), F.lit(1))
    times = lambda names, name: F.size(F.filter(names, lambda x: x == name))
    missing = F.get(F.filter(begins, lambda e: times(begins, e) != times(ends, e)), F.lit(0))
    return F.concat(
        _when(
            opening != closing,
            "UNBALANCED_LATEX",
            F.format_string("unpaired braces (%d opening / %d closing)", opening, closing),
            "ERROR",
        ),
        _when(
            occurrences(F.replace(c, F.lit("$$"), F.lit("")), "$") % 2 == 1,
            "UNBALANCED_LATEX",
            F.lit("unpaired $ delimiter"),
            "ERROR",
        ),
        _when(
            missing.isNotNull(), "UNBALANCED_LATEX",
            F.concat(F.lit("Missing \\end{"), missing, F.lit("}")), "ERROR",
        ),
    )


def lint_table(c: Column) -> Column:
    """Pipe rows of one text must agree on their number of inner pipes."""
    rows = F.filter(F.split(c, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), lambda line: strip(line).startswith("|"))
    widths = F.array_distinct(
        F.transform(rows, lambda r: occurrences(F.btrim(strip(r), F.lit("|")), "|"))
    )
    return F.when(
        c.contains("|"),
        _when(
            (F.size(rows) >= 2) & (F.size(widths) > 1),
            "INVALID_TABLE_DIMENSIONS",
            F.concat(
                F.lit("table rows of different widths: "), F.array_join(F.array_sort(widths).cast("array<string>"), ", ")
            ),
            "WARNING",
        ),
    ).otherwise(_none())


def lint_unicode(c: Column) -> Column:
    share = F.when(F.length(c) > 0, occurrences(c, "\ufffd") / F.length(c)).otherwise(0.0)
    return _when(
        share > 0.05, "UNICODE_NOISE", F.format_string("corrupt character share: %.1f%%", share * 100), "ERROR"
    )


@F.pandas_udf(StringType())
def svg_error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Parser message of a malformed XML text, null for a well-formed one."""

    def message(text):
        if text is None:
            return None
        try:
            ElementTree.fromstring(text)
            return None
        except ElementTree.ParseError as exc:
            return str(exc)

    for batch in batches:
        yield batch.map(message)


def svg_problem(artifact_type: Column, raw: Column) -> Column:
    """SVG sources only reach Python; every other row passes a null."""
    return svg_error(F.when(artifact_type.isin(*SVG_TYPES) & (raw != ""), raw))


def lint_chunk(content: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    return F.concat(lint_unicode(text), lint_table(text))


def lint_artifact(artifact_type: Column, raw_data: Column, needs_vlm: Column, svg_message: Column) -> Column:
    raw = F.coalesce(raw_data, F.lit(""))
    return F.concat(
        F.when(artifact_type.isin(*LATEX_TYPES) & (raw != ""), lint_latex(raw)).otherwise(_none()),
        _when(svg_message.isNotNull(), "MALFORMED_SVG", svg_message, "ERROR"),
        lint_unicode(raw),
        _when(
            F.coalesce(needs_vlm, F.lit(False)), "NEEDS_VLM",
            F.lit("no native extraction for this block"), "ERROR",
        ),
    )


def confidence(
    n_errors: Column, n_warnings: Column, native: Column, blur: Column, content: Column
) -> Column:
    """Heuristic page confidence in [0, 1], two decimals."""
    ocr = ~F.coalesce(native, F.lit(False))
    score = (
        F.lit(1.0)
        - F.least(F.lit(0.5), n_errors * 0.15 + n_warnings * 0.05)
        - F.when(ocr, 0.1).otherwise(0.0)
        - F.when(ocr & (F.coalesce(blur, F.lit(1000.0)) < 80), 0.15).otherwise(0.0)
        - F.when(strip(F.coalesce(content, F.lit(""))) == "", 0.3).otherwise(0.0)
    )
    return F.round(F.greatest(F.lit(0.0), score), 2)
