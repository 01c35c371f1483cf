"""Markdown tables to cells, and numeric-aware ordering of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.text import strip


def split_row(line: Column) -> Column:
    inner = strip(line)
    inner = F.when(inner.startswith("|"), F.substr(inner, F.lit(2), F.length(inner))).otherwise(inner)
    inner = F.when(inner.endswith("|"), F.substr(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
    return F.transform(F.split(inner, r"\|"), strip)


def md_table(c: Column) -> Column:
    """``struct<headers,rows>`` of a pipe table, rows cut or padded to the
    header width; null when the text is not a table."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda line: line != "")

    def build(ls: Column) -> Column:
        headers = split_row(F.get(ls, F.lit(0)))
        rule = F.forall(split_row(F.get(ls, F.lit(1))), lambda x: x.rlike(r"^:?-+:?$"))
        body = F.filter(F.slice(ls, 3, F.greatest(F.size(ls), F.lit(1))), lambda line: line.contains("|"))
        fit = lambda cells: F.transform(headers, lambda _, i: F.coalesce(F.get(cells, i), F.lit("")))
        rows = F.transform(F.transform(body, split_row), fit)
        ok = (F.size(ls) >= 2) & F.get(ls, F.lit(0)).contains("|") & rule & (F.size(body) > 0)
        return F.when(ok, F.struct(headers.alias("headers"), rows.alias("rows")))

    return F.get(F.transform(F.array(lines), build), F.lit(0))


def cell_number(cell: Column) -> Column:
    """Numeric value of a cell, Arabic decimal and group marks understood."""
    plain = F.translate(F.regexp_replace(cell, r"(?U)\s", ""), "٫٬", ".")
    return F.when(plain == "", 0.0).when(
        plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double")
    )


def table_cells(artifacts: DataFrame, id_col: str = "artifact_id", text_col: str = "raw_data") -> DataFrame:
    """Cells of every table artifact, one row each."""
    parsed = artifacts.select(id_col, md_table(F.col(text_col)).alias("t")).where("t is not null")
    rows = parsed.select(id_col, "t.headers", F.posexplode("t.rows").alias("row_no", "cells"))
    return rows.select(
        id_col, "row_no", F.posexplode("cells").alias("col_no", "cell"), "headers"
    ).select(
        id_col, "row_no", "col_no", F.get("headers", F.col("col_no")).alias("header"), "cell",
        cell_number(F.col("cell")).alias("number"),
    )


def media_list(c: Column) -> Column:
    """Items of a field that holds a JSON array or else a comma list, blanks trimmed."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.split(c, ","))
    return F.transform(items, lambda x: strip(F.coalesce(x, F.lit(""))))


def media_rows(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of the named fields: key, ``kind``, ``label`` (place from 1) and ``item``; empty items keep
    their place and give no row."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), media_list(F.col(c)).alias("items")) for kind, c in fields.items()])
    each = df.select(key, F.explode(kinds).alias("m")).select(key, "m.kind", F.posexplode("m.items").alias("n", "item"))
    return each.where(F.col("item") != "").select(key, "kind", (F.col("n") + 1).alias("label"), "item")
