"""Repeated passages: overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed, text_or_empty

WINDOW = 3
# What is trimmed from the ends of a line; a line of nothing else is blank.
BLANKS = " \t\r\x0b\x0c"


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, own, h1, h2, start, stop): every run of ``width`` lines with words, by a 128-bit hash.

    Lines are compared without blanks (space, tab, carriage return, vertical tab, form feed) at their
    ends; lines of nothing else do not count, so a window may span them.  ``start`` and ``stop`` are its first and last line in the text,
    and ``own``, a hash of the whole text, tells texts of one id apart.
    """
    lines = F.transform(F.split(F.col("text"), "\n"), lambda line, n: F.struct(n.alias("n"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    full = F.filter(lines, lambda x: x["line"] != "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).where(
        F.col("id").isNotNull()).select("id", F.xxhash64("text").alias("own"), full.alias("full"))

    def window(i):
        run = [F.element_at("full", i + n + 1) for n in range(width)]
        return F.struct(
            F.xxhash64(*[x["line"] for x in run]).alias("h1"), F.xxhash64(F.lit(width), *[x["line"] for x in run[::-1]]).alias("h2"),
            run[0]["n"].alias("start"), run[-1]["n"].alias("stop"))

    numbers = F.when(F.size("full") >= width, F.sequence(F.lit(0), F.size("full") - width))
    return rows.select("id", "own", F.explode(F.transform(numbers, window)).alias("w")).select("id", "own", "w.*")


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that occurred before, in an earlier document or higher up in their own; the first by (id, own, start) stays.

    First places combine before their shuffle.  Only repeated windows are joined back, from the
    shared folder, so adaptive execution can split a very common one.
    """
    place = F.struct("id", "own", "start")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = checkpointed(firsts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"))
    met = windows.join(firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return met.where(place != F.col("first")).select("id", "own", "start", "stop")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, text, n_lines, n_removed) per row: lines covered by a later occurrence of a window are removed.

    Covered positions of overlapping windows merge.  The first occurrence, by id and then position,
    stays, unless it is itself covered by another window that came before.  Null text is empty
    text with one line; a text of fewer than ``width`` lines with words keeps all.  Rows that repeat
    an id and its text are one document: they are cut alike.  Other texts of the id are documents of
    their own, in the order of a hash of the text.  A null id names no document and keeps its text.
    An empty table gives no rows; other columns are not read.
    """
    covered = later_windows(line_windows(docs, id_col, text_col, width)).groupBy(F.col("id").alias("c"), F.col("own").alias("o")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                # Windows in order of their starts are in order of their ends too: mark starts and ends and sum.
                steps = np.zeros(len(lines) + 1, dtype=np.int64)
                for cut in cuts or []:
                    steps[cut["start"]] += 1
                    steps[cut["stop"] + 1] -= 1
                keep = np.cumsum(steps)[:-1] == 0
                texts.append("\n".join([x for x, stays in zip(lines, keep, strict=True) if stays]) if cuts else text)
                counts.append(len(lines))
                gone.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                ["id", "text", "n_lines", "n_removed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    met = rows.join(covered, (F.col("id") == F.col("c")) & (F.xxhash64("text") == F.col("o")), "left").select("id", "text", "cuts")
    return met.mapInArrow(run, "id long, text string, n_lines long, n_removed long").withColumnsRenamed(
        {"id": id_col, "text": text_col})
