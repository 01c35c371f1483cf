"""Range joins (page in [start, end]) as equi-joins.

A range is written as a few cells of a fixed tree over page numbers (fan-out
8): at most 14 cells per level, and as many of the top level as it needs.  A page looks up its one
ancestor per level, so few levels suit books; any number is right.  Both sides meet on (keys, cell), so no pair of a key's
pages and ranges is ever enumerated and a busy document spreads over its
cells.  The best range per cell is picked before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 3  # eight children per cell
LEVELS = 4  # top cells of 512 pages
LEVEL_STEP = 1 << 40  # cells of different levels never share a number


def _cells(lo: Column, hi: Column, level: int) -> Column:
    """Cells lo .. hi-1 of a level, none when there is nothing between."""
    first = level * LEVEL_STEP
    return F.when(lo < hi, F.sequence(lo + first, hi + (first - 1))).otherwise(F.array().cast("array<bigint>"))


def _covered(ranges: DataFrame, start: str, end: str, levels: int) -> DataFrame:
    """Cover each [start, end] by tree cells, one row per (range, cell)."""
    df = ranges.withColumn("_lo", F.col(start).cast("long")).withColumn("_hi", F.col(end).cast("long") + 1)
    parts = []
    for level in range(levels):
        lo, hi = F.col("_lo"), F.col("_hi")
        up, down = F.shiftright(lo + (2**BITS - 1), BITS), F.shiftright(hi, BITS)
        if level == levels - 1:
            parts.append(_cells(lo, hi, level))
            break
        inner = F.concat(
            _cells(lo, F.shiftleft(up, BITS), level), _cells(F.shiftleft(down, BITS), hi, level)
        )
        df = df.select(
            "*", F.when(up <= down, inner).otherwise(_cells(lo, hi, level)).alias(f"_n{level}"),
            F.when(up <= down, up).otherwise(F.lit(0)).alias("_up"),
            F.when(up <= down, down).otherwise(F.lit(0)).alias("_down"),
        ).drop("_lo", "_hi").withColumnsRenamed({"_up": "_lo", "_down": "_hi"})
        parts.append(F.col(f"_n{level}"))
    return df.select(*ranges.columns, F.explode(F.concat(*parts)).alias("cell"))


def _ancestors(point: str, levels: int) -> Column:
    page = F.col(point).cast("long")
    return F.explode(F.array(*[F.shiftright(page, BITS * lv) + lv * LEVEL_STEP for lv in range(levels)]))


def _clipped(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, *columns: Column
             ) -> DataFrame:
    """Ranges cut to the pages there are; a null end is open."""
    last = points.agg(F.max(point).cast("long").alias("m")).scalar()
    return ranges.select(
        *keys, *columns, F.greatest(F.col(start).cast("long"), F.lit(0)).alias("_s"),
        F.least(F.coalesce(F.col(end).cast("long"), last), last).alias("_e"))


def range_counts(
    points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, name: str = "ranges",
    levels: int = LEVELS,
) -> DataFrame:
    """Number of ranges that hold each point, from counts per cell; no pair is listed."""
    cells = _covered(_clipped(points, ranges, keys, point, start, end), "_s", "_e", levels)
    counted = cells.groupBy(*keys, "cell").agg(F.count("*").alias("_n"))
    pages = points.select(*keys, F.col(point).alias("_p")).where("_p is not null").distinct()
    looked = pages.select(*keys, "_p", _ancestors("_p", levels).alias("cell"))
    held = looked.join(counted, [*keys, "cell"]).groupBy(*keys, "_p").agg(F.sum("_n").alias("_n"))
    return points.join(held.withColumnRenamed("_p", point), [*keys, point], "left").select(
        *[points[c] if c not in (*keys, point) else F.col(c) for c in points.columns],
        F.coalesce("_n", F.lit(0)).alias(name))


def range_match(
    points: DataFrame,
    ranges: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    payload: list[str],
    order: list[Column] | None = None,
    pick: str = "first",
    how: str = "left",
    levels: int = LEVELS,
) -> DataFrame:
    """Attach to each point the range that holds it.

    ``pick="first"`` takes the least ``order``, ``"latest"`` the greatest.  A null end is open.
    """
    bounded = _clipped(
        points, ranges, keys, point, start, end, F.struct(*payload).alias("_hit"),
        (F.struct(*order) if order else F.lit(0)).alias("_ord"))
    cells = _covered(bounded, "_s", "_e", levels).select(*keys, "cell", "_hit", "_ord")
    pages = points.select(*keys, F.col(point).alias("_p")).where("_p is not null").distinct()
    looked = pages.select(*keys, "_p", _ancestors("_p", levels).alias("cell"))
    on = [*keys, "cell"]
    edge = F.min if pick == "first" else F.max
    best = cells.groupBy(*on).agg(edge(F.struct("_ord", "_hit")).alias("_best"))
    matched = (
        looked.join(best, on).groupBy(*keys, "_p").agg(edge("_best").alias("_best"))
        .select(*keys, "_p", F.col("_best._hit").alias("_hit"))
    )
    matched = matched.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_p", "_hit")
    condition = points[point] == matched["_p"]
    for k in keys:
        condition = condition & (points[k] == matched[f"_m_{k}"])
    joined = points.join(matched, condition, how)
    return joined.select(*[points[c] for c in points.columns], *[F.col(f"_hit.{c}").alias(c) for c in payload])
