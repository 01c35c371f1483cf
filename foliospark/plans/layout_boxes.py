"""Regions of a page from its layout boxes, by rounds of joins on a page grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from foliospark.session import checkpointed

# Layout limits as shares of the page.
MIN_AREA, MAX_AREA, MAX_ASPECT = 0.005, 0.92, 25.0
MERGE_GAP, MERGE_SMALL, MERGE_COVER, MERGE_SIDE, PAD = 0.012, 0.020, 0.60, 0.12, 0.004

# Grid cells along the longer side of a page.
CELLS = 24
PAGE = ("document_id", "page_number", "width_px", "height_px")
SIDES = ("x0", "y0", "x1", "y1")


def _long_side() -> Column:
    return F.greatest("width_px", "height_px")


def fits() -> Column:
    """Neither a speck nor the page itself nor a thin line."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = wide * high / (F.col("width_px") * F.col("height_px"))
    return (wide > 0) & (high > 0) & share.between(MIN_AREA, MAX_AREA) & (
        F.greatest(wide / high, high / wide) <= MAX_ASPECT)


def _pairs(boxes: DataFrame) -> DataFrame:
    """(page, a, b, overlap): boxes a < b of a page that belong together.

    They overlap, or one is a small fragment within the merge gap of the other, most of one
    side in its shadow, and both together are not yet the page.  Boxes meet in grid cells, each
    widened by the gap, so only near ones are compared.
    """
    gap = F.floor(_long_side() * MERGE_GAP)
    cell = _long_side() / CELLS
    steps = lambda low, high: F.sequence(
        F.floor((F.col(low) - gap) / cell), F.floor((F.col(high) + gap) / cell))
    keys = [*PAGE, "cx", "cy"]
    # A box alone on its page meets none.
    crowded = boxes.groupBy(*PAGE).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    placed = boxes.join(crowded, list(PAGE), "left_semi").withColumn("cx", F.explode(steps("x0", "x1"))).withColumn("cy", F.explode(steps("y0", "y1")))
    left = placed.select(*keys, F.col("no").alias("a"), *[F.col(s).alias(f"a{s}") for s in SIDES])
    right = placed.select(*keys, F.col("no").alias("b"), *[F.col(s).alias(f"b{s}") for s in SIDES])
    met = left.join(right, keys).where("a < b")
    side = lambda box, axis: F.col(f"{box}{axis}1") - F.col(f"{box}{axis}0")
    shared = {d: F.least(F.col(f"a{d}1"), F.col(f"b{d}1")) - F.greatest(F.col(f"a{d}0"), F.col(f"b{d}0")) for d in "xy"}
    span = {d: F.greatest(F.col(f"a{d}1"), F.col(f"b{d}1")) - F.least(F.col(f"a{d}0"), F.col(f"b{d}0")) for d in "xy"}
    page = F.col("width_px") * F.col("height_px")

    def small(box: str) -> Column:
        wide, high = side(box, "x"), side(box, "y")
        return (wide * high < MERGE_SMALL * page) & (F.greatest(wide, high) <= MERGE_SIDE * _long_side())

    def shadowed(box: str) -> Column:
        return F.greatest(*[shared[d] / F.greatest(F.lit(1.0), side(box, d)) for d in "xy"]) >= MERGE_COVER

    overlap = F.least(shared["x"], shared["y"]) > 0
    near = (F.least(shared["x"], shared["y"]) >= -gap) & (span["x"] * span["y"] <= MAX_AREA * page)
    # The lower-numbered small box is the fragment.
    fragment = F.when(small("a"), shadowed("a")).when(small("b"), shadowed("b")).otherwise(False)
    return met.where(overlap | (near & fragment)).select(*PAGE, "a", "b", overlap.alias("overlap")).distinct()


def _steps(pairs: DataFrame) -> DataFrame:
    """(page, no, target): the merges of one round.

    A box without a lower-numbered partner takes the boxes that overlap it and have no lower partner
    than it; if none does, it takes the first fragment.  What waits gets its turn on the grown boxes.
    """
    key = ["document_id", "page_number"]
    lowest = pairs.groupBy(*key, "b").agg(F.min("a").alias("a"))
    roots = lowest.select(*key, F.col("b").alias("a")).distinct()
    own = pairs.join(lowest, [*key, "a", "b"]).join(roots, [*key, "a"], "left_anti")
    turn = own.groupBy(*key, "a").agg(
        F.collect_set(F.when(F.col("overlap"), F.col("b"))).alias("over"), F.min("b").alias("first"))
    taken = F.when(F.size("over") > 0, F.col("over")).otherwise(F.array("first"))
    return turn.select(*key, F.col("a").alias("target"), F.explode(taken).alias("no"))


def merge_boxes(boxes: DataFrame, max_regions: int | None = None) -> DataFrame:
    """Regions of each page from its raw layout boxes, in reading order.

    ``boxes(document_id, page_number, box_no, x0, y0, x1, y1, is_text, width_px, height_px)``.  Equal boxes of a page
    count once.  A region is text when all its boxes are.  ``max_regions`` keeps that many per page,
    figures first; by default all stay.
    """
    state = boxes.where(fits()).groupBy(*PAGE, *SIDES).agg(
        F.min("box_no").cast("long").alias("no"), F.min("is_text").alias("is_text"))
    state, settled = checkpointed(state), []
    while True:
        # The steps read the pairs three times.
        moves = checkpointed(_steps(checkpointed(_pairs(state))))
        if moves.isEmpty():
            break
        # A page without a merge in this round has none in later ones, so only the others go on.
        busy = moves.select("document_id", "page_number").distinct()
        settled.append(state.join(busy, ["document_id", "page_number"], "left_anti"))
        joined = state.join(busy, ["document_id", "page_number"], "left_semi").join(
            moves, ["document_id", "page_number", "no"], "left")
        state = checkpointed(joined.groupBy(*PAGE, F.coalesce("target", "no").alias("no")).agg(
            *[F.min(s).alias(s) for s in SIDES[:2]], *[F.max(s).alias(s) for s in SIDES[2:]], F.min("is_text").alias("is_text")))
    page = Window.partitionBy("document_id", "page_number")
    regions = reduce(DataFrame.unionByName, settled, state).where(fits())
    if max_regions is not None:
        regions = regions.withColumn("_r", F.row_number().over(page.orderBy("is_text", "y0", "x0", "no"))).where(
            F.col("_r") <= max_regions)
    pad = F.floor(_long_side() * PAD)
    return regions.select(
        "document_id", F.col("page_number").cast("int").alias("page_number"),
        (F.row_number().over(page.orderBy("y0", "x0", "no")) - 1).alias("region_no"),
        F.greatest(F.lit(0.0), F.col("x0") - pad).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - pad).alias("y0"),
        F.least(F.col("width_px").cast("double"), F.col("x1") + pad).alias("x1"),
        F.least(F.col("height_px").cast("double"), F.col("y1") + pad).alias("y1"), "is_text")
