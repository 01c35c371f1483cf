"""Placing artifact anchors in page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliospark.functions.text import once

MARKER = r"(?m)^[ \t]*\[\[FIGURE:(\d+)\]\][ \t]*$"
BREAK = r"\n\n+"


def image(anchor: Column) -> Column:
    return F.concat(
        F.lit("!["), F.coalesce(anchor["caption"], F.lit("")), F.lit("](asset://artifacts/"),
        anchor["id"].cast("string"), F.lit(")"),
    )


def break_offsets(text: Column) -> Column:
    """Start offset of every paragraph break."""
    parts, gaps = F.split(text, BREAK), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))
    # Both lists are arguments, made once; the last part has no gap behind it.
    sizes = F.zip_with(parts, gaps, lambda p, g: F.struct(
        F.length(p).alias("part"), F.coalesce(F.length(g), F.lit(0)).alias("gap"), g.isNotNull().alias("broken")))

    def step(acc: Column, own: Column) -> Column:
        end = acc["at"] + own["part"]
        return F.struct(
            F.when(own["broken"], F.array_append(acc["out"], end)).otherwise(acc["out"]).alias("out"),
            (end + own["gap"]).alias("at"),
        )

    start = F.struct(F.from_json(F.lit("[]"), "array<int>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(sizes, start, step, lambda a: a["out"])


def _nearest(offsets: Column, target: Column) -> Column:
    ranked = F.transform(offsets, lambda o, k: F.struct(F.abs(o - target).cast("double").alias("d"), k.alias("k"), o.alias("o")))
    return F.array_min(ranked)


def anchor_markers(text: Column, anchors: Column) -> Column:
    """``struct<text,rest>``: figure markers replaced by the anchors in order,
    surplus markers removed; ``rest`` holds the anchors without a marker.
    ``anchors`` is ``array<struct<id,caption,y0,x0>>`` in reading order."""
    parts = F.split(text, MARKER)
    joined = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.coalesce(image(F.get(anchors, i - 1)), F.lit("")), p)
            ),
        ),
        "",
    )
    return F.struct(
        joined.alias("text"),
        F.slice(anchors, F.size(parts), F.greatest(F.size(anchors), F.lit(1))).alias("rest"),
    )


def anchor_nearest(text: Column, anchors: Column, page_height: Column) -> Column:
    """Insert each anchor at the paragraph break nearest to its height on the
    page; anchors sharing a break end up in reverse order, as insertion from
    the end of the text leaves them."""
    offsets = break_offsets(text)
    total = F.greatest(F.lit(1), F.length(text))

    def place(a: Column) -> Column:
        ratio = F.when(
            F.coalesce(page_height, F.lit(0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a["y0"] / page_height))
        ).otherwise(0.0)
        return F.struct(
            F.coalesce(_nearest(offsets, ratio * total)["k"], F.lit(0)).alias("k"),
            F.concat(F.lit("\n\n"), image(a), F.lit("\n\n")).alias("text"),
        )

    def build(placed: Column) -> Column:
        at = lambda k: F.array_join(F.reverse(F.transform(F.filter(placed, lambda p: p["k"] == k), lambda p: p["text"])), "")
        parts, gaps = F.split(text, BREAK), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))
        return F.array_join(
            F.transform(parts, lambda p, k: F.concat(p, at(k), F.coalesce(F.get(gaps, k), F.lit("")))), ""
        )

    placed = F.get(F.transform(F.array(F.transform(anchors, place)), build), F.lit(0))
    return F.when(F.size(anchors) > 0, placed).otherwise(text)


def anchor_page(text: Column, anchors: Column, page_height: Column) -> Column:
    """Markers first, then the nearest break for what is left."""
    first = F.array(anchor_markers(text, anchors))
    return F.get(F.transform(first, lambda m: anchor_nearest(m["text"], m["rest"], page_height)), F.lit(0))


def inside_math(text: Column, offset: Column) -> Column:
    head = F.substr(text, F.lit(1), offset)
    display = F.regexp_count(head, F.lit(r"\$\$")) % 2 == 1
    single = F.regexp_count(F.replace(head, F.lit("$$"), F.lit("")), F.lit(r"(?<!\$)\$(?!\$)")) % 2 == 1
    return display | single


def anchor_safe(text: Column, anchor: Column, page_height: Column) -> Column:
    """Idempotent anchoring that never cuts a math block: the break nearest to
    the target, else the safe break nearest to that one, else the end."""
    body = F.coalesce(text, F.lit(""))
    marker = F.concat(F.lit("asset://artifacts/"), anchor["id"].cast("string"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), anchor["y0"] / page_height))

    def choose(o: Column, offsets: Column) -> Column:
        safe = F.filter(offsets, lambda b: ~inside_math(body, b))
        return F.when(~inside_math(body, o), o).otherwise(_nearest(safe, o)["o"])

    def target(offsets: Column) -> Column:
        placeable = (F.coalesce(page_height, F.lit(0)) > 0) & anchor["y0"].isNotNull() & (F.size(offsets) > 0)
        preferred = _nearest(offsets, ratio * F.greatest(F.lit(1), F.length(body)))["o"]
        return F.when(placeable, once(preferred, lambda o: choose(o, offsets)))

    inserted = lambda o: F.concat(
        F.substr(body, F.lit(1), o), F.lit("\n\n"), image(anchor), F.substr(body, o + 1, F.length(body))
    )
    appended = F.when(body == "", image(anchor)).otherwise(F.concat(body, F.lit("\n\n"), image(anchor)))
    placed = once(once(break_offsets(body), target), lambda o: F.when(o.isNull(), appended).otherwise(inserted(o)))
    return F.when(F.contains(body, marker), text).otherwise(placed)
