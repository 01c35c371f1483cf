"""Page text to chunks, as folds over index positions.

The folds carry start positions and character counts only; text is cut and
joined once at the end, so the accumulator stays small for long pages.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliospark.functions.text import occurrences, strip, token_len

MAX_TOKENS = 512
OVERLAP = 0.15

_SPAN = "array<struct<s:int,n:int>>"


def _spans(columns: str) -> Column:
    return F.from_json(F.lit("[]"), _SPAN).alias(columns)


def _parity(c: Column) -> Column:
    return (occurrences(c, "$$") % 2) == 1


def _estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4).cast("int"))


def _cut(parts: Column, spans: Column, separator: str) -> Column:
    return F.transform(spans, lambda p: F.array_join(F.slice(parts, p["s"] + 1, p["n"]), separator))


def _paragraphs(section: Column) -> Column:
    """Paragraphs of one section; those inside an open ``$$`` block stay joined."""
    parts = F.split(section, r"\n\n+")

    def step(acc: Column, part: Column) -> Column:
        opened = acc["odd"] != _parity(part)
        joined = F.when(acc["buf"] == "", part).otherwise(
            strip(F.concat(acc["buf"], F.lit("\n\n"), part))
        )
        return F.struct(
            F.when(opened, acc["out"]).otherwise(F.array_append(acc["out"], joined)).alias("out"),
            F.when(opened, joined).otherwise(F.lit("")).alias("buf"),
            opened.alias("odd"),
        )

    start = F.struct(
        F.from_json(F.lit("[]"), "array<string>").alias("out"), F.lit("").alias("buf"), F.lit(False).alias("odd")
    )
    folded = F.aggregate(
        parts,
        start,
        step,
        lambda a: F.when(a["buf"] != "", F.array_append(a["out"], a["buf"])).otherwise(a["out"]),
    )
    return F.when(section.contains("$$"), folded).otherwise(parts)


def split_units(c: Column) -> Column:
    """Sections at headings, then paragraphs; blank units dropped."""
    sections = F.split(F.coalesce(c, F.lit("")), r"\n(?=##?#?\s)")
    return F.filter(F.flatten(F.transform(sections, _paragraphs)), lambda u: strip(u) != "")


def _greedy(unit: Column, separator: str, max_tokens: int) -> Column:
    """Greedy runs of fragments up to the limit, never closing inside ``$$``."""
    return _once(F.split(unit, separator), lambda parts: _greedy_parts(parts, separator, max_tokens))


def _once(value: Column, use) -> Column:
    """Bind an expression that the folds below read many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _greedy_parts(parts: Column, separator: str, max_tokens: int) -> Column:
    width = len(separator)

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part)
        grown = F.when(acc["len"] > 0, acc["len"] + width + size).otherwise(size)
        close = (acc["len"] > 0) & (_estimate(grown) > max_tokens) & ~acc["odd"]
        fresh = close | (acc["len"] == 0)
        return F.struct(
            F.when(
                close,
                F.array_append(acc["out"], F.struct(acc["s"].alias("s"), (acc["i"] - acc["s"]).alias("n"))),
            ).otherwise(acc["out"]).alias("out"),
            F.when(fresh, acc["i"]).otherwise(acc["s"]).alias("s"),
            F.when(close, size).otherwise(grown).alias("len"),
            F.when(fresh, _parity(part)).otherwise(acc["odd"] != _parity(part)).alias("odd"),
            (acc["i"] + 1).alias("i"),
        )

    def last(acc: Column) -> Column:
        tail = F.struct(acc["s"].alias("s"), (acc["i"] - acc["s"]).alias("n"))
        return F.when(acc["len"] > 0, F.array_append(acc["out"], tail)).otherwise(acc["out"])

    start = F.struct(
        _spans("out"), F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit(False).alias("odd"), F.lit(0).alias("i")
    )
    return _cut(parts, F.aggregate(parts, start, step, last), separator)


def enforce_max(units: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Re-split oversized units at blank lines, then lines, then spaces."""
    for separator in ("\n\n", "\n", " "):
        units = F.flatten(F.transform(units, _resplit(separator, max_tokens)))
    return units


def _resplit(separator: str, max_tokens: int):
    return lambda unit: _resplit_unit(unit, separator, max_tokens)


def _resplit_unit(unit: Column, separator: str, max_tokens: int) -> Column:
    whole = F.array(unit)
    pieces = F.array(_greedy(unit, separator, max_tokens))
    chosen = F.get(F.transform(pieces, lambda p: F.when(F.size(p) > 1, p).otherwise(whole)), F.lit(0))
    fits = (token_len(unit) <= max_tokens) | ~unit.contains(separator)
    return F.when(fits, whole).otherwise(chosen)


def pack_units(units: Column, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> Column:
    """Greedy packing; each new chunk repeats the last 15 % of the units (one
    at least) of the chunk before it."""
    sized = lambda u: F.struct(u.alias("units"), F.transform(u, token_len).alias("sizes"))
    return _once(_once(units, sized), lambda r: _pack(r["units"], r["sizes"], max_tokens, overlap))


def _pack(units: Column, sizes: Column, max_tokens: int, overlap: float) -> Column:

    def step(acc: Column, size: Column) -> Column:
        count = acc["i"] - acc["s"]
        full = (count > 0) & (acc["tok"] + size > max_tokens)
        keep = F.greatest(F.lit(1), F.floor(count * overlap).cast("int"))
        carried = F.aggregate(F.slice(sizes, acc["i"] - keep + 1, keep), F.lit(0), lambda a, b: a + b)
        return F.struct(
            F.when(full, F.array_append(acc["out"], F.struct(acc["s"].alias("s"), count.alias("n"))))
            .otherwise(acc["out"]).alias("out"),
            F.when(full, acc["i"] - keep).otherwise(acc["s"]).alias("s"),
            (F.when(full, carried).otherwise(acc["tok"]) + size).alias("tok"),
            (acc["i"] + 1).alias("i"),
        )

    def last(acc: Column) -> Column:
        tail = F.struct(acc["s"].alias("s"), (acc["i"] - acc["s"]).alias("n"))
        return F.when(acc["i"] > acc["s"], F.array_append(acc["out"], tail)).otherwise(acc["out"])

    start = F.struct(_spans("out"), F.lit(0).alias("s"), F.lit(0).alias("tok"), F.lit(0).alias("i"))
    return _cut(units, F.aggregate(sizes, start, step, last), "\n\n")
