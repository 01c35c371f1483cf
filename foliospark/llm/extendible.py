"""Extendible hashing: a directory indexed by hash-prefix bits.

Keys are 60-bit non-negative integers.  A bucket is a bit prefix and owns the
contiguous key range below it.  Splitting starts from one bucket of depth 0;
only buckets whose weight exceeds the limit split on one more bit.  Weights are
summed by Spark per prefix, so the driver sees a few numbers per bucket
(about ``2 ** HEADROOM`` times weight / limit of them), never the keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 60
# Bits counted at once beyond an even split; deeper buckets are counted in further rounds.
HEADROOM = 2


@dataclass(frozen=True)
class Bucket:
    weight: int
    rows: int
    low: int
    high: int

    def settled(self, limit: int) -> bool:
        return self.weight <= limit or self.low == self.high

    def __add__(self, other: Bucket) -> Bucket:
        return Bucket(self.weight + other.weight, self.rows + other.rows, min(self.low, other.low), max(self.high, other.high))


EMPTY = Bucket(0, 0, 0, 0)


@dataclass
class Directory:
    """Leaves of the bucket tree, by bit string."""

    limit: int
    leaves: dict[str, Bucket] = field(default_factory=dict)

    @property
    def overfull(self) -> list[str]:
        """Buckets of one single key, which no bit can split."""
        return sorted(b for b, x in self.leaves.items() if x.weight > self.limit)

    def _lookup(self, key: Column, values: dict[str, str]) -> Column:
        """Slots of a few bits more than the leaves need; the rare deeper leaves by their range starts."""
        order = sorted(values, key=lambda b: b.ljust(KEY_BITS, "0"))
        depth = min(max(map(len, order)), math.ceil(math.log2(len(order))) + HEADROOM)
        slots: list[str] = []
        for bits in order:
            if len(bits) <= depth:
                slots += [values[bits]] * 2 ** (depth - len(bits))
            elif len(slots) <= int(bits[:depth] or "0", 2):
                slots.append("")
        found = F.element_at(
            F.split(F.lit(",".join(slots)), ","), (F.shiftrightunsigned(key, KEY_BITS - depth) + 1).cast("int"))
        deep = [b for b in order if len(b) > depth]
        if not deep:
            return found
        starts = F.split(F.lit(",".join(str(int(b.ljust(KEY_BITS, "0"), 2)) for b in deep)), ",").cast("array<bigint>")
        place = F.size(F.filter(starts, lambda start: start <= key))
        return F.when(found != "", found).otherwise(F.element_at(F.split(F.lit(",".join(values[b] for b in deep)), ","), place))

    def bucket(self, key: Column) -> Column:
        """Bit string of the bucket that owns a key; 'root' for depth 0."""
        return self._lookup(key, {b: b or "root" for b in self.leaves})

    def weight(self, key: Column) -> Column:
        return self._lookup(key, {b: str(x.weight) for b, x in self.leaves.items()}).cast("long")

    def rows(self, key: Column) -> Column:
        return self._lookup(key, {b: str(x.rows) for b, x in self.leaves.items()}).cast("long")


def build_directory(keys: DataFrame, limit: int | Callable[[int], int], key: str = "key", weight: str = "weight") -> Directory:
    """Directory over ``keys`` whose buckets weigh at most ``limit`` each, or what that makes of the weight of all.

    One pass sums weights for a few bits more than an even split needs; each
    further round doubles the directory for the buckets still overfull.  A
    bucket that holds one single key stays overfull and is reported.
    An empty table gives one empty root bucket.
    """
    sums = (F.sum(weight).cast("long").alias("w"), F.count(F.lit(1)).alias("n"),
            F.min(key).alias("low"), F.max(key).alias("high"))
    whole = keys.agg(*sums).first()
    limit = limit(whole["w"] or 0) if callable(limit) else limit
    out, depth = Directory(limit), 0
    pending = {"": Bucket(whole["w"], whole["n"], whole["low"], whole["high"]) if whole["n"] else EMPTY}
    while pending:
        for bits in [b for b, x in pending.items() if x.settled(limit)]:
            out.leaves[bits] = pending.pop(bits)
        if not pending:
            break
        heaviest = max(x.weight for x in pending.values())
        step = min(KEY_BITS - depth, max(1, math.ceil(math.log2(heaviest / limit)) + HEADROOM))
        part = keys
        if depth:
            prefix = F.shiftrightunsigned(F.col(key), KEY_BITS - depth)
            part = keys.where(prefix.isin([int(b, 2) for b in pending]))
        fine = F.lpad(F.bin(F.shiftrightunsigned(F.col(key), KEY_BITS - depth - step)), depth + step, "0")
        tree: dict[str, Bucket] = {}
        for row in part.groupBy(fine.alias("bits")).agg(*sums).collect():
            cell = Bucket(row["w"], row["n"], row["low"], row["high"])
            for d in range(depth, depth + step + 1):
                bits = row["bits"][:d]
                tree[bits] = tree[bits] + cell if bits in tree else cell
        stack, pending = list(pending), {}
        while stack:
            bits = stack.pop()
            bucket = tree.get(bits, EMPTY)
            if bucket.settled(limit):
                out.leaves[bits] = bucket
            elif len(bits) < depth + step:
                stack += [bits + "0", bits + "1"]
            else:
                pending[bits] = bucket
        depth += step
    return out
