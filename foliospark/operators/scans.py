"""Running computations per key that never put a whole key into one task.

A key's rows are cut into blocks along the leading order column.  Each block
is scanned on its own; what a block needs from the blocks before it (a count,
a last value) comes from a tiny per-block summary.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.session import checkpointed

BLOCK = "_block"


def _blocks(keys: list[str]):
    return W.partitionBy(*keys).orderBy(BLOCK)


def position_by(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based place of each row within its key, by columns of any type; without keys, in the whole table.

    Rows are dealt out by ranges of (keys, order) and sorted where they lie, so a key of very many rows spreads over
    many tasks.  The sorted rows are written once, each with its place in its task; the tasks' sizes, one
    number each, turn that into a place in the whole table, and a key's first place into one within the key.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k) for k in keys] + order
    dealt = df.repartitionByRange(tasks, *sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt)
    task = F.shiftright("_at", 33).cast("int")
    sizes = {r["task"]: r["count"] for r in dealt.groupBy(task.alias("task")).count().collect()}
    before = F.lit([0, *accumulate(sizes.get(n, 0) for n in range(tasks))]).cast("array<bigint>")
    placed = dealt.withColumn("_place", F.get(before, task) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    if not keys:
        return placed.withColumn(name, F.col("_place") + 1).drop("_place")
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return _null_safe(placed, first, keys).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def row_number_by(df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str) -> DataFrame:
    """1-based row number per key; ``block`` is any non-decreasing function of
    the leading order column."""
    cut = df.withColumn(BLOCK, block)
    sizes = cut.groupBy(*keys, BLOCK).agg(F.count("*").alias("_n"))
    before = sizes.select(
        *keys, BLOCK,
        F.coalesce(F.sum("_n").over(_blocks(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_scan_before"),
    )
    local = cut.withColumn("_scan_rn", F.row_number().over(W.partitionBy(*keys, BLOCK).orderBy(*order)))
    return (
        _null_safe(local, before, [*keys, BLOCK])
        .withColumn(name, (F.col("_scan_rn") + F.col("_scan_before")).cast("long"))
        .drop(BLOCK, "_scan_rn", "_scan_before")
    )


def running_last(
    df: DataFrame, keys: list[str], order: list[str], block: Column, values: dict[str, Column],
    inclusive: bool = True, descending: bool = False, tasks: int | None = None,
) -> DataFrame:
    """For each named value, its last non-null one up to each row (or strictly
    before it).  ``block`` never decreases along the scan; blocks are dealt out to ``tasks`` tasks when given."""
    cut = df.withColumn(BLOCK, block)
    if tasks is not None:
        cut = cut.repartition(tasks, *keys, BLOCK)
    held = {name: f"_v{i}" for i, name in enumerate(values)}
    for name, value in values.items():
        cut = cut.withColumn(held[name], value)
    edge = F.min if descending else F.max
    ends = cut.groupBy(*keys, BLOCK).agg(
        *[
            edge(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("_v")))).alias(v)
            for v in held.values()
        ]
    )
    before = _blocks(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, BLOCK,
        *[F.last(F.col(f"{v}._v"), ignorenulls=True).over(before).alias(f"_carry{v}") for v in held.values()],
    )
    sort = [F.desc(c) if descending else F.asc(c) for c in order]
    frame = W.partitionBy(*keys, BLOCK).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = cut.select(
        *df.columns, BLOCK,
        *[F.last(v, ignorenulls=True).over(frame).alias(f"_local{v}") for v in held.values()],
    )
    return _null_safe(local, carried, [*keys, BLOCK]).select(
        *df.columns, *[F.coalesce(f"_local{v}", f"_carry{v}").alias(name) for name, v in held.items()]
    )


def running_count(
    df: DataFrame, keys: list[str], order: list[str], block: Column, condition: Column, name: str
) -> DataFrame:
    """Number of rows up to and including each one that meet the condition."""
    cut = df.withColumn(BLOCK, block).withColumn("_scan_hit", F.when(condition, 1).otherwise(0))
    sums = cut.groupBy(*keys, BLOCK).agg(F.sum("_scan_hit").alias("_n"))
    before = sums.select(
        *keys, BLOCK,
        F.coalesce(F.sum("_n").over(_blocks(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_scan_before"),
    )
    frame = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_scan_run", F.sum("_scan_hit").over(frame))
    return (
        _null_safe(local, before, [*keys, BLOCK])
        .withColumn(name, (F.col("_scan_run") + F.col("_scan_before")).cast("long"))
        .drop(BLOCK, "_scan_hit", "_scan_run", "_scan_before")
    )


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, as a window partition does."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        part = left[c].eqNullSafe(renamed[f"_r_{c}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def moving_average(
    df: DataFrame, value: str, order: list[str], k: int = 10, name: str = "moving_avg", slab: int = 4096,
) -> DataFrame:
    """Mean of the last ``k`` rows in one global order.

    Rows get their global position first; slabs of consecutive positions are
    then averaged side by side, each with the k-1 rows before it as overlap.
    """
    ranked = position_by(df, [], [F.col(c) for c in order], "_pos")
    home = F.floor((F.col("_pos") - 1) / slab)
    spill = (F.col("_pos") - 1) % slab >= slab - (k - 1)
    copies = ranked.withColumn("_home", home).withColumn(
        "_slab", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = W.partitionBy("_slab").orderBy("_pos").rowsBetween(-(k - 1), 0)
    return (
        copies.withColumn(name, F.avg(value).over(frame))
        .where("_slab = _home")
        .drop("_slab", "_home", "_pos")
    )


def window_count_before(df: DataFrame, key: str, micros: str, seconds: int, name: str) -> DataFrame:
    """Rows of the same key in the ``seconds`` before each row (itself out).

    Every row also visits the next time bin as history, so (key, bin) groups
    are complete and a busy key spreads over its bins.
    """
    span = seconds * 1_000_000
    home = F.floor(F.col(micros) / span)
    copies = df.withColumn("_home", home).withColumn("_bin", F.explode(F.array(home, home + 1)))
    frame = W.partitionBy(key, "_bin").orderBy(micros).rangeBetween(-span, -1)
    return copies.withColumn(name, F.count("*").over(frame)).where("_bin = _home").drop("_home", "_bin")


def rate_limit(
    requests: DataFrame, per_window: int, seconds: int = 60, key: str = "key", micros: str = "micros",
    ident: str = "request_id", accepted: DataFrame | None = None,
) -> DataFrame:
    """Accepted-only sliding window: a request passes iff fewer than
    ``per_window`` *accepted* ones lie within the last ``seconds``.

    Keys are cut at idle spans of a whole window, where the state is empty.
    Each run of busy bins streams through a task in time order with at most
    ``per_window`` timestamps of state; no group is held in memory.
    ``accepted(key, micros)`` are requests let through before; they count and give no row.
    """
    span = seconds * 1_000_000
    asked = requests.select(key, micros, ident, F.lit(False).alias("_before"))
    if accepted is not None:
        gone = F.lit(None).cast(requests.schema[ident].dataType)
        asked = asked.unionByName(accepted.select(key, micros, gone.alias(ident), F.lit(True).alias("_before")))
    bins = asked.withColumn("_bin", F.floor(F.col(micros) / span))
    runs = bins.select(key, "_bin").distinct().withColumn(
        "_run", F.col("_bin") - F.row_number().over(W.partitionBy(key).orderBy("_bin"))
    )
    cut = _null_safe(bins, runs, [key, "_bin"]).select(key, "_run", micros, ident, "_before")
    schema = cut.select(key, micros, ident).schema.simpleString()[7:-1]

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, deque()
        for batch in batches:
            flags = []
            for k, run, at, before in zip(batch[key], batch["_run"], batch[micros], batch["_before"]):
                if (k, run) != current:
                    current, state = (k, run), deque()
                while state and at - state[0] > span:
                    state.popleft()
                ok = before or len(state) < per_window
                if ok:
                    state.append(at)
                flags.append(ok)
            yield batch[[key, micros, ident]].assign(allowed=flags)[~batch["_before"].astype(bool)]

    return (
        cut.repartition(F.col(key), F.col("_run"))
        .sortWithinPartitions(key, "_run", micros, ident)
        .mapInPandas(accept, schema + ",allowed boolean")
    )
