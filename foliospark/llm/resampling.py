"""Importance resampling towards a target corpus, ranked by parallel sorting by regular sampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from foliospark.llm.common import staged

BUCKETS = 10_000
SEED = 2024
# Sorted runs, and segments they are cut into, at most: the driver sees no more than 2 * RUNS ** 2 samples.
RUNS = 512
# Bytes of text whose features are held at once.
SLICE = 1 << 22
# A-Z in lower case; digits, letters and all bytes past ASCII stay, the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes | None, grams: int = 1) -> list[bytes]:
    """All runs of 1 to ``grams`` words of a UTF-8 text, repeats included."""
    words = (text or b"").translate(WORD_BYTES).split()
    out = list(words)
    for n in range(2, grams + 1):
        out += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


def _hashed(batch: pa.RecordBatch, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, features per row, their buckets) in steps of about SLICE bytes; a text is never cut."""
    sizes, held, size, first = [], [], 0, 0
    texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
    for n, text in enumerate(texts):
        own = features(text, grams)
        sizes.append(len(own))
        held.append(np.fromiter(map(crc32, own), np.uint32, len(own)) % buckets)
        size += len(text or b"")
        if size >= SLICE or n + 1 == len(texts):
            yield first, np.array(sizes, dtype=np.int64), np.concatenate(held)
            sizes, held, size, first = [], [], 0, n + 1


def bucket_counts(texts: DataFrame, text_col: str = "text", grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket.  Each task sums into one array; the driver sees one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, own in _hashed(batch, grams, buckets):
                total += np.bincount(own, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, both smoothed by one per bucket."""
    size = len(source)
    s_all, t_all = int(source.sum()) + size, int(target.sum()) + size
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(id_text: str | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, fixed by the id; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{id_text or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, grams: int = 1, seed: int = SEED, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight, score) per row, by a lookup in the array of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, own in _hashed(batch, grams, len(gains)):
                ends = np.r_[0, np.cumsum(gains[own])]
                stops = np.cumsum(sizes)
                weight = (ends[stops] - ends[stops - sizes]) // np.maximum(sizes, 1)
                extra = np.array([noise(x, seed) for x in batch.column(1).slice(first, len(sizes)).to_pylist()], dtype=np.int64)
                words = sizes if grams == 1 else np.array(
                    [len(features(t)) for t in batch.column(2).slice(first, len(sizes)).cast(pa.binary()).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sizes)), pa.array(sizes), pa.array(words), pa.array(weight), pa.array(weight + extra)],
                    ["id", "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).cast("string").alias("name"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_features long, n_words long, weight long, score long")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Sort key of each row, one column a row: score descending, null ids last, id, row number."""
    ids = batch.column("id")
    return np.stack([-batch.column("score").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                     ids.fill_null(0).to_numpy(), batch.column("row").to_numpy()]).astype(np.int64)


def _in_order(keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def splitters(rows: DataFrame, segments: int) -> np.ndarray:
    """Keys that cut all rows into about even segments, from regular samples of locally sorted runs.

    A run keeps every n-th of its keys, n doubling whenever it holds 2 * ``segments`` of them, so it
    sends at least ``segments`` evenly spaced keys, if it has that many, and stands for n rows with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, stride, seen = np.empty((4, 0), dtype=np.int64), 1, 0
        for batch in batches:
            keys = _keys(batch)
            # Positions stride - 1, 2 * stride - 1, ... of the run.
            kept = np.hstack([kept, keys[:, (stride - 1 - seen) % stride::stride]])
            seen += batch.num_rows
            while kept.shape[1] > 2 * segments:
                kept, stride = kept[:, 1::2], 2 * stride
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, kept), pa.array(np.full(kept.shape[1], stride))], ["k0", "k1", "k2", "k3", "rows"])

    runs = rows.select("score", "id", "row").coalesce(RUNS).sortWithinPartitions(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    found = runs.mapInArrow(run, "k0 long, k1 long, k2 long, k3 long, rows long").toPandas().to_numpy().T.astype(np.int64)
    keys, weight = found[:4], found[4]
    order = _in_order(keys)
    before = np.cumsum(weight[order])
    if not len(before):
        return keys
    at = np.searchsorted(before, before[-1] * np.arange(1, segments) / segments)
    return keys[:, order[np.unique(at)]]


def draw(rows: DataFrame, share: int, segments: int | None = None) -> DataFrame:
    """``rows`` (score, id, row, eligible, ...) with ``rank`` 1, 2, 3, ... for the best ``share`` percent of the eligible, else null.

    Ranks go by score descending, id, and ``row``, a number of its own for each row, so a key that
    many rows share is cut like any other.  Runs are sorted where they lie; regular splitters of them cut
    all rows into segments; a segment is exchanged to one task and sorted there; ranks are local places
    plus the sizes of the segments before.  Segments past the last rank drawn are not exchanged.
    """
    spark = rows.sparkSession
    segments = segments or min(RUNS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = splitters(rows.where("eligible"), segments)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = _in_order(np.hstack([cuts, _keys(batch)]))
            is_cut = order < cuts.shape[1]
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.cumsum(is_cut)
            own = np.where(batch.column("eligible").to_numpy(zero_copy_only=False), place[cuts.shape[1]:], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "segment"])

    dealt = rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("segment", LongType())]))
    sizes = {r["segment"]: r["count"] for r in dealt.where("segment >= 0").groupBy("segment").count().collect()}
    before = np.cumsum([0, *(sizes.get(s, 0) for s in range(cuts.shape[1] + 1))]).tolist()
    drawn = before[-1] * share // 100
    last = max((s for s in range(len(before) - 1) if before[s] < drawn), default=-1)
    near = F.col("segment").between(0, last)
    order = Window.partitionBy("segment").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (F.col("segment") + 1).cast("int"))
    rank = F.row_number().over(order) + offset
    best = dealt.where(near).withColumn("rank", F.when(rank <= drawn, rank))
    return best.unionByName(dealt.where(~near).withColumn("rank", F.lit(None).cast("long"))).drop("segment")


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, grams: int = 1, buckets: int = BUCKETS,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: id, n_features, weight, score, rank; the best ``share`` percent of those with ``least_words`` have a rank.

    ``weight`` is the floored mean of the gains of its features' buckets, 0 without features; ``score``
    adds noise that the id fixes.  Null texts have no words.  A null id counts as empty text and goes
    last among equal scores; rows that repeat an id are ranked each, equal ones in any order.
    An empty table gives no rows, an empty target gains by the source alone; other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, grams, buckets), bucket_counts(target, target_col, grams, buckets))
    rows = scored(docs, gains, grams, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # Written once, so that rows keep their numbers and texts are not read again.
    rows = staged(rows, "weights").withColumn("eligible", F.col("n_words") >= least_words)
    return draw(rows, share).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
