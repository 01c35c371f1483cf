"""Exact top-k inner products by reading sorted lists without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import staged

SCALE = 256
# Vectors whose lists one task holds, and queries that read them there.
VECTORS, QUERIES = 8192, 2048
# Tasks per shuffle partition, at most.
TASKS = 16
# Queries whose bounds are held at once, and pairs resolved at once.
BATCH, PAIRS = 256, 1 << 16


class Lists:
    """One sorted list per component, read from both of its ends to one depth.

    A query reads a component's list from the largest values down where its own component is positive, from the
    smallest up where it is negative.  What has been read is known; the rest lies between the
    value at the reading place and the end of the list.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.argsort(points, axis=0, kind="stable")
        self.values = np.take_along_axis(points, self.order, axis=0)
        self.depth = 0
        self.known = [np.zeros(points.shape, points.dtype) for _ in range(2)]
        self.read = [np.zeros(points.shape, bool) for _ in range(2)]

    def read_to(self, depth: int) -> None:
        n = len(self.order)
        for side, part in enumerate((slice(n - depth, n - self.depth), slice(self.depth, depth))):
            np.put_along_axis(self.known[side], self.order[part], self.values[part], axis=0)
            np.put_along_axis(self.read[side], self.order[part], True, axis=0)
        self.depth = depth

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """(most, least) that each vector may add per unit of a positive and of a negative component."""
        n = len(self.order)
        here = (self.values[n - self.depth], self.values[self.depth - 1])
        end = (self.values[0], self.values[n - 1])
        most = np.hstack([np.where(self.read[s], self.known[s], here[s]) for s in range(2)])
        least = np.hstack([np.where(self.read[s], self.known[s], end[s]) for s in range(2)])
        return most, least


def depths(n: int) -> list[int]:
    """Reading depths after which bounds are compared: what is unread halves each time, then all is read."""
    out, rest = [], n
    while rest > max(1, n // 16):
        rest //= 2
        out.append(n - rest)
    return out if out and out[-1] == n else [*out, n]


def best(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, point index, score) of the k largest inner products of each query, ties to the smaller id; its own id is left out.

    Rounds of reading raise the k-th lower bound and lower the upper bounds.  A query stops when few
    vectors could still qualify; the exact scores of these decide.
    """
    n = len(points)
    by_id = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[by_id], query_ids, side=s) for s in ("left", "right"))
    own = {q: by_id[low[q]:high[q]] for q in np.flatnonzero(high > low).tolist()}
    largest = np.abs(points.astype(np.float64)).max(initial=0) * np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)
    if largest >= 1 << 53:
        return _plain(queries, points, ids, own, k)
    real = np.float32 if largest < 1 << 24 else np.float64  # holds every sum exactly
    lists = Lists(points.astype(real))
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(real)
    open_, found = np.arange(len(queries)), []
    for depth in depths(n):
        if not len(open_):
            break
        lists.read_to(depth)
        most, least = lists.bounds()
        enough = n if depth == n else max(4 * k, n // 64)
        left = []
        for at in range(0, len(open_), BATCH):
            block = open_[at:at + BATCH]
            upper, lower = signed[block] @ most.T, signed[block] @ least.T
            for row, q in enumerate(block.tolist()):
                if q in own:
                    upper[row, own[q]] = lower[row, own[q]] = -np.inf
            bound = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(block), -np.inf)
            may = (upper >= bound[:, None]) & (upper > -np.inf)
            stops = may.sum(axis=1) <= enough
            left.append(block[~stops])
            rows, cols = np.nonzero(may & stops[:, None])
            found.append(_resolve(queries, block[rows], points, cols, ids, k))
        open_ = np.concatenate(left)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _resolve(queries: np.ndarray, query: np.ndarray, points: np.ndarray, point: np.ndarray, ids: np.ndarray, k: int):
    """Exact scores of the given pairs, and of these the k best of each query."""
    score = np.concatenate([np.zeros(0, np.int64), *(
        np.einsum("ij,ij->i", queries[query[at:at + PAIRS]], points[point[at:at + PAIRS]]) for at in range(0, len(query), PAIRS))])
    order = np.lexsort((ids[point], -score, query))
    query, point, score = query[order], point[order], score[order]
    first = np.searchsorted(query, query, side="left")
    kept = np.arange(len(query)) - first < k
    return query[kept], point[kept], score[kept]


def _plain(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: dict[int, np.ndarray], k: int):
    """All scores in whole numbers of any size, for components whose sums floats cannot hold; scores past 64 bits are cut to them."""
    out = []
    wide = points.astype(object)
    for q in range(len(queries)):
        scores = wide @ queries[q].astype(object)
        mine = set(own.get(q, np.zeros(0, np.int64)).tolist())
        order = sorted((p for p in range(len(points)) if p not in mine), key=lambda p: (-scores[p], ids[p]))[:k]
        out += [(q, p, min(max(int(scores[p]), -2 ** 63), 2 ** 63 - 1)) for p in order]
    return tuple(np.array([x[c] for x in out], dtype=np.int64) for c in range(3))


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vec): components times ``scale``, rounded down.  Equal rows become one; null ids and vectors holding null or non-finite components go."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "id", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec")).dropDuplicates(["id", "vec"])


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
                vector_block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k largest whole-number inner products for each id divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and null ids, take no part; zero vectors do.  Vectors meet
    those of their own length.  Equal rows count once.  Different vectors of one id are candidates each, never of
    their own id, and each asks on its own if the id asks.  Ties go to the smaller id.  An empty table
    gives no rows; other columns are not read.  Components past 64 bits are cut to them.

    Vectors are dealt by a hash into blocks of about ``vector_block``, whose lists one task sorts and
    reads; queries meet every block in blocks of their own.  Each block sends k rows a query.
    """
    rows = staged(whole_vectors(vectors, id_col, vec_col, scale), "whole").withColumns(
        {"dim": F.size("vec"), "own": F.xxhash64("vec"), "asks": F.col("id") % every == 0})
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    counts = rows.groupBy(F.col("dim").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("nq")).where("nq > 0")
    cuts = counts.select("d", blocks(F.col("n"), vector_block).alias("v_cuts"), blocks(F.col("nq"), query_block).alias("q_cuts"))
    cut = rows.join(cuts, F.col("dim") == F.col("d"))
    share = lambda salt, n: F.pmod(F.xxhash64("id", "own", F.lit(salt)), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = cut.select("dim", "id", "own", "vec", F.lit(False).alias("asks"), share(1, "v_cuts").alias("v"), every_one("q_cuts").alias("q"))
    asking = cut.where("asks").select("dim", "id", "own", "vec", "asks", every_one("v_cuts").alias("v"), share(2, "q_cuts").alias("q"))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        vecs = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if asks.all() or not asks.any():
            query = point = score = np.zeros(0, np.int64)
        else:
            query, point, score = best(vecs[asks], ids[asks], vecs[~asks], ids[~asks], k)
        return pa.table({"query_id": ids[asks][query], "own": own[asks][query], "id": ids[~asks][point], "score": score})

    # A small block is long work: as many tasks as blocks, not as bytes would need.
    cells = cuts.agg(F.sum(F.col("v_cuts") * F.col("q_cuts"))).first()[0] or 1
    tasks = min(cells, TASKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = points.unionByName(asking).repartition(tasks, "dim", "v", "q").groupBy("dim", "v", "q").applyInArrow(search, "query_id long, own long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
