"""Approximate nearest neighbours over learned, balanced partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Vectors the partitions are learned from, at most; every vector is indexed.
SAMPLE = 8192
# Sampled vectors per partition, and most partitions.
PER_PART, MOST_PARTS = 128, 64
GRAPH_LINKS = 10
# Share of the sample's own neighbours that the probes must reach.
AIM = 0.94
# Indexed vectors and queries that meet in one task group.
BLOCK = 4096


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest inner products of each row, itself left out."""
    out = np.empty((len(vectors), k), dtype=np.int64)
    for at in range(0, len(vectors), 1024):
        scores = vectors[at:at + 1024] @ vectors.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at:at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each vertex: even bisection along main axes, then moves to where most neighbours are.

    ``parts`` is a power of two.  A move needs room: no part exceeds ``slack`` times an even share.
    """
    label = np.zeros(len(vectors), dtype=np.int64)
    width = parts
    while width > 1:
        for part in np.unique(label):
            own = np.flatnonzero(label == part)
            centred = vectors[own] - vectors[own].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ axis, kind="stable")]
            label[order[len(order) // 2:]] += width // 2
        width //= 2
    sizes = np.bincount(label, minlength=parts)
    room = int(np.ceil(slack * len(vectors) / parts))
    rows = np.repeat(np.arange(len(graph)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(vectors), parts), dtype=np.int32)
        np.add.at(votes, (rows, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[rows]), 1)
        best = votes.argmax(axis=1)
        every = np.arange(len(vectors))
        gain = votes[every, best] - votes[every, label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """A linear softmax classifier from vectors to partitions, and how many of them a query probes."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-(vectors @ self.weights + self.bias), axis=1, kind="stable")


def train_router(vectors: np.ndarray, steps: int = 300) -> Router:
    """Learn partitions of the sample's neighbour graph and the classifier that routes to them."""
    count, dim = vectors.shape
    parts = 1
    while parts * 2 <= min(MOST_PARTS, count // PER_PART):
        parts *= 2
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), 1)
    graph = neighbours(vectors, min(GRAPH_LINKS, count - 1))
    label = balanced_partition(vectors, graph, parts)
    # A vector should be routed to where it and its neighbours are.
    target = np.zeros((count, parts))
    np.add.at(target, (np.repeat(np.arange(count), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(count), label] += graph.shape[1]
    target /= target.sum(axis=1, keepdims=True)
    scale = np.sqrt((vectors**2).mean()) or 1.0
    x = vectors / scale
    weights, bias = np.zeros((dim, parts)), np.zeros(parts)
    first, second = np.zeros((dim + 1, parts)), np.zeros((dim + 1, parts))
    for step in range(1, steps + 1):
        error = (softmax(x @ weights + bias) - target) / count
        grad = np.vstack([x.T @ error + 1e-5 * weights, error.sum(axis=0)])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    router = Router(weights / scale, bias, 1)
    order = router.ranked(vectors)
    home, near = order[:, 0], neighbours(vectors, min(20, count - 1))
    place = np.argsort(order, axis=1)  # rank of each part for each vector
    needed = np.take_along_axis(place, home[near], axis=1)
    while router.probes < parts and (needed < router.probes).mean() < AIM:
        router.probes += 1
    return router


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of vectors that take part: finite, not zero, no null inside."""
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE, id_col: str = "vec_id",
            vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products found for each id divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no part,
    nor do null ids or vectors of another length than most of the sample.  Scores are in
    double precision; ties go to the smaller id.  Rows that repeat an id are candidates each, but
    a query never finds its own id; a repeated query is asked once.  An empty table gives no rows.

    Partitions are learned from at most ``sample`` vectors, those of the smallest id hashes.  Every
    vector is indexed in its most probable partition.  A query probes as many partitions as
    the sample needed, and more until they hold k candidates.  Large partitions are cut into
    blocks, so no task group holds more than ``block`` vectors and as many queries.
    """
    spark = vectors.sparkSession
    found_schema = "query_id long, id long, score double"
    rows = usable(vectors, id_col, vec_col)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not taken.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    lengths = np.array([len(v) for v in taken.column("vec")])
    dim = int(np.bincount(lengths).argmax())
    router = train_router(matrix(taken.column("vec").filter(pa.array(lengths == dim))))
    rows = rows.where(F.size("vec") == dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = router.ranked(matrix(batch.column(1))).astype(np.int32) if batch.num_rows else np.empty((0, 1), np.int32)
            ranked = pa.ListArray.from_arrays(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1], order.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, ranked], ["id", "vec", "ranked"])

    placed = rows.mapInArrow(place, "id long, vec array<double>, ranked array<int>")
    counted = placed.groupBy(F.col("ranked")[0].alias("part"), (F.col("id") % every == 0).alias("asks")).count().collect()
    sizes, parts = {}, len(router.bias)
    for row in counted:
        sizes[row["part"]] = sizes.get(row["part"], 0) + row["count"]
    held = F.array(*[F.lit(sizes.get(p, 0)).cast("long") for p in range(parts)])
    # Probes of a query: enough partitions, and enough candidates beside itself.
    reached = F.aggregate("ranked", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("n")), lambda s, p: F.when(
        (s["n"] >= router.probes) & (s["seen"] > k), s).otherwise(F.struct(
            (s["seen"] + F.element_at(held, p + 1)).alias("seen"), (s["n"] + 1).alias("n"))))["n"]
    queries = placed.where(F.col("id") % every == 0).dropDuplicates(["id"])
    probes = queries.select("id", "vec", F.explode(F.slice("ranked", F.lit(1), reached)).alias("part"))
    asked = {r["part"]: r["count"] for r in probes.groupBy("part").count().collect()}
    pieces = lambda n: max(1, -(-n // block))
    cuts = F.array(*[F.struct(F.lit(pieces(sizes.get(p, 0))).alias("d"), F.lit(pieces(asked.get(p, 0))).alias("q"))
                     for p in range(parts)])
    cut = lambda c: F.element_at(cuts, F.col("part") + 1)[c]
    share = lambda c: F.pmod(F.xxhash64("id"), cut(c)).cast("int")
    data = placed.select("id", "vec", F.col("ranked")[0].alias("part")).select(
        F.lit(False).alias("asks"), "id", "vec", "part", share("d").alias("d"),
        F.explode(F.sequence(F.lit(0), cut("q") - 1)).alias("q"))
    ask = probes.select(F.lit(True).alias("asks"), "id", "vec", "part",
                        F.explode(F.sequence(F.lit(0), cut("d") - 1)).alias("d"), share("q").alias("q"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ids, vecs = frame["id"].to_numpy(), np.stack(frame["vec"].to_numpy())
        out, own, points = [], ids[~asks], vecs[~asks]
        for at in np.array_split(np.flatnonzero(asks), max(1, asks.sum() // 256)):
            if not len(own) or not len(at):
                continue
            rough = vecs[at] @ points.T
            for row, query in zip(rough, at, strict=True):
                row[own == ids[query]] = -np.inf
                n = min(k, int((row > -np.inf).sum()))
                if not n:
                    continue
                bound = np.partition(row, len(row) - n)[len(row) - n]
                near = np.flatnonzero(row >= bound - 1e-9 * max(1.0, abs(bound)))
                # One way of summing for every pair: equal vectors get equal scores.
                score = (points[near] * vecs[query]).sum(axis=1)
                best = np.lexsort((own[near], -score))[:n]
                out.append(pd.DataFrame({"query_id": ids[query], "id": own[near][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = data.unionByName(ask).groupBy("part", "d", "q").applyInPandas(search, found_schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
