"""Nearest neighbours of many questions in one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.topk import top_k
from foliospark.plans.search import CHANNEL_TOP

# Vectors and questions that meet in one task.
VECTORS, QUESTIONS = 16_384, 2_048
# Questions whose distances are held at once.
STEP = 128


def _distances(asked: np.ndarray, held: np.ndarray, metric: str) -> np.ndarray:
    """One matrix product; rows are questions."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "cosine":
            return 1.0 - (asked @ held.T) / np.outer(np.linalg.norm(asked, axis=1), np.linalg.norm(held, axis=1))
        squares = (asked**2).sum(axis=1)[:, None] - 2 * (asked @ held.T) + (held**2).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))


def _exact(asked: np.ndarray, held: np.ndarray, metric: str) -> np.ndarray:
    """The distance of one question, summed the same way for every pair."""
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - (held * asked).sum(axis=1) / (np.sqrt((held**2).sum(axis=1)) * np.sqrt((asked**2).sum()))
    return np.sqrt(((held - asked) ** 2).sum(axis=1))


def knn_many(
    vectors: DataFrame, questions: DataFrame, top: int = CHANNEL_TOP, metric: str = "l2",
    vector_block: int = VECTORS, question_block: int = QUESTIONS,
) -> DataFrame:
    """(query_id, chunk_id, score): the nearest ``vectors(chunk_id, embedding)`` of each of ``questions(query_id, embedding)``.

    Vectors and questions are dealt into blocks by a hash; each pair of blocks meets in one task as matrix products
    and sends the best rows of each question only, so what travels grows with the blocks, not with the pairs.
    Results are those of ``knn`` question by question: ties go to the smaller chunk, vectors of another length and those without
    a distance (zero under cosine, not finite) are left out.  An absent vector or question finds nothing.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    usable = lambda df, name: df.where(F.col("embedding").isNotNull() & F.col(name).isNotNull()).select(
        F.col(name).alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.size("embedding").alias("dim"))
    held, asked = usable(vectors, "chunk_id"), usable(questions, "query_id")
    blocks = lambda df, size: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
    cuts = blocks(held, vector_block).select("dim", F.col("n").alias("vs")).join(blocks(asked, question_block).select("dim", F.col("n").alias("qs")), "dim")
    share = lambda n: F.pmod(F.xxhash64("id", "vec"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kinds = {n: df.schema["id"].dataType for n, df in (("chunk_id", held), ("query_id", asked))}

    def row(asks: bool, v: Column, q: Column) -> list[Column]:
        # Ids of both sides keep columns of their own, as their types may differ.
        own = [F.col("id").alias(n) if (n == "query_id") == asks else F.lit(None).cast(kinds[n]).alias(n) for n in ("chunk_id", "query_id")]
        return ["dim", "vec", F.lit(asks).alias("asks"), v.alias("v"), q.alias("q"), *own]

    met = held.join(cuts, "dim").select(*row(False, share("vs"), each("qs"))).unionByName(
        asked.join(cuts, "dim").select(*row(True, each("vs"), share("qs"))))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        sides = [table.filter(asks), table.filter(pc.invert(asks))]
        # A null component reads as not a number.
        matrices = [s.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1) for s in sides]
        chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ask, have = matrices
        for at in range(0, len(ask), STEP):
            rough = _distances(ask[at:at + STEP], have, metric) if len(have) else np.empty((0, 0))
            for n, values in enumerate(rough):
                near = np.flatnonzero(np.isfinite(values))
                if len(near) > top:
                    # Room for the rounding of the product; the exact distances decide, ties at the edge included.
                    edge = np.partition(values[near], top - 1)[top - 1]
                    near = near[values[near] <= edge + 1e-6 * (1 + abs(edge))]
                score = _exact(ask[at + n], have[near], metric)
                chosen.append((np.full(len(near), at + n), near, score))
        query, chunk, score = (np.concatenate(x) for x in zip(*chosen)) if chosen else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        fine = np.isfinite(score)
        return pa.table({
            "query_id": sides[0].column("query_id").take(pa.array(query[fine])), "chunk_id": sides[1].column("chunk_id").take(pa.array(chunk[fine])),
            "score": pa.array(score[fine], pa.float64())})

    schema = f"query_id {kinds['query_id'].simpleString()}, chunk_id {kinds['chunk_id'].simpleString()}, score double"
    found = met.groupBy("dim", "v", "q").applyInArrow(search, schema)
    return top_k(found, top, [F.asc("score"), F.asc("chunk_id")], ["query_id"])
