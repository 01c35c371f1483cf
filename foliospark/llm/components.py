"""Connected components by contraction, all state in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); the smallest node names it.

    Each round sends a node to the first of its closed neighbourhood, by id in the first
    round and by a hash of the id in later ones, and renames both ends of the edges.
    The number of nodes shrinks by a constant factor a round, on long chains too.
    Minima combine before their shuffle, and both sides of every join are tables read from
    the shared folder, so a node of very many edges is split by adaptive execution.
    They are written, not checkpointed: a checkpoint keeps what the optimizer inferred of its columns, and over
    many rounds that grows beyond bounds.  Loops and repeated edges are allowed; null ends are left out.
    """
    edges = staged(edges.where("a < b OR a > b").select("a", "b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        order = (lambda c: F.col(c)) if not steps else (lambda c, n=len(steps): F.xxhash64(F.col(c), F.lit(n)))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("best"))
        own = F.struct(order("a").alias("o"), F.col("a").alias("v"))
        step = staged(near.select(F.col("a").alias("node"), F.least("best", own)["v"].alias("to")), "step")
        steps.append(step)
        left = step.select(F.col("node").alias("n1"), F.col("to").alias("t1"))
        right = step.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
        edges = staged(
            edges.join(left, F.col("a") == F.col("n1")).join(right, F.col("b") == F.col("n2"))
            .where("t1 <> t2").select(F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = steps[-1]
    for step in reversed(steps[:-1]):
        later = root.select(F.col("node").alias("n"), F.col("to").alias("t"))
        root = step.join(later, F.col("to") == F.col("n"), "left").select("node", F.coalesce("t", "to").alias("to"))
    root = staged(root, "root")
    names = staged(root.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component")), "names")
    names = names.withColumnRenamed("to", "t")
    return root.join(names, F.col("to") == F.col("t")).select("node", "component")
