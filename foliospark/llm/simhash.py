"""SimHash near duplicates with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bktree import Forest, merge_labels
from foliospark.llm.common import checkpointed
from foliospark.llm.components import connected_components

SEED = 42
# Points of one tree; larger groups become blocks that meet pairwise.
TREE = 1 << 16
BLOCK = 1 << 15
# One tree and the queries that search it.
KEYS = ["shard", "tree_no", "query_no"]


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 hashes of the word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = ends.tolist()
    count = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, count, BLOCK):
        hashes = b"".join(
            [digest(joined[a:b - 1], seed) for a, b in zip(starts[at:at + BLOCK], stops[at + last:at + last + BLOCK])])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one 64-bit fingerprint per row as a signed long; null text counts as empty, fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS STRING) AS text")
    return rows.mapInArrow(run, "id long, fp long")


def shard_rows(points: DataFrame, radius: int, tree: int = TREE) -> DataFrame:
    """Rows (shard, tree_no, query_no, member, fp, rep) sending points to the trees they must search.

    Of radius + 1 bit blocks, two fingerprints within the radius agree on one;
    a shard is one value of one block.  A shard over ``tree`` points is cut into
    several trees; each tree then goes to each later block of queries once.
    """
    if not 1 <= radius < 32:
        raise ValueError("radius must be 1 to 31")
    blocks, at = [], 0
    for n in range(radius + 1):
        bits = 64 // (radius + 1) + (n < 64 % (radius + 1))
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
        blocks.append(value * 64 + n)
        at += bits
    return cut_shards(points.select("fp", "rep", F.explode(F.array(*blocks)).alias("shard")), tree)


def cut_shards(spread: DataFrame, tree: int = TREE) -> DataFrame:
    """Rows (shard, fp, rep) sent to the trees of their shard, see ``shard_rows``."""
    sizes = spread.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree)
    cuts = checkpointed(sizes.select(F.col("shard").alias("s"), F.ceil(F.col("n") / tree).cast("int").alias("cuts")))
    cut = spread.join(cuts, F.col("shard") == F.col("s"), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    members = F.transform(F.sequence("own", F.col("cuts") - 1),
                          lambda q: F.struct(F.col("own").alias("tree_no"), q.alias("query_no"), F.lit(True).alias("member")))
    asking = F.transform(F.sequence(F.lit(0), F.col("own")),
                         lambda t: F.struct(t.alias("tree_no"), F.col("own").alias("query_no"), F.lit(False).alias("member")))
    # In its own tree a point is a member and asks too.
    sent = F.concat(members, F.filter(asking, lambda x: x["tree_no"] < x["query_no"]))
    return own.select("shard", "fp", "rep", F.explode(sent).alias("to")).select(
        "shard", "to.tree_no", "to.query_no", "to.member", "fp", "rep")


def hits(rows: np.ndarray, fp: np.ndarray, member: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row pairs of whole groups whose fingerprints lie within the radius."""
    group = np.cumsum(np.r_[False, (rows[1:] != rows[:-1]).any(axis=1)])
    tree = np.flatnonzero(member)
    forest = Forest(fp[tree], group[tree], int(group[-1]) + 1)
    # A block of queries sent to a foreign tree asks alone; elsewhere members ask.
    foreign = np.bincount(group, weights=~member, minlength=len(forest.roots)) > 0
    ask = np.flatnonzero(np.where(foreign[group], ~member, True) & (forest.sizes[group] > 0))
    for query, node in forest.within(fp[ask], group[ask], radius):
        yield ask[query], tree[node]


def _search(rows: np.ndarray, fp: np.ndarray, rep: np.ndarray, member: np.ndarray, radius: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """Links found in whole groups: each point with the smallest rep of its class there."""
    # Numbers ordered by rep: the smallest of a class is its smallest rep.
    order = np.argsort(rep, kind="stable")
    number = np.empty(len(rep), dtype=np.int64)
    number[order] = np.arange(len(rep))
    rep, label = rep[order], np.arange(len(rep))
    for a, b in hits(rows, fp.view(np.uint64), member, radius):
        label = merge_labels(label, number[a], number[b])
    moved = np.flatnonzero(label != np.arange(len(rep)))
    return rep[moved], rep[label[moved]]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of KEYS, with their keys, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    count = 0
    keys_of = lambda table: np.column_stack([table.column(k).to_numpy() for k in KEYS])
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < 65_536:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        rows = keys_of(table)
        change = np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1))
        if len(change):
            whole = int(change[-1]) + 1
            yield table.slice(0, whole), rows[:whole]
            table = table.slice(whole)
        held, count = table.to_batches(), table.num_rows
    if held:
        table = pa.Table.from_batches(held)
        yield table, keys_of(table)


def links(points: DataFrame, radius: int = 4, tree: int = TREE) -> DataFrame:
    """Edges (a, b) between reps of points (fp, rep): within every shard, stars that join what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in whole_groups(batches):
            a, b = _search(rows, *(table.column(c).to_numpy() for c in ("fp", "rep", "member")), radius)
            pairs = np.unique(np.column_stack([a, b]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return shard_rows(points, radius, tree).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, tree: int = TREE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (signed long), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest id reachable, the row's own included.  Texts of fewer words than
    ``width`` are one shingle; texts without words have fingerprint zero and link like
    any other.  A null id links by its fingerprint but names no component: ``component_id`` is null only where
    no id of its class is given.  Repeated rows share their class.  An empty table gives no rows.

    Equal fingerprints collapse first, so copies cost nothing in the search.
    """
    prints = checkpointed(fingerprints(docs, width, id_col, text_col))
    points = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    # Fingerprints stand for themselves, so that one held by rows without an id links as any other.
    named = connected_components(links(points.select("fp", F.col("fp").alias("rep")), radius, tree))
    linked = checkpointed(points.join(named, F.col("fp") == F.col("node")).select("fp", "rep", "component"))
    first = checkpointed(linked.groupBy("component").agg(F.min("rep").alias("first"))).withColumnRenamed("component", "c")
    joined = linked.join(first, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), F.col("first").alias("component"))
    alone = points.where("n > 1").join(linked.select(F.col("fp").alias("l")), F.col("fp") == F.col("l"), "left_anti")
    classes = checkpointed(joined.unionByName(alone.select(F.col("fp").alias("f"), F.col("rep").alias("component"))))
    return prints.join(classes, F.col("fp") == F.col("f"), "left").select(
        F.col("id").alias(id_col), "fp", F.coalesce("component", "id").alias("component_id"))
