"""Near copies by similarity of word shingles: SimHash candidates from BK-trees, confirmed by the shingles themselves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bktree import hamming, merge_labels, spanning_forest
from foliospark.llm.common import checkpointed
from foliospark.llm.components import connected_components
from foliospark.llm.simhash import KEYS, cut_shards, hits, whole_groups

WIDTH, SIMILARITY = 5, 0.8
WORDS = 4  # 64-bit words of a fingerprint
BITS = 64 * WORDS
# Share of the pairs at the similarity that bands and radius are laid out to reach, each.
AIM = 0.97
# Points a shard holds by chance, and points of one tree.
SHARD, TREE = 256, 4096
# Shingles whose bits are summed at once; below 256, so that bytes can count them.
ROWS = 255


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """(n, 2) words of XXH3-128, one row per different shingle; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros((0, 2), dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = min(width, len(words)) - 1
    own = {digest(joined[a:b - 1]) for a, b in zip(starts, ends[last:])}
    return np.frombuffer(b"".join(sorted(own)), dtype=np.uint64).reshape(-1, 2)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """BITS bits as WORDS words: a bit is set if it is in over half of the different shingles' hashes."""
    mixed = np.empty((len(found), WORDS), dtype=np.uint64)
    mixed[:, :2] = found
    for n in range(2, WORDS):
        x = (found[:, n % 2] ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[:, n] = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(mixed), ROWS):
        ones += np.unpackbits(mixed[at:at + ROWS].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(mixed)).view(np.uint64)


def agreement(similarity: float) -> float:
    """Chance that two texts of a Jaccard similarity agree on a bit: their hashes' vectors stand at this angle."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(points: int, similarity: float) -> tuple[list[np.ndarray], int]:
    """(bit places of each band, radius): longer bands, and more of them, for more points.

    A band holds about SHARD points by chance.  A pair at the similarity agrees on one whole band,
    and lies within the radius, with a chance of AIM each; nearer pairs with a greater one.
    """
    same = agreement(similarity)
    width = min(24, max(2, round(math.log2(max(1, points) / SHARD)))) if points > SHARD else 0
    bands = max(1, math.ceil(math.log(1 - AIM) / math.log(1 - same ** width))) if width else 1
    rng = np.random.default_rng(5)
    radius = BITS * (1 - same) + 1.9 * math.sqrt(BITS * same * (1 - same))
    return [rng.choice(BITS, width, replace=False) for _ in range(bands)], math.ceil(radius)


def candidates(points: DataFrame, similarity: float, tree: int = TREE) -> DataFrame:
    """Edges (a, b, apart) between reps of points (fp, rep): in every shard, a shortest forest of the pairs within the radius.

    The forest joins, at each distance, whatever the pairs up to that distance join; so a group of copies sends one
    edge per copy, not its pairs, and no link is lost to a cap.
    """
    places, radius = layout(points.count(), similarity)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(_words(batch.column(0)).view(np.uint8), axis=1)
            shards = [(bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64))) * len(places) + n for n, own in enumerate(places)]
            for shard in shards:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["fp", "rep", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in whole_groups(batches):
            fp, rep, member = _words(table.column("fp")), table.column("rep").to_numpy(), table.column("member").to_numpy()
            n = len(rep)
            a = b = apart = np.zeros(0, dtype=np.int64)
            label, widest = np.arange(n), np.zeros(n, dtype=np.int64)
            for more_a, more_b in hits(rows, fp, member, radius):
                far = hamming(fp[more_a], fp[more_b])
                # What the forest joins by shorter edges adds nothing.
                new = (more_a != more_b) & ((label[more_a] != label[more_b]) | (far < widest[label[more_a]]))
                if not new.any():
                    continue
                a, b, apart = np.r_[a, more_a[new]], np.r_[b, more_b[new]], np.r_[apart, far[new]]
                own = spanning_forest(n, a, b, apart)
                a, b, apart = a[own], b[own], apart[own]
                label = merge_labels(np.arange(n), a, b)
                widest[:] = 0
                np.maximum.at(widest, label[a], apart)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b])), pa.array(apart)], ["a", "b", "apart"])

    rows = cut_shards(points.mapInArrow(spread, "fp binary, rep long, shard long"), tree)
    found = rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "a long, b long, apart long")
    return found.where("a <> b").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, WORDS)


def confirmed(edges: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) whose texts (id, text) have the similarity: shared shingles over all different shingles of both."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, width)[:, 0].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                both = len(np.intersect1d(x, y))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    ends = edges.select(F.col("a").alias("end")).union(edges.select("b")).distinct()
    asked = checkpointed(texts.join(ends, F.col("id") == F.col("end"), "left_semi").select("id", "text").mapInArrow(sets, "id long, own binary"))
    left = edges.join(asked.select(F.col("id").alias("i"), F.col("own").alias("left")), F.col("a") == F.col("i")).drop("i")
    both = left.join(asked.select(F.col("id").alias("i"), F.col("own").alias("right")), F.col("b") == F.col("i"))
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                tree: int = TREE) -> DataFrame:
    """One row per row with an id: id, component_id, the smallest id that links of ``similarity`` or more reach.

    Ids name rows; give rows without a name of their own a number first.  Similarity is that of the sets of ``width``-word
    shingles (fewer words: one shingle; none: no links).  Candidates share a band of bits of a 256-bit SimHash
    and lie within a radius of it, so a pair at the similarity itself is found with a chance of over 0.9, nearer pairs more
    surely; each candidate is then confirmed by the sets themselves.  Equal fingerprints are taken for equal sets.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"CAST(`{text_col}` AS STRING) AS text").where("id IS NOT NULL")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in batch.column(1).to_pylist()]
            own = [wide_fingerprint(s).tobytes() if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "fp"])

    named = checkpointed(rows.mapInArrow(prints, "id long, fp binary"))
    points = checkpointed(named.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    edges = checkpointed(candidates(points.select("fp", "rep"), similarity, tree))
    label = connected_components(confirmed(edges.select("a", "b"), rows, width, similarity))
    classes = points.join(label, F.col("rep") == F.col("node"), "left").where("n > 1 OR component IS NOT NULL").select(
        F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component"))
    return named.join(checkpointed(classes), F.col("fp") == F.col("f"), "left").select(
        F.col("id").alias(id_col), F.coalesce("component", "id").alias("component_id"))
