"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy over the whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, staged

OFFSETS = (-2, -1, 1, 2)
PAD = 2  # tokens between two texts
CLASSES, MEMBERS = 32, 32  # 1024 tokens in all
RARE = 256  # of them for words without a token of their own, by length and last letter
WIDTH = 16
BATCH = 8192
RATE = 0.05
# Bytes of text in one step of a task.
SLICE = 1 << 21
# Words whose count every worker holds; the counts of all others are joined in by a shuffle.
NEAR = 1 << 16
COUNTS = "word string, count long"
# Different words that a task counts before it sends them.
HELD = 1 << 18


class Vocabulary:
    """Token ids of words: the most frequent words of the corpus, and classes of all others.

    Id 0 pads.  Class c of the softmax holds the ids c * MEMBERS and on, so a class holds words of
    about one frequency.  Other words are told apart by their length, up to 16 bytes, and last byte.
    Such a kind of words holds ``totals`` tokens; a word counted n times is n / (total + 1) of it, and
    all words never counted together are 1 / (total + 1).  ``near`` holds the logarithms of the most
    frequent of these words, ``path`` the counts of all words; without counts nothing is told apart.
    """

    def __init__(self, frequent: list[bytes], near: dict[bytes, int] | None = None, totals: np.ndarray | None = None,
                 path: str | None = None):
        self.rare = CLASSES * MEMBERS - RARE
        slots = np.arange(1, self.rare)
        self.table = dict(zip(frequent[:len(slots)], slots.tolist()))
        self.totals = np.zeros(RARE, dtype=np.int64) if totals is None else totals
        near = near or {}
        kinds = self.ids(list(near)) - self.rare
        shares = np.array(list(near.values()), dtype=np.float64) / (self.totals[kinds] + 1) if near else np.zeros(0)
        self.near = dict(zip(near, np.log(shares).tolist()))
        self.path = path

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words in order; lengths and last bytes are read off all of them at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        last = np.frombuffer(b"".join(words), np.uint8)[np.cumsum(sizes) - 1]
        found = np.fromiter(map(self.table.get, words, repeat(0)), np.int32, len(words))
        return np.where(found > 0, found, self.rare + 16 * (np.minimum(sizes, 16) - 1) + last % 16).astype(np.int32)


@dataclass
class Network:
    """Embeddings per offset, summed and squashed; a class softmax, then one within the class."""

    inputs: np.ndarray  # offset, token, width
    outer: np.ndarray  # class, width + 1
    inner: np.ndarray  # class, member, width + 1

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        size = CLASSES * MEMBERS
        return cls(rng.normal(0, 0.3, (len(OFFSETS), size, WIDTH)).astype(np.float32),
                   np.zeros((CLASSES, WIDTH + 1), np.float32), np.zeros((CLASSES, MEMBERS, WIDTH + 1), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.outer, self.inner]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Network:
        like, at, out = cls.fresh(), 0, []
        for part in like.parts():
            out.append(flat[at:at + part.size].reshape(part.shape).astype(np.float32))
            at += part.size
        return cls(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Squashed sums with a constant 1 at the end, one column per position; ``around`` is (offset, position)."""
        total = self.inputs[0][around[0]]
        for table, ids in zip(self.inputs[1:], around[1:], strict=True):
            total = total + table[ids]
        return np.vstack([np.tanh(total.T), np.ones((1, len(total)), np.float32)])

    def log_probs(self, around: np.ndarray, target: np.ndarray, grads: list[np.ndarray] | None = None) -> np.ndarray:
        """log p(token | both sides) of every position; fills ``grads`` of their mean when given.

        Positions are put in the order of their classes once, so that a class is a slice.
        """
        # So few classes fit a byte, whose stable sort is a count.
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")
        around, target = around[:, order], target[order]
        h = self.hidden(around)
        group, member = target // MEMBERS, target % MEMBERS
        every, share = np.arange(len(target)), 1 / max(1, len(target))
        if grads is None:
            logs = np.log(_chosen(self.outer @ h, group, every))
        else:
            p = _softmax(self.outer @ h)
            logs = np.log(p[group, every])
            p[group, every] -= 1
            grads[1] += share * (p @ h.T)
            back = share * (self.outer.T @ p)
        ends = np.searchsorted(group, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            own = slice(ends[c], ends[c + 1])
            if ends[c] == ends[c + 1]:
                continue
            within = every[:ends[c + 1] - ends[c]]
            if grads is None:
                logs[own] += np.log(_chosen(self.inner[c] @ h[:, own], member[own], within))
            else:
                q = _softmax(self.inner[c] @ h[:, own])
                logs[own] += np.log(q[member[own], within])
                q[member[own], within] -= 1
                grads[2][c] += share * (q @ h[:, own].T)
                back[:, own] += share * (self.inner[c].T @ q)
        if grads is not None:
            # Both in the types that the counts are made in.
            back = (back[:-1] * (1 - h[:-1] ** 2)).astype(np.float64)
            for table, ids in zip(grads[0], around.astype(np.intp), strict=True):
                for d in range(WIDTH):
                    table[:, d] += np.bincount(ids, weights=back[d], minlength=len(table))
        out = np.empty_like(logs)
        out[order] = logs
        return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    """Of each column."""
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return np.maximum(scores, np.float32(1e-12), out=scores)


def _chosen(scores: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """One value of each column of ``_softmax``; the others are not divided."""
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    return np.maximum(scores[row, column] / scores.sum(axis=0), np.float32(1e-12))


def positions(texts: list[bytes], vocabulary: Vocabulary, cut: list[list[bytes]] | None = None
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(around, target, words per text) of all tokens of all texts; texts do not see each other.

    ``cut`` are the words of the texts where they are known.
    """
    cut = [t.split() for t in texts] if cut is None else cut
    sizes = np.array([len(w) for w in cut], dtype=np.int64)
    line = np.zeros(PAD + int(sizes.sum()) + PAD * len(texts), dtype=np.int32)
    first = PAD + np.cumsum(np.r_[0, sizes[:-1] + PAD]) if len(texts) else np.zeros(0, np.int64)
    at = np.repeat(first - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(int(sizes.sum()))
    line[at] = vocabulary.ids([w for words in cut for w in words])
    return np.stack([line[at + o] for o in OFFSETS]), line[at], sizes


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8, in steps of about SLICE bytes; a text is never cut."""
    held, size, first = [], 0, 0
    for n, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLICE:
            yield first, held
            held, size, first = [], 0, n + 1
    if held:
        yield first, held


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text")


def kind_of(word: Column) -> Column:
    """Number of a word among the kinds of words without a token of their own, as ``Vocabulary.ids`` has it."""
    data = word.cast("binary")
    last = F.conv(F.hex(F.substring(data, -1, 1)), 16, 10).cast("int")
    return 16 * (F.least(F.octet_length(data), F.lit(16)) - 1) + last % 16


def build_vocabulary(docs: DataFrame, text_col: str = "text", near: int = NEAR) -> Vocabulary:
    """Counts every word of the corpus in a table in the shared folder.

    The driver sees the words that get a token of their own, at most ``near`` more, and sums per kind and frequency.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = [w.decode() for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "count"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update((text or b"").split())
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    path = scratch(docs.sparkSession, "words")
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, COUNTS)
    found.groupBy("word").agg(F.sum("count").alias("count")).write.option("compression", "zstd").parquet(path)
    counts = docs.sparkSession.read.schema(COUNTS).parquet(path)
    own = CLASSES * MEMBERS - RARE - 1
    # Words of about one frequency stand or fall together, so that the driver gets no more than it keeps.
    steps = F.floor(F.log2("count") * 16)
    least, held = None, 0
    for r in sorted(counts.groupBy(steps.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if held + r["count"] > own + near:
            break
        least, held = r["step"], held + r["count"]
    chosen = counts.where(steps >= least) if held >= own or least is not None and held == counts.count() else counts.orderBy(
        F.desc("count"), "word").limit(own)
    top = sorted(((r["word"].encode(), r["count"]) for r in chosen.collect()), key=lambda x: (-x[1], x[0]))
    totals = np.zeros(RARE, dtype=np.int64)
    for r in counts.groupBy(kind_of(F.col("word")).alias("kind")).agg(F.sum("count").alias("n")).collect():
        totals[r["kind"]] = r["n"]
    rare = Vocabulary([])
    if top:
        np.subtract.at(totals, rare.ids([w for w, _ in top[:own]]) - rare.rare, [n for _, n in top[:own]])
    return Vocabulary([w for w, _ in top[:own]], dict(top[own:]), totals, path)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Each round, every task learns from all tokens of its partition and the results average by token counts.

    Parameters travel as blocks and are averaged block by block in a shuffle: what is gathered grows
    with the partitions, and the driver sees one network a round.
    """
    network = Network.fresh()
    block = 4096

    def learn(start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Network.unpack(start), 0
            squares = [np.full_like(p, 1e-6) for p in own.parts()]
            for batch in batches:
                for _, texts in slices(batch):
                    around, target, _ = positions(texts, vocabulary)
                    for at in range(0, len(target), BATCH):
                        grads = [np.zeros_like(p) for p in own.parts()]
                        own.log_probs(around[:, at:at + BATCH], target[at:at + BATCH], grads)
                        for part, grad, square in zip(own.parts(), grads, squares, strict=True):
                            square += grad * grad
                            part -= RATE * grad / np.sqrt(square)
                    seen += len(target)
            flat = own.pack()
            pieces = [flat[at:at + block].tobytes() for at in range(0, len(flat), block)]
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(pieces)), pa.int32()), pa.array([seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())],
                    ["block", "seen", "values"])

        return run

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        total = frame["seen"].sum()
        values = sum(np.frombuffer(v, np.float32).astype(np.float64) * (n / total) for v, n in zip(frame["values"], frame["seen"], strict=True))
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "seen": [total], "values": [values.astype(np.float32).tobytes()]})

    schema = "block int, seen long, values binary"
    for _ in range(rounds):
        learned = _rows(docs, id_col, text_col).mapInArrow(learn(network.pack()), schema)
        # Sums meet in two steps, so that no task gathers a block from all partitions.
        learned = learned.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(32)))
        partly = learned.groupBy("block", "some").applyInPandas(lambda f: average(f), schema)
        found = sorted(partly.groupBy("block").applyInPandas(lambda f: average(f), schema).collect(), key=lambda r: r["block"])
        if found:
            network = Network.unpack(np.concatenate([np.frombuffer(r["values"], np.float32) for r in found]))
    return network


def _score_near(docs: DataFrame, vocabulary: Vocabulary, network: Network, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_tokens, log_likelihood, far): sums over all tokens, but for the shares of the words ``far`` in their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = vocabulary.near.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in slices(batch):
                cut = [t.split() for t in texts]
                around, target, sizes = positions(texts, vocabulary, cut)
                found = [network.log_probs(around[:, at:at + BATCH], target[at:at + BATCH]) for at in range(0, len(target), BATCH)]
                logs = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
                words = [w for own in cut for w in own]
                rare = np.flatnonzero(target >= vocabulary.rare) if vocabulary.path else np.zeros(0, np.int64)
                shares = np.array([get(words[n], np.nan) for n in rare.tolist()], dtype=np.float64)
                lost = rare[np.isnan(shares)]
                logs[rare] += np.nan_to_num(shares)
                ends = np.cumsum(np.r_[0.0, logs])
                stop = np.cumsum(sizes)
                offsets = np.searchsorted(lost, np.r_[0, stop])
                far = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([words[n].decode() for n in lost.tolist()], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(texts))), batch.column(0).slice(first, len(texts)), pa.array(sizes),
                     pa.array(ends[stop] - ends[stop - sizes]), far],
                    ["row", "id", "n_tokens", "log_likelihood", "far"])
                row += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(
        run, f"row long, id {kind}, n_tokens long, log_likelihood double, far array<string>")


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_prob) per row: every token predicted from both of its sides.

    A word without a token of its own counts with log p(its kind | both sides) + log p(word | kind), the
    latter from the counts of the vocabulary.  Null text is empty; a text without words has no tokens,
    sum 0 and a null mean.  Repeated rows score alike; no rows give no rows; other columns are not read.
    """
    scored = _score_near(docs, vocabulary, network, id_col, text_col)
    if vocabulary.path:
        # Written once, so that rows keep their numbers.
        scored = staged(scored, "scored")
        counts = docs.sparkSession.read.schema(COUNTS).parquet(vocabulary.path).select(F.col("word").alias("w"), "count")
        total = F.element_at(F.array(*[F.lit(int(n)) for n in vocabulary.totals + 1]), kind_of(F.col("word")) + 1)
        # None of these words is hot: the frequent ones have tokens of their own.
        far = scored.select("row", F.explode("far").alias("word")).join(counts, F.col("word") == F.col("w"), "left")
        rest = far.groupBy(F.col("row").alias("r")).agg(F.sum(F.log(F.coalesce("count", F.lit(1)) / total)).alias("rest"))
        scored = scored.drop("far").join(rest, F.col("row") == F.col("r"), "left").withColumn(
            "log_likelihood", F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all documents and score them all; see ``score``."""
    vocabulary = build_vocabulary(docs, text_col)
    return score(docs, vocabulary, train(docs, vocabulary, rounds, id_col, text_col), id_col, text_col)
