"""Phrase mining over a weighted de Bruijn graph of word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import checkpointed, staged, text_or_empty

LONGEST = 4
# Counters of word pairs: blocks of 2 ** 16 counters each; 2 ** 27 bits, 16 MB, tell the tasks which may be frequent.
BLOCKS, BLOCK_BITS = 1 << 11, 16
# Bytes of text in one step, and pairs counted before they are sent.
SLICE, HELD = 1 << 22, 1 << 22
# A-Z in lower case; [.,;:!?\x0A-\x0D] end a piece; words are parted by blanks and tabs.
PIECE_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) in steps of about SLICE bytes of one language; a text is never cut."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= SLICE:
                yield lang, held.pop(lang)
                del sizes[lang]
    yield from held.items()


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, word number of each place, whether the next place is in the same piece)."""
    pieces = b"\n".join(texts).translate(PIECE_BYTES).split(b"\n")
    cut = [p.split() for p in pieces]
    flat = [w for ws in cut for w in ws]
    names = list(dict.fromkeys(flat))
    number = {w: i for i, w in enumerate(names)}
    ids = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
    ends = np.cumsum([len(ws) for ws in cut])
    goes_on = np.ones(len(flat), dtype=bool)
    goes_on[ends[ends > 0] - 1] = False
    return names, ids, goes_on


def _pair_places(lang: str, names: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Counter of the pair that starts at each place but the last."""
    import xxhash

    seed = xxhash.xxh32_intdigest(lang)
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in names], dtype=np.uint64)[ids]
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BLOCK_BITS - (BLOCKS.bit_length() - 1))).astype(np.uint32)


def pair_filter(rows: DataFrame, least: int) -> np.ndarray:
    """A bit per counter: whether the word pairs that share it occur ``least`` times together.  A pair without its bit is rare.

    Tasks send the counters they touched, packed by block, and a block is summed row by row, so
    no task holds more than one block.  The result has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            places, n = np.unique(np.concatenate(held), return_counts=True)
            # More than ``least`` adds nothing to know.
            n = np.minimum(n, min(least, 255)).astype(np.uint8)
            block, first = np.unique(places >> BLOCK_BITS, return_index=True)
            stops = np.r_[first[1:], len(places)]
            low = (places & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            return pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(first, stops)], pa.binary()),
                 pa.array([n[a:b].tobytes() for a, b in zip(first, stops)], pa.binary())], ["block", "low", "n"])

        size = 0
        for lang, texts in _slices(batches):
            names, ids, goes_on = _words(texts)
            if len(ids) > 1:
                held.append(_pair_places(lang, names, ids)[goes_on[:-1]])
                size += len(held[-1])
            if size >= HELD:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, np.zeros(1 << BLOCK_BITS, dtype=np.int64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["block", "bits"])

        for batch in batches:
            for block, low, n in zip(*(batch.column(c).to_pylist() for c in ("block", "low", "n")), strict=True):
                if block != own:
                    if own is not None:
                        yield bits()
                    own = block
                    total[:] = 0
                total[np.frombuffer(low, np.uint16)] += np.frombuffer(n, np.uint8)
        if own is not None:
            yield bits()

    if least > 255:
        raise ValueError("a phrase may be asked to occur 255 times at most")
    counted = rows.mapInArrow(count, "block int, low binary, n binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((BLOCKS, (1 << BLOCK_BITS) // 8), dtype=np.uint8)
    for row in counted.mapInArrow(add, "block int, bits binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def longest_grams(rows: DataFrame, least: int) -> DataFrame:
    """(lang, gram, n): each place of a word counts once, with the longest gram that starts there.

    A gram has LONGEST words, or fewer where the piece ends first.  A piece also ends
    between two words that are too rare a pair to lie in a phrase or to be a part of one.
    """
    may = rows.sparkSession.sparkContext.broadcast(pair_filter(rows, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = may.value
        for lang, texts in _slices(batches):
            names, ids, goes_on = _words(texts)
            if not len(ids):
                continue
            if len(ids) > 1:
                place = _pair_places(lang, names, ids)
                goes_on[:-1] &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            alone = ~goes_on
            single = np.bincount(ids[alone], minlength=len(names))
            grams = [names[i] for i in np.flatnonzero(single)]
            counts = [single[single > 0]]
            at = np.flatnonzero(goes_on)
            if len(at):
                table = np.full((len(at), LONGEST), -1, dtype=np.int32)
                table[:, 0] = ids[at]
                open_ = np.ones(len(at), dtype=bool)
                for k in range(1, LONGEST):
                    open_ &= goes_on[np.minimum(at + k - 1, len(ids) - 1)]
                    table[open_, k] = ids[at[open_] + k]
                found, n = np.unique(np.ascontiguousarray(table).view(f"V{4 * LONGEST}").ravel(), return_counts=True)
                for own in found.view(np.int32).reshape(-1, LONGEST).tolist():
                    grams.append(b" ".join([names[i] for i in own if i >= 0]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array([g.decode() for g in grams], pa.string()),
                 pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "gram", "n"])

    found = rows.mapInArrow(run, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _size(gram: Column) -> Column:
    return F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1


def _first(words: int, gram: str = "gram") -> Column:
    return F.substring_index(gram, " ", words)


def _last(words: int, gram: str = "gram") -> Column:
    return F.substring_index(gram, " ", -words)


def compacted(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """(lang, path, n): maximal paths of ``edges`` (lang, gram, n) through ``inner`` nodes (lang, node), as strings of words.

    Every edge learns its first edge and its distance from it by pointer doubling, so rounds grow with the
    logarithm of the longest path.  A path lies whole within one piece of a text, as no
    occurrence starts or ends at an inner node.
    """
    ends = edges.select("lang", "gram", _first(LONGEST - 1).alias("from"), _last(LONGEST - 1).alias("to"))
    through = ends.select(F.col("lang").alias("l"), F.col("gram").alias("before"), F.col("to").alias("node")).join(
        inner.withColumnRenamed("lang", "il").withColumnRenamed("node", "i"), (F.col("l") == F.col("il")) & (F.col("node") == F.col("i")))
    pointed = ends.join(through.select("l", "before", "node"), (F.col("lang") == F.col("l")) & (F.col("from") == F.col("node")), "left")
    # ``far`` edges back lies ``head``; an edge that points to itself is a first one.
    now = checkpointed(pointed.select("lang", "gram", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("long").alias("far")))
    open_ = now.where("far > 0")
    while not open_.isEmpty():
        ahead = now.select(F.col("lang").alias("l"), F.col("gram").alias("g"), F.col("head").alias("next"), F.col("far").alias("more"))
        now = checkpointed(now.join(ahead, (F.col("lang") == F.col("l")) & (F.col("head") == F.col("g"))).select(
            "lang", "gram", F.col("next").alias("head"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")))
        open_ = now.where("moved")
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("far", _last(1).alias("word")))), lambda x: x["word"]), " ")
    paths = now.groupBy("lang", "head").agg(words.alias("rest"))
    weights = edges.select(F.col("lang").alias("l"), F.col("gram").alias("g"), "n")
    return paths.join(weights, (F.col("lang") == F.col("l")) & (F.col("head") == F.col("g"))).select(
        "lang", F.concat_ws(" ", _first(LONGEST - 1, "head"), "rest").alias("path"), "n")


def phrase_counts(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, size, n), inner nodes of paths (lang, node), and words per language (lang, n).

    The longest grams are edges between the nodes of one word less.  A node's count is the flow
    out of it and the pieces that end with it; the next shorter counts follow from the nodes in
    the same way.  Nodes with one way in, one way out and no piece that starts or ends there are inner nodes of
    a path, whose edges and nodes share one count.
    """
    grams = staged(longest_grams(rows, least), "grams").withColumn("size", _size(F.col("gram")))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("n"))
    edges = grams.where(F.col("size") == LONGEST)
    counts, levels = edges, [edges.where(F.col("n") >= least)]
    for size in range(LONGEST - 1, 0, -1):
        flow = counts.select("lang", _first(size).alias("gram"), "n", F.lit(0).cast("long").alias("ends"), F.lit(1).alias("out"))
        ends = grams.where(F.col("size") == size).select("lang", "gram", "n", F.col("n").alias("ends"), F.lit(0).alias("out"))
        sums = flow.unionByName(ends).groupBy("lang", "gram").agg(
            F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("out").alias("out")).withColumn("size", F.lit(size))
        counts = staged(sums, f"flow-{size}")
        levels.append(counts.where(F.col("n") >= least))
        if size == LONGEST - 1:
            nodes = counts
    ins = edges.groupBy("lang", _last(LONGEST - 1).alias("node")).agg(F.sum("n").alias("inflow"), F.count(F.lit(1)).alias("in"))
    through = nodes.where((F.col("n") >= least) & (F.col("out") == 1) & (F.col("ends") == 0)).join(
        ins.withColumnRenamed("lang", "l"), (F.col("lang") == F.col("l")) & (F.col("gram") == F.col("node")))
    inner = checkpointed(through.where((F.col("in") == 1) & (F.col("inflow") == F.col("n"))).select("lang", F.col("gram").alias("node")))
    paths = compacted(levels[0], inner)
    words = F.split("path", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - LONGEST + 1), lambda i: F.array_join(F.slice(words, i, LONGEST), " "))
    longest = paths.select("lang", F.explode(windows).alias("phrase"), F.lit(LONGEST).alias("size"), "n")
    shorter = [x.select("lang", F.col("gram").alias("phrase"), "size", "n") for x in levels[1:]]
    frequent = longest
    for x in shorter:
        frequent = frequent.unionByName(x)
    return checkpointed(frequent), inner, totals


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` best phrases of two to four words per language: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, a null language ``und``.  ``a`` counts the phrase, ``l`` and ``r`` the parts at its
    weakest cut, ``n`` all words of the language; ``score`` is floor(2000000 a / (l + r)).  Phrases that
    occur less than ``least`` times (at most 255 may be asked), or inside one longer phrase ``share`` percent of
    their times, are left out.  Ties go to more occurrences, then to the smaller phrase in bytes.  Repeated rows count
    each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    frequent, inner, totals = phrase_counts(rows, least)
    long_ = frequent.where("size > 2").withColumn("words", F.split("phrase", " "))

    def inside(size: int):
        return F.transform(F.sequence(F.lit(1), F.col("size") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))

    subs = long_.select("lang", "n", F.explode(F.concat(inside(2), F.when(F.col("size") > 3, inside(3)).otherwise(F.array()))).alias("phrase"))
    covers = subs.groupBy(F.col("lang").alias("l"), F.col("phrase").alias("p")).agg(F.max("n").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # Inner nodes of a path lie in its edges as often as they occur: they are covered.
    kept = frequent.where("size > 1").join(
        inner.withColumnRenamed("lang", "il"), (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("node")), "left_anti")
    kept = kept.join(covers, (F.col("lang") == F.col("l")) & (F.col("phrase") == F.col("p")), "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("n") * share)).select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"),
        F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("right")))
    cuts = kept.select("lang", "phrase", "a", F.explode(cut).alias("cut")).select("lang", "phrase", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        part = frequent.where(F.col("size") < LONGEST).select(F.col("lang").alias("pl"), F.col("phrase").alias("pp"), F.col("n").alias(name))
        cuts = cuts.join(part, (F.col("lang") == F.col("pl")) & (F.col(side) == F.col("pp"))).drop("pl", "pp")
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = totals.select(F.col("lang").alias("tl"), "n")
    return ranked.join(totals, F.col("lang") == F.col("tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
