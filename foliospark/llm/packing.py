"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import base64
import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import staged

WINDOW = 1024
OPEN = 128
# Partitions whose leftovers meet in one group; a group holds FAN * OPEN windows at most.
FAN = 64
# Numbers of merged sequences start here, above those of all partitions.
MERGED = 1 << 62
# Unbroken runs from which the rank tokenizer would slow down; such texts go to the other library.
LONG_RUN = 2000
PIECE = "id {id}, start long, length long, doc_tokens long, ids binary, window long, at long, fill long, open boolean"


def has_long_run(text: str, size: int = LONG_RUN) -> bool:
    """Whether ``size`` characters in a row are all blank or all not; looks around every ``size``-th character,
    as any such run holds one."""
    for at in range(size - 1, len(text), size):
        blank, low, high = text[at].isspace(), at, at
        while low > 0 and at - low < size and text[low - 1].isspace() == blank:
            low -= 1
        while high + 1 < len(text) and high - low + 1 < size and text[high + 1].isspace() == blank:
            high += 1
        if high - low + 1 >= size:
            return True
    return False


class ByteTokenizer:
    """Byte-level BPE ids of whole texts.

    The rank file holds the same vocabulary as the tokenizer file and gives the
    same ids several times faster; texts with very long unbroken runs are
    encoded by the tokenizer file itself.  With ``added`` the strings of the tokenizer
    file's added tokens become their ids, as in the library's plain call, and texts
    that hold one go to the tokenizer file too; without, they are ordinary text.
    """

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str, added: bool = False):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow, self.marks = tokenizer_file, None, []
        if added:
            with open(tokenizer_file, encoding="utf-8") as file:
                self.marks = [t["content"] for t in json.load(file).get("added_tokens", [])]

    def encode(self, text: str) -> np.ndarray:
        if not has_long_run(text) and not any(m in text for m in self.marks):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
            self.slow.encode_special_tokens = not self.marks
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


@cache
def byte_tokenizer(files: tuple[str, str, str], added: bool) -> ByteTokenizer:
    """One tokenizer per Python worker, whatever the number of its tasks."""
    return ByteTokenizer(*files, added=added)


class Windows:
    """At most ``count`` open windows of ``size``; ``closed`` gathers the finished ones."""

    def __init__(self, size: int, count: int):
        self.size, self.count, self.made = size, count, 0
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.closed: list[tuple[int, list]] = []

    def place(self, length: int, piece) -> None:
        """Best fit; when nothing fits and no window may open, the fullest one closes."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.count:
                self.close(self.free.pop(0)[1])
            room, number = self.size, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append((self.size - room, piece))
        if room == length:
            self.close(number)
        else:
            insort(self.free, (room - length, number))

    def close(self, number: int) -> None:
        self.closed.append((number, self.held.pop(number)))

    def drain(self) -> list[tuple[int, list]]:
        out, self.closed = self.closed, []
        return out


def _windows(docs: DataFrame, tokenizer: tuple[str, str, str], end_id: int, size: int, count: int,
             id_col: str, text_col: str, added: bool) -> DataFrame:
    """Pieces with their window; windows still open at the end of a partition are marked."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECE.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_tokenizer(tokenizer, added)
        base = TaskContext.get().partitionId() << 36
        windows = Windows(size, count)
        names = ("start", "length", "doc_tokens", "ids", "window", "at", "fill", "open")
        types = (*[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 3, pa.bool_())

        def rows(found, still_open, id_type):
            out, keys = [], []
            for number, pieces in found:
                fill = sum(p[1][2] for p in pieces)
                for at, (key, start, length, total, ids) in pieces:
                    keys.append(key)
                    out.append((start, length, total, ids, base + number, at, fill, still_open))
            columns = zip(*out) if out else [[] for _ in names]
            arrays = [pa.array(keys, id_type), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["id", *names])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            ready = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(text or ""), end_id).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size]
                    windows.place(len(piece), (key, start, len(piece), len(ids), piece.tobytes()))
                ready += len(ids)
                if ready > 1 << 20:
                    yield rows(windows.drain(), False, id_type)
                    ready = 0
            yield rows(windows.drain(), False, id_type)
        yield rows([(n, windows.held[n]) for _, n in windows.free], True, id_type)

    source = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text")
    return source.mapInArrow(run, schema)


def merge_leftovers(pieces: DataFrame, size: int, fan: int = FAN) -> DataFrame:
    """Pieces of open windows laid end to end and cut at every ``size`` ids.

    ``pieces`` has the columns of PIECE and ``slot``, the partition they come from.
    Each round lays out the windows of ``fan`` slots, at most ``fan`` times the open windows
    of one, and hands its one last window on, until one group is left.  A window's
    pieces stay together but for the cut at a sequence's end.
    """
    done, rest, turn = None, pieces, 0
    while True:
        group = F.floor(F.col("slot") / fan).cast("long")
        windows = rest.select("window", F.col("fill").alias("held"), group.alias("slot")).distinct()
        so_far = F.sum("held").over(Window.partitionBy("slot").orderBy("window"))
        laid = windows.withColumns({
            "first": so_far - F.col("held"), "end": so_far,
            "total": F.sum("held").over(Window.partitionBy("slot"))})
        number = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("end") - 1) / size)))
        parts = laid.select("*", number.alias("number")).select(
            F.col("window").alias("w"), F.col("slot").alias("group"),
            (F.greatest("first", F.col("number") * size) - F.col("first")).alias("low"),
            (F.least("end", (F.col("number") + 1) * size) - F.col("first")).alias("high"),
            (F.greatest("first", F.col("number") * size) - F.col("number") * size).alias("shift"),
            F.least(F.lit(size), F.col("total") - F.col("number") * size).alias("new_fill"),
            (F.lit(MERGED + (turn << 56)) + F.shiftleft("slot", 32) + F.col("number")).alias("target"))
        met = rest.join(parts, (F.col("window") == F.col("w")) & (F.col("at") < F.col("high"))
                        & (F.col("at") + F.col("length") > F.col("low")))
        skip = F.greatest("at", "low") - F.col("at")
        length = F.least(F.col("at") + F.col("length"), F.col("high")) - F.greatest("at", "low")
        moved = staged(met.select(
            "id", (F.col("start") + skip).alias("start"), length.alias("length"), "doc_tokens",
            F.substring("ids", (skip * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"), F.col("target").alias("window"),
            (F.greatest("at", "low") - F.col("low") + F.col("shift")).alias("at"),
            F.col("new_fill").cast("long").alias("fill"), "open", F.col("group").alias("slot")), "merged")
        if not moved.agg(F.max("slot")).first()[0]:
            return moved if done is None else done.unionByName(moved)
        full = moved.where(F.col("fill") == size)
        done = full if done is None else done.unionByName(full)
        rest, turn = moved.where(F.col("fill") < size), turn + 1


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str, str], end_id: int = 0, size: int = WINDOW,
                   count: int = OPEN, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Pieces of all documents: id, start, length, doc_tokens, ids, sequence_id, offset.

    A document is its token ids and ``end_id``, cut every ``size`` ids; null text
    is empty and gives ``end_id`` alone.  A task keeps ``count`` open windows and places
    each piece best-fit.  What is open at a partition's end is merged across
    partitions, cut where a sequence is full; one sequence may stay short.  ``ids`` is binary, little-endian unsigned 32-bit.  Repeated
    rows are packed each for itself; no rows give no pieces; other columns are
    not read.  ``tokenizer`` is (tokenizer file, rank file, pattern); ``added`` maps the
    strings of its added tokens in a text to their ids.

    The pieces are written once to the shared folder, so that a task run again
    cannot change a window half of which was already merged.
    """
    pieces = staged(_windows(docs, tokenizer, end_id, size, count, id_col, text_col, added), "pieces")
    rest = merge_leftovers(pieces.where("open").withColumn("slot", F.shiftright("window", 36)), size)
    return pieces.where("NOT open").unionByName(rest.drop("slot")).select(
        F.col("id").alias(id_col), "start", "length", "doc_tokens", "ids", F.col("window").alias("sequence_id"),
        F.col("at").alias("offset"))
