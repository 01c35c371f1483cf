"""SentencePiece encoding and decoding through distinct-chunk tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
# A run of spaces with the word behind it; the marker of the run's first space is the chunk's own.
CHUNK = re.compile(r" *[^ ]+| +")
# Bound of a worker's table: characters of its chunks, and so many more for each entry.
TABLE_CHARS = 64_000_000
ENTRY_CHARS = 64


class ChunkTable:
    """Ids of each distinct marked word seen, segmented once.

    No piece of the model may hold a marker after another character; then no
    merge crosses the start of a marked word, and the ids of a text are its
    words' ids in order.  The table restarts when its bound is reached.
    """

    def __init__(self, model: str, bound: int = TABLE_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces cross white-space markers: texts cannot be cut at words")
        if self.model.encode("a") == self.model.encode(" a") or self.model.encode("a  b") == self.model.encode("a b"):
            raise ValueError("the model folds white space: texts cannot be cut at words")
        self.bound, self.held = bound, 0
        self.table: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Marked words of a text, each without its first marker."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(" " + text)]

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.table]
        weight = lambda chunks: sum(map(len, chunks)) + ENTRY_CHARS * len(chunks)
        if self.held + weight(fresh) > self.bound:
            self.table, self.held, fresh = {}, 0, list(words)
        self.held += weight(fresh)
        for word, ids in zip(fresh, self.model.encode(fresh, num_threads=1), strict=True):
            # A lone marker is an empty word: the library encodes nothing for it.
            self.table[word] = np.array(ids if word else [self.model.piece_to_id(MARK)], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts, without begin and end."""
        cut = [self.chunks(t) for t in texts]
        self.learn(set().union(*cut) if cut else set())
        return [b"".join(map(self.table.__getitem__, words)) for words in cut]


@cache
def chunk_table(model: str, bound: int) -> ChunkTable:
    """One table per Python worker: later tasks find the words of earlier ones."""
    return ChunkTable(model, bound)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     bound: int = TABLE_CHARS) -> DataFrame:
    """(id, ids, decoded) per row: ids with begin and end, and the text they decode to.

    ``ids`` is binary, little-endian unsigned 32-bit.  Null text encodes as
    empty: begin and end only.  Each row stands for itself, so repeated rows and
    ids repeat; no rows give no rows; other columns are not read.  The step is narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model, bound)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (table.model.bos_id(), table.model.eos_id()))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = [begin + x + end for x in table.encode(texts)]
                decoded = [table.model.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS STRING) AS text")
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
