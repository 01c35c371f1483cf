"""Encoding and packing against the tokenizer libraries on awkward texts."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm.encode import ENTRY_CHARS, ChunkTable, encode_documents
from foliospark.llm.packing import PIECE, ByteTokenizer, has_long_run, merge_leftovers, pack_documents
from foliospark.llm.queries import BYTES, PIECES

TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b   c", "\n\n a\tb\r\n", "▁x▁▁y ▁", "Ünïcode ☃ 日本語 🙂🙂", "x" * 40_000,
    "\x00 nul", "the the the", "<s> </s> <unk> <|endoftext|>", "word " * 5_000, "   wide", "é é", " " * 5_000,
]
ROWS = [(i, t, "ids", i) for i, t in enumerate(TEXTS)] + [(3, "   ", "again", 0), (None, "no id", None, None)]
SCHEMA = "doc_id long, text string, ids string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encode_equals_library(docs, library):
    found = encode_documents(docs, PIECES).collect()
    expected = []
    for key, text, *_ in ROWS:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        expected.append((key, np.array(ids, dtype="<u4").tobytes(), library.decode(ids)))
    order = lambda rows: sorted(map(str, rows))
    assert order([(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in found]) == order(expected)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=4))
def test_small_table_restarts(texts):
    table = ChunkTable(PIECES, 400)
    for _ in range(2):
        for text, ids in zip(texts, table.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == table.model.encode(text)
        assert table.held == sum(len(w) + ENTRY_CHARS for w in table.table)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_rank_file_equals_tokenizer_file(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTES[0])
    whole.encode_special_tokens = True
    assert ByteTokenizer(*BYTES).encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>  \n<|endoftext", "é" * 3000 + "<|endoftext|>", "plain"])
def test_added_tokens_equal_plain_call(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES[0]).encode(text, add_special_tokens=False).ids
    assert ByteTokenizer(*BYTES, added=True).encode(text).tolist() == plain
    assert (50256 in plain) == ("<|endoftext|>" in text)


@pytest.mark.parametrize("name", ["op3_packing", "pipeline"])
def test_queries_give_ids_of_added_tokens(spark, tmp_path, name):
    import __spark_entry__ as contract
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|> other words", "no mark"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["doc_tokens"] for r in contract.queries()[name](spark, str(tmp_path)).where("start = 0").collect()}
    whole = Tokenizer.from_file(BYTES[0])
    for key, text in enumerate(texts):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        assert found[key] == len(ids)
    assert len(found) == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab \n"), st.integers(1, 12)), max_size=12))
def test_long_runs(parts):
    text = "".join(c * n for c, n in parts)
    assert has_long_run(text, 7) == bool(re.search(r"\S{7}|\s{7}", text))


def rebuild(pieces, size):
    windows: dict = {}
    documents: dict = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4")
        assert len(ids) == p["length"] > 0
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        documents.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return windows, documents


@pytest.mark.parametrize("size,count", [(1024, 128), (16, 2), (7, 1)])
def test_packing_keeps_every_id(docs, size, count):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTES[0])
    whole.encode_special_tokens = True
    pieces = pack_documents(docs, BYTES, size=size, count=count).collect()
    windows, documents = rebuild(pieces, size)
    expected = {}
    for key, text, *_ in ROWS:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        expected.setdefault((key, len(ids)), []).append(ids)
    assert set(documents) == set(expected)
    for key, parts in documents.items():
        copies = expected[key]
        ids = {s: x.tolist() for s, x in parts}
        assert len(parts) == len(copies) * len(ids)
        assert [t for s in sorted(ids) for t in ids[s]] in copies


def test_padding_is_little(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 900)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    windows, documents = rebuild(pack_documents(docs, BYTES).collect(), 1024)
    used = sum(length for parts in windows.values() for _, length in parts)
    assert used / (1024 * len(windows)) > 0.97


def test_leftovers_merge_over_rounds(spark):
    rows = []
    for slot in range(30):
        for w in range(4):
            ids = np.arange(300 + w, dtype="<u4") + 1000 * (slot * 4 + w)
            for a, b in ((0, 100), (100, len(ids))):
                rows.append((slot, a, b - a, len(ids), bytearray(ids[a:b].tobytes()), slot << 36 | w, a, len(ids), True, slot))
    schema = PIECE.format(id="long") + ", slot long"
    moved = merge_leftovers(spark.createDataFrame(rows, schema), 1024, fan=3)
    pieces = moved.withColumnsRenamed({"window": "sequence_id", "at": "offset", "id": "doc_id"}).collect()
    fills = {}
    for p in pieces:
        fills[p["sequence_id"]] = fills.get(p["sequence_id"], 0) + p["length"]
    total = sum(len(r[4]) // 4 for r in rows)
    assert sorted(fills.values()) == [total % 1024] + [1024] * (total // 1024)
    rebuild(pieces, 1024)
    found = np.sort(np.concatenate([np.frombuffer(p["ids"], dtype="<u4") for p in pieces]))
    assert found.tolist() == sorted(x for r in rows for x in np.frombuffer(bytes(r[4]), dtype="<u4").tolist())
    for p in pieces:
        assert np.frombuffer(p["ids"], dtype="<u4")[0] % 1000 == p["start"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert encode_documents(none, PIECES).count() == 0
    assert pack_documents(none, BYTES).count() == 0
