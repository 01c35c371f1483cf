"""The pipeline against a brute-force version, and its entry in the registry."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from conftest import SF
from foliospark.llm.queries import BYTES
from test_dedup import classes


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", plain_lower(text)) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows):
    """Ids left by the first three stages: a letter, last of its equal texts, first of those that share 0.8 of their shingles."""
    lettered = [(k, t) for k, t in rows if any(unicodedata.category(c)[0] == "L" for c in t or "")]
    last: dict = {}
    for key, text in lettered:
        last[plain_lower(text)] = max(key, last.get(plain_lower(text), key))
    single = sorted((k, t) for k, t in lettered if last[plain_lower(t)] == k)
    sets = [plain_shingles(t) for _, t in single]
    pairs = [(a, b) for a in range(len(single)) for b in range(a)
             if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    first = classes(len(single), pairs)
    return {k: t for n, (k, t) in enumerate(single) if first[n] == n}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents and a few awkward ones."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = max(r["doc_id"] for r in docs.select("doc_id").collect()) + 1
    long = " ".join(f"word{i}" for i in range(3000))
    texts = [None, "", "12 34", "!", "² ½ ③", "ABC def", "abc DEF", long, long.replace("word7 ", "other "), long + " end", "one two three"]
    more = spark.createDataFrame([(base + i, t, None, "x", len(t or "")) for i, t in enumerate(texts)], docs.schema)
    docs.union(more).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in contract.queries()
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pipeline_equals_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    expected = survivors(rows)
    assert len(expected) < len(rows)
    pieces = contract.queries()["pipeline"](spark, folder).collect()
    tokenizer = Tokenizer.from_file(BYTES[0])
    found: dict = {}
    windows: dict = {}
    for p in pieces:
        found.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], dtype="<u4").tolist()))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(found) == set(expected)
    for key, parts in found.items():
        ids = [*tokenizer.encode(expected[key], add_special_tokens=False).ids, 0]
        assert [x for _, piece in sorted(parts) for x in piece] == ids
    assert all(sum(n for _, n in w) <= 1024 for w in windows.values())


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("source", "component_id")
    for _, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, folder)
        assert kept.schema == docs.schema
        assert function(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_stages_leave_clashing_columns_alone(spark, folder):
    names = ["row", "keep", "Lang_pred", "score", "component_id", "own", "text_sha256", "kept", "number"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for _, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, folder)
        assert kept.schema == docs.schema
        assert kept.where(" OR ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).count() == 0


def test_null_and_repeated_ids_are_judged_by_text(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(3000))
    near = long.replace("word7 ", "other ")
    rows = [(None, "alone without id"), (None, "twice without id"), (None, "Twice without id"), (None, "named elsewhere"), (5, "named elsewhere"),
            (6, "first of six"), (6, "second of six"), (7, "second of six"), (6, long), (None, near), (8, long + " end"),
            (9, "repeated row"), (9, "repeated row")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda found: sorted((str(r["doc_id"]), r["text"].lower()) for r in found.collect())
    single = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    expected = [("None", "alone without id"), ("None", "twice without id"), ("5", "named elsewhere"), ("6", "first of six"), ("7", "second of six"),
                ("6", long), ("None", near), ("8", long + " end"), ("9", "repeated row")]
    assert key(single) == sorted(expected)
    left = [x for x in expected if x[1] not in (near, long + " end")]
    assert key(corpus_pipeline.near_dedup(spark, single, str(tmp_path))) == sorted(left)
    pieces = contract.queries()["pipeline"](spark, str(tmp_path)).where("start = 0").collect()
    assert sorted(str(p["doc_id"]) for p in pieces) == sorted(k for k, _ in left)
