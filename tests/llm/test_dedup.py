"""Exact and near duplicates, shards and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm.bktree import Forest, merge_labels, spanning_forest
from foliospark.llm.components import connected_components
from foliospark.llm.exact import build_index, exact_duplicates, keyed, read_index
from foliospark.llm.common import scratch
from foliospark.llm.extendible import KEY_BITS, build_directory
from foliospark.llm.sharding import assign_shards, write_shards
from foliospark.llm.similar import agreement, layout, near_copies, shingles
from foliospark.llm.simhash import fingerprint, links, near_duplicates

EXTRA = "doc_id long, text string, key string, norm int, shard string, fp string, rep string, component string"


def rows_of(texts):
    return [(k, t, "k", 1, "s", "f", "r", "c") for k, t in texts]


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        label[max(ra, rb)] = min(ra, rb)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "a", "A b\tc", "one two three four", "One two three four five one two three four five", "é É x y z w v",
    "w " * 100_000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 30, 300]))]
        for _ in range(rng.choice([1, 1, 4])):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 3])):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(changed))
    texts += [None, "", "  ", "same", "SAME"]
    rows = rows_of(enumerate(texts))
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = {(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, classes(len(texts), pairs)))}
    docs = spark.createDataFrame([*rows, rows[0], (None, "no id at all", *rows[0][2:])], EXTRA)
    for tree in (1 << 16, 5):
        found = near_duplicates(docs, tree=tree).withColumn("h", F.lower(F.lpad(F.hex("fp"), 16, "0"))).collect()
        assert len(found) == len(texts) + 2
        assert {(r["doc_id"], r["h"], r["component_id"]) for r in found if r["doc_id"] is not None} == expected
        assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]


def test_rows_without_an_id_link_others(spark, monkeypatch):
    prints = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 0xFFFF << 48, "e": (0xFFFF << 48) + 7}
    monkeypatch.setattr("foliospark.llm.simhash.fingerprints", lambda docs, *_: docs.select(F.col("doc_id").alias("id"), F.col("fp")))
    for key, want in ((2, [1, 1, 1]), (None, [1, 1, 1])):
        rows = [(1, prints["a"]), (key, prints["b"]), (3, prints["c"]), (None, prints["d"] - (1 << 64)), (None, prints["e"] - (1 << 64))]
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
        got = {r["fp"]: r["component_id"] for r in found}
        assert [got[prints[n]] for n in "abc"] == want and [got[prints[n] - (1 << 64)] for n in "de"] == [None, None]


def plain_sets(text, width=5):
    words = plain_words(text)
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    return [w for w in lowered.split(" ") if w]


@pytest.mark.parametrize("text", [None, " \n", "a", "A b\tc d", "one two three four five six One two three four five", "w " * 3000])
def test_shingles(text):
    assert len(shingles(text)) == len(plain_sets(text)) and shingles(text).shape[1] == 2


def test_near_copies_by_similarity(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(120):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 40, 200, 900]))]
        for n in range(rng.choice([1, 2, 5])):
            changed = list(words)
            for _ in range(int(len(words) * rng.choice([0, 0.004, 0.01, 0.02, 0.05]))):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(changed))
    base = [f"hot{i}" for i in range(300)]
    texts += [" ".join([*base[:n % 280], f"own{n}", *base[n % 280 + 1:]]) for n in range(300)]  # one group over several trees
    texts += [None, "", "  ", "same text", "SAME  text", "same text of more"]
    sets = [plain_sets(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = classes(len(texts), pairs)
    docs = spark.createDataFrame([*rows_of(enumerate(texts)), (None, texts[0], "k", 1, "s", "f", "r", "c")], EXTRA)
    for tree in (4096, 40):
        got = {r["doc_id"]: r["component_id"] for r in near_copies(docs, tree=tree).collect()}
        assert set(got) == set(range(len(texts)))
        # Links are confirmed: no class is too large.  Most pairs at the similarity are found.
        assert all(want[i] <= got[i] for i in got) and all(want[i] == want[got[i]] for i in got)
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
        assert len({got[i] for i in range(len(texts) - 306, len(texts) - 6)}) == 1
    assert near_copies(docs.limit(0)).count() == 0


def test_layout_grows_with_the_points():
    for points in (0, 1, 1000, 10 ** 6, 10 ** 9):
        places, radius = layout(points, 0.8)
        same = agreement(0.8)
        assert 1 - (1 - same ** len(places[0])) ** len(places) >= 0.97 and 40 <= radius <= 60
        assert points / 2 ** len(places[0]) < 1100


def test_spanning_forest_keeps_components_at_every_length():
    rng = np.random.default_rng(3)
    a, b, length = rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300)
    kept = spanning_forest(60, a, b, length)
    for limit in range(9):
        within = [(int(x), int(y)) for x, y, n in zip(a, b, length) if n <= limit and x != y]
        own = [(int(a[i]), int(b[i])) for i in kept if length[i] <= limit]
        assert classes(60, own) == classes(60, within)
    assert len(kept) == 60 - len(set(classes(60, [(int(x), int(y)) for x, y in zip(a, b) if x != y])))
    assert not len(spanning_forest(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)))


def test_links_through_cut_trees_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    points = np.unique([b ^ np.uint64(sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 6))))) for b in base for _ in range(25)])
    pairs = [(i, j) for i in range(len(points)) for j in range(i) if int(points[i] ^ points[j]).bit_count() <= 4]
    expected = classes(len(points), pairs)
    df = spark.createDataFrame([(int(p.view(np.int64)), i) for i, p in enumerate(points)], "fp long, rep long")
    for tree in (1000, 7):
        got = {r["node"]: r["component"] for r in connected_components(links(df, 4, tree)).collect()}
        assert [got.get(i, i) for i in range(len(points))] == expected


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 20, 400, dtype=np.uint64)
    groups = rng.integers(0, 3, 400)
    forest = Forest(points, groups, 4)
    for radius in (1, 4):
        found = {(int(q), int(n)) for a, b in forest.within(points, groups, radius) for q, n in zip(a, b)}
        assert found == {(i, j) for i in range(400) for j in range(400) if groups[i] == groups[j]
                         and int(points[i] ^ points[j]).bit_count() <= radius}


def test_merge_labels():
    a, b = np.array([3, 1, 5, 8]), np.array([2, 2, 8, 9])
    assert merge_labels(np.arange(10), a, b).tolist() == [0, 1, 1, 1, 4, 5, 6, 7, 5, 5]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(5, 3), (3, 5), (9, 3), (7, 8), (None, 2)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    expected = classes(301, real)
    assert got == {n: expected[n] for pair in real for n in pair}


def test_exact_duplicates(spark):
    texts = [(1, "Abc"), (2, "aBC"), (5, "abc"), (3, None), (4, ""), (6, "É"), (7, "é"), (8, "abc "), (8, "abc "),
             (None, "lone"), (None, "ABC"), (9, "x" * 300_000), (10, "X" * 300_000)]
    found = exact_duplicates(spark.createDataFrame(rows_of(texts), EXTRA), bucket_texts=2).collect()
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in found)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    expected = []
    for key, text in texts:
        same = [k for k, t in texts if low(t) == low(text)]
        keep = max((k for k in same if k is not None), default=None)
        expected.append((str(key), str(keep), len(same), key == keep, hashlib.sha256(low(text).encode()).hexdigest()))
    assert got == sorted(expected)
    assert exact_duplicates(spark.createDataFrame([], EXTRA)).count() == 0


def test_index_chains_texts_of_one_key(spark):
    rows = keyed(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "doc_id long, text string"), "doc_id", "text")
    clash = rows.withColumn("key", F.when(F.col("norm") == "c", F.col("key")).otherwise(F.lit(77)))
    path = scratch(spark, "index-test")
    directory = build_index(clash, path, bucket_texts=1)
    entries = read_index(spark, path, "bigint").collect()
    assert sorted((e["keep_id"], e["group_size"]) for e in entries) == [(1, 1), (3, 2), (4, 1)]
    assert sorted(e["chain"] for e in entries) == [0, 0, 1]
    assert {e["bucket"] for e in entries} <= set(directory.leaves)


def test_directory_splits_only_overfull_buckets(spark):
    keys = [(i << 50, 1) for i in range(16)] + [(5, 40)] + [((1 << KEY_BITS) - 1, 3)] * 2
    df = spark.createDataFrame(keys, "key long, weight long")
    directory = build_directory(df, 4)
    assert sum(2.0 ** -len(b) for b in directory.leaves) == 1
    assert all(x.weight <= 4 or b in directory.overfull for b, x in directory.leaves.items())
    for bits, leaf in directory.leaves.items():
        inside = [x for x in keys if format(x[0], f"0{KEY_BITS}b").startswith(bits)]
        assert (leaf.weight, leaf.rows) == (sum(x[1] for x in inside), len(inside))
        parent = [x[1] for x in keys if bits and format(x[0], f"0{KEY_BITS}b").startswith(bits[:-1])]
        assert not bits or sum(parent) > 4
    found = df.select("key", directory.bucket(F.col("key")).alias("b")).collect()
    assert all(format(r["key"], f"0{KEY_BITS}b").startswith(r["b"]) for r in found)


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    texts = [(i, "é" * rng.randint(0, 200)) for i in range(300)] + [(1, None), (None, None), (None, ""), (400, "z" * 9000)]
    docs = spark.createDataFrame(rows_of(texts), EXTRA)
    assigned, directory = assign_shards(docs, 3000)
    rows = assigned.collect()
    assert len(rows) == len(texts) and set(assigned.columns) == {*docs.columns, "shard_bytes", "shard_rows"}
    weight: dict = {}
    for r in rows:
        weight[r["shard"]] = weight.get(r["shard"], 0) + len((r["text"] or "").encode())
    assert all(w <= 3000 for s, w in weight.items() if s not in directory.overfull) and max(weight.values()) == 9000
    assert all(r["shard_bytes"] == weight[r["shard"]] for r in rows)
    write_shards(docs, str(tmp_path / "s"), 3000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(texts)
    none, root = assign_shards(spark.createDataFrame([], EXTRA), 10)
    assert none.count() == 0 and list(root.leaves) == [""]
