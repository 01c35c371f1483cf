"""WARC archives and repeated lines against brute force."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from foliospark.llm.common import scratch
from foliospark.llm.lines import remove_repeated_lines
from foliospark.llm.warc import Inflated, archive_pages, normalise_archives, opened, parse, record, write_archives

HTML = [(5, "u5", "<p>é</p>"), (2, "u2", "<p>é</p>"), (9, None, None), (7, "u\r\n7 ", ""), (3, "ü", "x" * 3_000_000), (4, "u", "a\r\n\r\nb"),
        (2, "u2", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "only null"), (11, "z", "same"), (10, "z", "same")]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "a", 1, 2, "t") for r in HTML]
    return spark.createDataFrame(rows, "page_id long, url string, html string, archive string, offset int, bytes int, first string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(pages, least):
    expected = []
    for page, _, html in HTML:
        payload = (html or "").encode()
        same = [p for p, _, h in HTML if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        revisit = len(payload) >= least and first is not None and page != first
        expected.append((str(page), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                         "revisit" if revisit else "response", str(first if revisit else None)))
    found = archive_pages(pages, min_bytes=least).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in found) == sorted(expected)
    texts = {h or "" for _, _, h in HTML}
    assert {r["payload"].decode() for r in found if r["record_type"] == "response"} == texts


def test_archives_are_rewritten_as_members_with_an_index(spark, pages):
    folder = scratch(spark, "warc-test")
    archives = write_archives(pages, folder, archive_bytes=200)
    fs, root = opened(folder)
    index = normalise_archives(archives, folder).orderBy("archive", "offset").collect()
    assert len(index) == len(HTML)
    for name in {r["archive"] for r in index}:
        raw = fs.open_input_file(f"{root}/{name}").read()
        own = [r for r in index if r["archive"] == name]
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:n]) for n in range(len(own))]
        assert sum(r["length"] for r in own) == len(raw)
        for r in own:
            fields, _, _ = parse(gzip.decompress(raw[r["offset"]:r["offset"] + r["length"]]))
            assert fields["WARC-Type"] == r["record_type"]
        lines = fs.open_input_file(f"{root}/{name}.idx").read().decode().splitlines()
        assert [line.split("\t")[4:] for line in lines] == [[str(r["offset"]), str(r["length"])] for r in own]
    whole = [fs.open_input_file(f"{root}/{r['archive']}").read() for r in archives.collect()]
    assert len(whole) > 3
    for raw in whole:  # one stream each
        assert gzip.decompress(raw) == b"".join(Inflated(io.BytesIO(raw)).records())


def test_inflate_any_members_and_broken_ends():
    records = [record(i, f"u{i}", bytes([65 + i]) * (i * 1_500_000), None, False) for i in range(3)]
    for raw in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert list(Inflated(io.BytesIO(raw)).records()) == records
    with pytest.raises(ValueError):
        list(Inflated(io.BytesIO(gzip.compress(records[1][:-9]))).records())
    assert list(Inflated(io.BytesIO(gzip.compress(b""))).records()) == []


def test_no_pages(pages):
    assert archive_pages(pages.limit(0)).count() == 0


def plain(texts, width=3):
    order = sorted((k, t or "") for k, t in texts if k is not None)
    seen, gone = set(), {}
    for key, text in order:
        lines = [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for i in range(len(lines) - width + 1):
            window = tuple(x for _, x in lines[i:i + width])
            if window in seen:
                gone.setdefault(key, set()).update(range(lines[i][0], lines[i + width - 1][0] + 1))
            seen.add(window)
    return gone


def test_lines(spark):
    texts = [
        (1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny"), (3, " b \n\nc\nd\nz"), (4, None), (5, ""), (6, "a\nb"), (7, "q\nq\nq\nq\nq\nq"),
        (8, "e\nd\nc\nb\na"), (9, "\n\n\n\n"), (10, "\n".join(f"line {i % 700}" for i in range(3000))), (11, "a\nb\nc\nb\nc\nd"),
        (12, "r" * 200_000 + "\nb\nc\nd")]
    rows = [(k, t, 1, 2, "s", "c") for k, t in [*texts, (None, "a\nb\nc"), (None, "a\nb\nc")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, stop int, h1 string, cuts string").repartition(4)
    gone = plain(texts)
    found = remove_repeated_lines(docs).collect()
    assert len(found) == len(rows)
    assert [r["text"] for r in found if r["doc_id"] is None] == ["a\nb\nc"] * 2
    for r in found:
        if r["doc_id"] is not None:
            lines = (dict(texts)[r["doc_id"]] or "").split("\n")
            own = gone.get(r["doc_id"], set())
            assert (r["n_lines"], r["n_removed"]) == (len(lines), len(own))
            assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in own)
    assert gone[2] == {1, 2, 3} and gone[7] == {1, 2, 3, 4, 5}
    assert remove_repeated_lines(docs.limit(0)).count() == 0


def test_lines_of_blanks_do_not_count(spark):
    rows = [(1, "\t\n\r\n \x0b\x0c\t\na"), (2, "\t\n\r\n \x0b\x0c\t\nb"), (3, "one\r\ntwo\r\n\r\n\r\n\r\nthree"), (4, "one\n\ttwo\n\nthree\t\nx")]
    found = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["text"]) for r in found] == [(0, rows[0][1]), (0, rows[1][1]), (0, rows[2][1]), (4, "x")]


def test_repeated_rows_of_one_document(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in remove_repeated_lines(docs).collect()) == [(1, 0), (1, 0), (2, 3)]
    assert remove_repeated_lines(docs, width=4).agg(F.sum("n_removed")).first()[0] == 0


def test_two_texts_of_one_id_are_cut_apart(spark):
    long, short = "\n".join("uvwxyzabc"), "a\nb\nc"
    rows = [(1, long), (2, short), (2, "p\nq\nr\n" + long), (2, "only"), (3, "k\nl\nm"), (3, "k\nl\nm\nn")]
    found = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    cut = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in found if r["doc_id"] < 3)
    assert cut == [(1, 9, 0, long), (2, 1, 0, "only"), (2, 3, 3, ""), (2, 12, 9, "p\nq\nr")]
    # One of two texts of an id with a window at the same place loses it.
    assert sorted(r["n_removed"] for r in found if r["doc_id"] == 3) == [0, 3]
