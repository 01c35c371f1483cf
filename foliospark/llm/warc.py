"""WARC archives: writing, normalising monolithic gzip, reading by offset index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import checkpointed, scratch, staged

CHUNK = 1 << 20
# Uncompressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 1 << 28
GZIP = 31  # window bits of zlib for the gzip format
INDEX = "page_id long, record_type string, refers_to long, archive string, offset long, length long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or page_uri(page_id)[1:-1])
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_uri(page_id)}",
        f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {page_uri(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


class Inflated:
    """Reads records from a gzip stream of any number of members, inflating each byte once."""

    def __init__(self, source):
        self.source, self.inflater = source, zlib.decompressobj(GZIP)
        self.buffer, self.raw, self.ended = bytearray(), b"", False

    def _more(self) -> bool:
        """Add some bytes; False at the end of the stream."""
        if self.inflater.eof:
            self.raw, self.inflater = self.inflater.unused_data, zlib.decompressobj(GZIP)
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        if not self.raw:
            return False
        self.buffer += self.inflater.decompress(self.raw, CHUNK)
        self.raw = self.inflater.unconsumed_tail
        return True

    def records(self) -> Iterator[bytes]:
        while True:
            seen = 0
            while (at := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.buffer)
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            lengths = [x for x in bytes(self.buffer[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
            end = at + 4 + int(lengths[0].split(b":")[1]) + 4
            while len(self.buffer) < end:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            yield bytes(self.buffer[:end])
            del self.buffer[:end]


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, by its URI."""
    return pafs.FileSystem.from_uri(folder)


def typed_pages(pages: DataFrame, min_bytes: int, page_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): of equal payloads the smallest page is the response.

    First pages combine before their shuffle; only repeated payloads are joined back, from
    the shared folder, so adaptive execution can split a very common one.
    """
    rows = pages.select(
        F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keys = (F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("hash"), F.octet_length("payload").alias("bytes"))
    first = rows.select("page_id", *keys).where(F.col("bytes") >= min_bytes).groupBy("sha", "hash", "bytes").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = staged(first.select(F.col("sha").alias("s"), F.col("hash").alias("h"), F.col("bytes").alias("b"), "first"), "first-pages")
    same = (F.col("sha") == F.col("s")) & (F.col("hash") == F.col("h")) & (F.col("bytes") == F.col("b"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("*", *keys).join(first, same, "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, page_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic ``.warc.gz`` files, one gzip stream over all their records; returns their names (archive).

    Names are new for each task attempt and the list comes from the attempts that
    succeeded, so a lost executor leaves no archive that counts twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        names, out, packer, size = [], None, None, 0
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, packer, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), zlib.compressobj(1, wbits=GZIP), 0
                raw = record(page_id, url, payload, refers_to, revisit)
                out.write(packer.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])

    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    return checkpointed(typed_pages(pages, min_bytes, page_col, url_col, html_col).mapInArrow(run, "archive string"))


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar offset index; returns the index rows.

    An archive is inflated once, as a stream; a task holds one record at a time.
    The sidecar ``<archive>.idx`` has a line per record: offset, length, type and ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                target = f"{uuid.uuid4().hex}.warc.gz"
                rows, at = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source, \
                        fs.open_output_stream(f"{root}/{target}", compression=None) as out, \
                        fs.open_output_stream(f"{root}/{target}.idx", compression=None) as sidecar:
                    for raw in Inflated(source).records():
                        member = zlib.compress(raw, 6, wbits=GZIP)
                        out.write(member)
                        fields, _, _ = parse(raw)
                        refers = page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], refers, target, at, len(member)))
                        sidecar.write(("\t".join(map(str, rows[-1])) + "\n").encode())
                        at += len(member)
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    ["page_id", "record_type", "refers_to", "archive", "offset", "length"])

    count = max(1, archives.count())
    return checkpointed(archives.repartition(count, "archive").mapInArrow(run, INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload) of indexed records.

    Each record is read by its offset and length alone.  A revisit has no payload; size
    and digest are those its headers give for the full one, a response's are measured.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        name, source = None, None
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for kind, archive, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5)), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, fs.open_input_file(f"{root}/{archive}")
                source.seek(offset)
                fields, http, payload = parse(zlib.decompress(source.read(length), wbits=GZIP))
                if kind == "revisit":
                    sizes.append(int(http.rpartition(b"Content-Length: ")[2]))
                    digests.append(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    payloads.append(None)
                else:
                    sizes.append(len(payload))
                    digests.append(digest32(payload))
                    payloads.append(payload)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(payloads, pa.binary())],
                ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if source is not None:
            source.close()

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return index.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, page_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, normalise and read back all pages; one row per input row, see ``read_records``.

    Null html is an empty payload, a null URL becomes one made of the page id, other
    characters than printable ASCII are percent-encoded in it.  Payloads of at least ``min_bytes``
    that are equal share one response, that of the smallest page_id; rows that repeat this
    id are responses too.  A null page_id revisits a given one, and is a response where no id of
    its group is given.  An empty table writes no archive and gives no rows.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, min_bytes, page_col, url_col, html_col)
    return read_records(normalise_archives(archives, folder), folder)
