"""Registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.ann import nearest
from foliospark.llm.common import scratch
from foliospark.llm.encode import encode_documents
from foliospark.llm.exact import UPPER, exact_duplicates
from foliospark.llm.language import identify, is_held_out, train
from foliospark.llm.lines import remove_repeated_lines
from foliospark.llm.packing import pack_documents
from foliospark.llm.phrases import mine_phrases
from foliospark.llm.resampling import resample
from foliospark.llm.scoring import pseudo_likelihood
from foliospark.llm.sharding import write_shards
from foliospark.llm.simhash import near_duplicates
from foliospark.llm.topk import exact_top_k
from foliospark.llm.warc import archive_pages

PIECES = os.environ.get("FOLIO_PIECE_MODEL", public_tokenizers.path("piece_bpe_32k.model"))
BYTES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
         public_tokenizers.PATTERN)
SHARD_BYTES = 64 << 20

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        RUN[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), PIECES).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op2_sharding", f"""
    WITH keyed AS (
      SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
             ('0x' || substr(md5(doc_id::VARCHAR || '|' || coalesce(text, '')), 1, 15))::BIGINT AS k
      FROM documents),
    depths AS (SELECT unnest(range(0, 61)) AS d),
    sums AS (
      SELECT d, k >> (60 - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows, min(k) AS low, max(k) AS high
      FROM keyed, depths GROUP BY ALL),
    leaf AS (
      SELECT doc_id, bytes, k, min(d) AS d FROM keyed JOIN sums ON prefix = k >> (60 - d)
      WHERE shard_bytes <= {SHARD_BYTES} OR low = high GROUP BY ALL)
    SELECT doc_id, bytes AS text_bytes,
           CASE WHEN d = 0 THEN 'root' ELSE right(lpad(bin(prefix), 60, '0'), d::INT) END AS shard, shard_bytes, shard_rows
    FROM leaf JOIN sums USING (d) WHERE prefix = k >> (60 - d)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "shards")
    write_shards(docs, path, SHARD_BYTES)
    shards = spark.read.schema("doc_id long, text string, shard_bytes long, shard_rows long, shard string").parquet(path)
    return shards.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"), "shard",
                         "shard_bytes", "shard_rows")


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTES, added=True).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_exact_dedup", f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM n WINDOW same AS (PARTITION BY t)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op5_nearest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op6_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (
      SELECT page_id, h, strlen(h)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
             list_aggregate(list_transform(range(1, 41), lambda j:
               lpad(bin(strpos('0123456789abcdef', substr(sha1(h), j::INT, 1)) - 1), 4, '0')), 'string_agg', '') AS bits
      FROM p)
    SELECT page_id, payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
             + substr(bits, (5 * i + 1)::INT, 1)::INT * 16 + substr(bits, (5 * i + 2)::INT, 1)::INT * 8
             + substr(bits, (5 * i + 3)::INT, 1)::INT * 4 + substr(bits, (5 * i + 4)::INT, 1)::INT * 2
             + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_pseudo_likelihood")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op10_line_dedup", """
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
    f AS (SELECT * FROM (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l) WHERE t <> ''),
    w AS (
      SELECT doc_id, n AS start, lead(n, 2) OVER d AS stop, t || chr(10) || lead(t) OVER d || chr(10) || lead(t, 2) OVER d AS k
      FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
    later AS (
      SELECT doc_id, start, stop FROM (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS r FROM w WHERE stop IS NOT NULL) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS n FROM later)
    SELECT l.doc_id, count(*) AS n_lines, count(gone.n) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE gone.n IS NULL), '')) AS text_sha256
    FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.n = gone.n GROUP BY l.doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op11_topk", """
    WITH v AS (
      SELECT DISTINCT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op12_resampling", """
    WITH RECURSIVE steps AS (
      SELECT i, i AS c, 0 AS n FROM range(256) t(i)
      UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), n + 1 FROM steps WHERE n < 8),
    crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE n = 8),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
    dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
    words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    hashed AS (
      SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               range(0, octet_length(encode(w))), lambda j: ('0x' || substr(hex(encode(w)), (2 * j + 1)::INT, 2))::BIGINT)),
               lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 10000 AS k
      FROM words, crc),
    s AS (SELECT k, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY k),
    t AS (SELECT k, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY k),
    gain AS (
      SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
               / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g
      FROM s LEFT JOIN t USING (k)),
    sums AS (SELECT doc_id, count(*) AS n, sum(g) AS g FROM dw JOIN hashed USING (w) JOIN gain USING (k) GROUP BY doc_id),
    weighed AS (
      SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features,
             coalesce(g // n - (g % n < 0)::INT, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN sums USING (doc_id)),
    scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
    ranked AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
    SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
    FROM scores s LEFT JOIN ranked r ON s.doc_id = r.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_phrases", f"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
    g AS (
      SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 5)) AS k)),
    f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
    total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    long AS (SELECT lang, k, n, string_split(phrase, ' ') AS ws FROM f WHERE k > 2),
    sub AS (
      SELECT lang, n, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS phrase
      FROM long, (SELECT unnest([2, 3]) AS j) WHERE j < k),
    cover AS (SELECT lang, phrase, max(n) AS longer FROM sub GROUP BY ALL),
    kept AS (
      SELECT f.lang, f.phrase, f.k, f.n AS a FROM f LEFT JOIN cover c ON f.lang = c.lang AND f.phrase = c.phrase
      WHERE f.k > 1 AND coalesce(100 * longer::HUGEINT < 80 * f.n::HUGEINT, true)),
    cut AS (
      SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS first,
             array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS rest
      FROM kept, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
    scored AS (
      SELECT cut.lang, cut.phrase, a, c, x.n AS l, y.n AS r, (2000000 * a::HUGEINT // (x.n::HUGEINT + y.n))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))
