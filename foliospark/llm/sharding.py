"""Byte-limited shards by extendible hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import text_or_empty
from foliospark.llm.extendible import Directory, build_directory

KEY = "__shard_key"
WEIGHT = "__shard_weight"


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text"
                  ) -> tuple[DataFrame, Directory]:
    """Every row with ``shard``, ``shard_bytes`` and ``shard_rows``; and the directory.

    The key is a hash of id and text, so rows of one id or one text spread as
    well.  A row weighs the UTF-8 bytes of its text; null weighs nothing.  Rows
    equal in both are counted together as one key: only such a group, or one
    single row, can exceed ``limit``, and then fills a shard of its own, which
    ``Directory.overfull`` names.  Assigning needs no shuffle of the rows.  Columns
    of the input that have the names of the three new ones are replaced.
    """
    text = text_or_empty(text_col)
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text))
    keyed = docs.withColumns({
        KEY: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"),
        WEIGHT: F.octet_length(text).cast("long"),
    })
    directory = build_directory(keyed.select(KEY, WEIGHT), limit, KEY, WEIGHT)
    key = F.col(KEY)
    return keyed.withColumns({
        "shard": directory.bucket(key), "shard_bytes": directory.weight(key), "shard_rows": directory.rows(key),
    }).drop(KEY, WEIGHT), directory


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> Directory:
    """Write each shard as one folder ``shard=<bits>`` of Parquet files.

    Rows are dealt out by shard, and adaptive execution evens out the tasks: a large shard may be
    written by several, small ones share one.  The writer's commit protocol drops the files of a
    lost executor.
    """
    assigned, directory = assign_shards(docs, limit, id_col, text_col)
    assigned.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)
    return directory
