"""Exact duplicates through an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import scratch, text_or_empty
from foliospark.llm.extendible import Directory, build_directory

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Distinct texts of a bucket, and buckets, at most; with more texts buckets grow.
BUCKET_TEXTS, BUCKETS = 128, 1 << 14


def normalised(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm, key, digest) per row; null counts as empty."""
    return docs.select(F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("norm")).select(
        "id", "norm", F.shiftrightunsigned(F.xxhash64("norm"), 4).alias("key"), F.sha2("norm", 256).alias("digest"))


def build_index(rows: DataFrame, path: str, bucket_texts: int = BUCKET_TEXTS, most_buckets: int = BUCKETS) -> Directory:
    """Write one entry per distinct text to ``path``, bucket by bucket.

    The directory is sized by distinct keys, so copies do not split buckets: a bucket holds at most ``bucket_texts``
    of them, or a ``most_buckets``-th of all where that is more, which bounds the directory.  Copies combine before
    their shuffle, where whole texts are compared.  Each bucket then goes to one owner task, which
    writes the entries of its key range in order; texts that share a key chain up as 0, 1, ...
    """
    keys = rows.groupBy("key").agg(F.lit(1).cast("long").alias("weight"))
    directory = build_directory(keys, lambda total: max(bucket_texts, -(-total // most_buckets)))
    owned = rows.withColumn("bucket", directory.bucket(F.col("key")))
    entries = owned.groupBy("bucket", "key", "norm", "digest").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("norm")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest")) - 1
    entries.repartition("bucket").withColumn("chain", chain).sortWithinPartitions("bucket", "key", "chain").write.option(
        "compression", "zstd").parquet(path)
    return directory


def read_index(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(
        f"bucket string, key long, digest string, keep_id {id_type}, group_size long, chain int").parquet(path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The largest id
    stays; a null id stays only where all ids of its text are null, and then
    ``keep_id`` is null.  Rows that repeat the kept id are all kept: an id names
    one document.  An empty table gives no rows; other columns are not read.

    A row is looked up in the bucket that owns its key, along the chain of that key.  Only groups of two or more are
    joined back, from the index files, so both sides are plain shuffles and adaptive execution can split a hot text.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    path = scratch(spark, "exact-index")
    directory = build_index(rows, path, bucket_texts)
    copies = read_index(spark, path, rows.schema["id"].dataType.simpleString()).where("group_size > 1").select(
        F.col("bucket").alias("b"), F.col("key").alias("k"), F.col("digest").alias("d"), "chain", "keep_id", "group_size")
    asked = rows.select("id", "key", "digest", directory.bucket(F.col("key")).alias("bucket"))
    in_chain = (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d"))
    joined = asked.join(copies, in_chain, "left")
    keep = F.when(F.col("chain").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))
