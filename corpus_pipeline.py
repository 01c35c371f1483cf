"""Documents to packed sequences: language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import fresh, numbered, staged
from foliospark.llm.exact import exact_duplicates
from foliospark.llm.language import UNKNOWN, tag_language, train
from foliospark.llm.packing import pack_documents
from foliospark.llm.queries import BYTES, query
from foliospark.llm.similar import near_copies

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = []
ORACLE_SQL = None


def stage(name: str):
    def add(function):
        STAGES.append((name, function))
        return function

    return add


@stage("language")
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; any other stays, however unsure."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    tagged = tag_language(docs, train(docs), lang_pred=lang, score=score)
    return tagged.where(F.col(lang) != UNKNOWN).select(*docs.columns)


@stage("exact_dedup")
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, one with the largest id; a null id only where all of the group are null.

    Rows are told apart by numbers of their own, so rows that share an id are judged each by its own text.
    """
    rows, row = numbered(docs)
    judged = exact_duplicates(rows.select(F.struct("doc_id", row).alias("name"), "text"), id_col="name")
    kept = judged.where("kept").select(F.col("name")[row].alias("keep"))
    keep = fresh(rows, "keep")
    kept = kept.withColumnRenamed("keep", keep)
    return rows.join(kept, F.col(row) == F.col(keep), "left_semi").select(*docs.columns)


@stage("near_dedup")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, one with the smallest id; a null id only where all of the group are null.

    Near copies share eight tenths of their five-word shingles.  Rows are told apart by numbers of their own, not by their ids.
    """
    rows, row = numbered(docs)
    groups = near_copies(rows.select(F.col(row).alias("own"), "text"), id_col="own")
    names = rows.select(F.col(row).alias("number"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "number"))
    kept = groups.join(names, F.col("own") == F.col("number")).groupBy("component_id").agg(first.alias("first"))
    keep = fresh(rows, "keep")
    kept = kept.select(F.col("first")["number"].alias(keep))
    return rows.join(kept, F.col(row) == F.col(keep), "left_semi").select(*docs.columns)


@stage("packing")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of the documents that are left."""
    return pack_documents(docs, BYTES, added=True).withColumn("ids_crc32", F.crc32("ids"))


@query("pipeline")
def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), f"stage-{name}")
    return docs
