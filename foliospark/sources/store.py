"""Parquet store: tables by corpus and document bucket, changed by one commit over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.sources.snapshots import Part, Snapshot, Snapshots, bucket_of

BUCKET = "doc_bucket"
BY = ["corpus", BUCKET]


class Store:
    """Corpus tables in one folder.

    Reads of a corpus or of some documents list their own folders only, and a rewrite replaces the touched
    buckets of one corpus.  Every change is one commit (see ``Snapshots``): a crash leaves the old rows or the
    new ones, in all tables, and a writer that another one has overtaken gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = Snapshots(spark, root)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        ident: Column = F.col("document_id") if "document_id" in df.columns else F.lit("")
        return df.withColumn(BUCKET, bucket_of(ident, self.buckets))

    def _stage(self, table: str, df: DataFrame) -> tuple[str, list[Part]]:
        return self.log.stage(table, self._bucketed(df), BY)

    def exists(self, table: str, corpus: str | None = None) -> bool:
        parts = self.log.load().parts.get(table, ())
        return bool(parts) if corpus is None else any(p.has({"corpus": corpus}) for p in parts)

    def read(self, table: str, corpus: str | None = None, documents: list | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        keys: dict[str, str | set[str]] = {} if corpus is None else {"corpus": corpus}
        if documents is not None:
            wanted = [bucket_of(F.lit(str(d)), self.buckets) for d in documents]
            found = self.spark.range(1).select(F.array(*wanted).cast("array<string>").alias("b")).first()["b"] if wanted else []
            keys[BUCKET] = set(found)
        df = self.log.read(table, snapshot, **keys)
        if documents is not None:
            df = df.where(F.col("document_id").cast("string").isin([str(d) for d in documents]))
        return df.drop(BUCKET)

    def append(self, table: str, df: DataFrame) -> None:
        self.log.commit(self.log.load(), {table: self._stage(table, df)})

    def touched(self, df: DataFrame) -> set[int]:
        """Buckets of some rows, ``buckets`` at most."""
        return {r[0] for r in self._bucketed(df).select(BUCKET).distinct().collect()}

    def change(self, corpus: str, tables: dict[str, DataFrame], touched: set[int] | None = None, base: Snapshot | None = None) -> None:
        """Replace buckets of one corpus in several tables by rows that may be read from them, in one commit.

        ``touched`` names the buckets that the rows replace; by default all.  ``base`` is the snapshot the
        rows were made from; a change since then is refused.
        """
        base = base or self.log.load()
        keys = {"corpus": corpus} | ({} if touched is None else {BUCKET: {str(b) for b in touched}})
        add = {t: self._stage(t, df.drop("corpus").withColumn("corpus", F.lit(corpus))) for t, df in tables.items()}
        drop = {p for t in tables for p in base.parts.get(t, ()) if p.has(keys)}
        self.log.commit(base, add, drop)

    def rewrite(self, table: str, corpus: str, df: DataFrame, touched: set[int] | None = None) -> None:
        self.change(corpus, {table: df}, touched)

    def upsert_scans(self, corpus: str, scans: DataFrame) -> None:
        """page_scans by (document_id, page_number), newest wins; only their buckets are read and rewritten."""
        from foliospark.plans.corpus_edit import upsert

        touched = self.touched(scans)
        if not touched:
            return
        base = self.log.load()
        old = self.log.read("page_scans", base, corpus=corpus, doc_bucket={str(b) for b in touched}).drop(BUCKET, "corpus")
        new = scans.drop("corpus").select(*old.columns)
        self.change(corpus, {"page_scans": upsert(old, new, ["document_id", "page_number"])}, touched, base)

    def compact(self, table: str) -> None:
        """Join the small folders that many appends leave behind."""
        self.log.compact(table, by=BY)

    def export(self, corpus: str, target: str, tables: list[str]) -> None:
        """Self-contained copy of one corpus; an existing target is refused."""
        base = self.log.load()
        for table in tables:
            self.read(table, corpus, snapshot=base).write.mode("errorifexists").partitionBy("corpus").parquet(f"{target}/{table}")

    def duplicate(self, corpus: str, copy: str, tables: list[str]) -> None:
        """Copy a corpus under a new name, all tables at once; a name in use is refused."""
        base = self.log.load()
        for table in tables:
            if any(p.has({"corpus": copy}) for p in base.parts.get(table, ())):
                raise FileExistsError(f"corpus {copy!r} exists")
        self.log.commit(base, {t: self._stage(t, self.read(t, corpus, snapshot=base).withColumn("corpus", F.lit(copy))) for t in tables})
