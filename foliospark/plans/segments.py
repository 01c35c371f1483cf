"""A search index kept up to date by segments: an edit writes its own rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.plans.search import INDEXED, Index, build_index
from foliospark.session import staged
from foliospark.sources.snapshots import Part, Snapshot, Snapshots

ROW = ["corpus", "row_id"]
BY = ["segment", "corpus"]


class SegmentedIndex:
    """Postings and row lengths in segments, tombstones, and statistics that add up.

    An edit is one commit: a segment with the postings of the rows put in, a tombstone for each older version that
    it replaces or removes, and the differences it makes to the rows and lengths of each corpus.  A tombstone hides
    the versions of its row in earlier segments.  A search reads the postings of its terms from all segments, less what
    tombstones hide, and adds up the statistics, a row per edit and corpus, so its scores are those of an index
    built anew.  ``merge`` joins small segments and drops what is hidden.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[str] = INDEXED, keep: tuple[str, ...] = ("chunk_id",),
                 arabic_fold: bool = True):
        self.log = Snapshots(spark, root)
        self.columns, self.keep, self.arabic_fold = columns, keep, arabic_fold

    def edit(self, rows: DataFrame, gone: DataFrame | None = None) -> Snapshot:
        """Put in ``rows``, each in place of an older one of its (corpus, row_id), and remove those of ``gone(corpus, row_id)``.

        A row that is in both is put in.  Names that are not there are removed without effect.
        """
        base = self.log.load()
        number = F.lit(base.version + 1).cast("long").alias("segment")
        made = build_index(rows, self.columns, self.keep, self.arabic_fold)
        add = {
            "postings": self.log.stage("postings", _sorted(staged(made.postings, "postings").select("*", number)), BY),
            "lengths": self.log.stage("lengths", made.lengths.select("*", number), BY),
        }
        names = rows.select(*ROW) if gone is None else rows.select(*ROW).union(gone.select(*ROW))
        # Read back, so that texts are not cut again for the statistics.
        own = self._back(made.lengths.select("*", number), add["lengths"][1])
        put = own.select("corpus", F.lit(1).cast("long").alias("n"), F.col("dl").cast("long").alias("dl"))
        if base.parts.get("lengths"):
            hidden = self._live("lengths", base).join(names.distinct(), ROW, "left_semi").select(*ROW, "dl", number)
            add["gone"] = self.log.stage("gone", hidden)
            # Read back, so that tombstones and statistics are of the same rows.
            dead = self._back(hidden, add["gone"][1])
            put = put.union(dead.select("corpus", F.lit(-1).cast("long"), -F.col("dl").cast("long")))
        add["stats"] = self.log.stage("stats", put.groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).coalesce(1))
        return self.log.commit(base, add)

    def _back(self, made: DataFrame, parts: list[Part]) -> DataFrame:
        """Rows just staged, read from their files."""
        if not parts:
            return self.log.spark.createDataFrame([], made.schema)
        base = parts[0].path.split("/", 2)
        rows = self.log.spark.read.schema(made.schema).option("basePath", f"{self.log.root}/{'/'.join(base[:2])}")
        return rows.parquet(*[f"{self.log.root}/{p.path}" for p in parts]).select(*made.columns)

    def _live(self, table: str, base: Snapshot, parts: list[Part] | None = None) -> DataFrame:
        rows = self.log.read(table, base, parts)
        if not base.parts.get("gone"):
            return rows
        dead = self.log.read("gone", base).groupBy(*[F.col(c).alias(f"_{c}") for c in ROW]).agg(F.max("segment").alias("_before"))
        same = (F.col("corpus") == F.col("_corpus")) & (F.col("row_id") == F.col("_row_id"))
        return rows.join(dead, same & (F.col("segment") < F.col("_before")), "left_anti")

    def index(self, snapshot: Snapshot | None = None) -> Index:
        """The index at a snapshot, by default the newest, for the searches of ``plans.search``."""
        base = snapshot or self.log.load()
        sums = self.log.read("stats", base).groupBy("corpus").agg(F.sum("n").alias("n_rows"), F.sum("dl").alias("_dl"))
        stats = sums.where("n_rows > 0").select("corpus", "n_rows", (F.col("_dl") / F.col("n_rows")).alias("avg_dl"))
        return Index(self._live("postings", base).drop("segment"), self._live("lengths", base).drop("segment"), stats)

    def segments(self, base: Snapshot | None = None) -> dict[int, int]:
        """Bytes of the postings of each segment."""
        out: dict[int, int] = {}
        for part in (base or self.log.load()).parts.get("postings", ()):
            number = int(dict(part.keys)["segment"])
            out[number] = out.get(number, 0) + part.size
        return out

    def merge(self, small: int = 1 << 30) -> Snapshot:
        """Join all segments that are newer than the last one of ``small`` bytes or more; with none such, the whole index.

        Rows that tombstones hide are left out.  The joined segment takes the newest number, so tombstones, which are kept as
        long as an older segment stands, hide nothing in it.
        """
        base = self.log.load()
        sizes = self.segments(base)
        large = max((n for n, size in sizes.items() if size >= small), default=0)
        chosen = {n for n in sizes if n > large}
        if len(chosen) < 2:
            return base
        number = F.lit(max(chosen)).cast("long")
        add, drop = {}, set(base.parts["stats"])
        for table in ("postings", "lengths"):
            own = [p for p in base.parts[table] if int(dict(p.keys)["segment"]) in chosen]
            rows = self._live(table, base, own).withColumn("segment", number)
            add[table] = self.log.stage(table, _sorted(rows) if table == "postings" else rows, BY)
            drop |= set(own)
        sums = self.log.read("stats", base).groupBy("corpus").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
        add["stats"] = self.log.stage("stats", sums.where("n > 0").coalesce(1))
        if not large:
            drop |= set(base.parts.get("gone", ()))
        return self.log.commit(base, add, drop)


def _sorted(postings: DataFrame) -> DataFrame:
    """By term inside each corpus, so that a query skips all row groups but those of its terms."""
    return postings.repartitionByRange("corpus", "term", "row_id").sortWithinPartitions("segment", "corpus", "term")
