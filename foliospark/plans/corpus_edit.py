"""Scoped purge, reprocess, re-ingestion, corrections and cascades.

All jobs map tables to tables.  A stored corpus is rewritten by writing the
result to a new folder and swapping it in (see ``sources.store``); nothing is
written over a path that is being read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from foliospark import session
from foliospark.functions.lint import lint_chunk
from foliospark.operators.sets import unprotected
from foliospark.plans.curriculum import key_id
from foliospark.plans.ledger import enqueue

SCOPES = ("page", "page_range", "chapter", "document", "database", "artifacts_only", "curriculum_only")
CURRICULUM = ("links", "assessments", "programs", "terms")
PAGED = ("chunks", "artifacts", "page_scans", "jobs")
HUMAN = ("chunks", "artifacts")


@dataclass(frozen=True)
class Scope:
    kind: str
    document_id: object = None
    page_start: int | None = None
    page_end: int | None = None
    toc_id: object = None
    preserve_human: bool = True
    whole_corpus: bool = False

    def __post_init__(self) -> None:
        if self.kind not in SCOPES:
            raise ValueError(f"unknown scope {self.kind!r}")
        needs = ("page", "page_range", "chapter", "document", "artifacts_only")
        if self.kind in needs and self.document_id is None and not (
            self.kind == "artifacts_only" and self.whole_corpus
        ):
            raise ValueError(f"scope {self.kind!r} needs a document_id")


def resolve(scope: Scope, toc: DataFrame) -> Scope:
    """A chapter scope becomes the entry's page range (one row is looked up)."""
    if scope.kind != "chapter":
        return scope
    row = toc.where(F.col("toc_id") == scope.toc_id).select("page_start", "page_end").first()
    if row is None:
        raise LookupError("no such contents entry")
    return replace(scope, page_start=row[0], page_end=row[1])


def in_scope(scope: Scope) -> Column:
    """Row predicate on (document_id, page_number)."""
    if scope.kind == "database":
        return F.lit(True)
    if scope.kind == "curriculum_only":
        return F.lit(False)
    hit = F.lit(True) if scope.document_id is None else F.col("document_id") == scope.document_id
    if scope.kind == "page":
        hit = hit & (F.col("page_number") == scope.page_start)
    elif scope.kind in ("page_range", "chapter"):
        hit = hit & (F.col("page_number") >= scope.page_start)
        if scope.page_end is not None:
            hit = hit & (F.col("page_number") <= scope.page_end)
    return F.coalesce(hit, F.lit(False))


def _doomed(name: str, scope: Scope) -> Column:
    """Which rows of a table the purge deletes."""
    kind = scope.kind
    if kind == "database":
        return F.lit(True)
    if kind == "curriculum_only":
        return F.lit(name in CURRICULUM)
    if kind == "artifacts_only" and name != "artifacts":
        return F.lit(False)
    if name in PAGED:
        hit = in_scope(scope)
        if name in HUMAN and scope.preserve_human:
            hit = hit & ~F.coalesce("is_human_edited", F.lit(False))
        return hit
    if kind == "document" and name in ("toc", "benchmarks"):
        return F.coalesce(F.col("document_id") == scope.document_id, F.lit(False))
    return F.lit(False)


def _guard(scope: Scope, corpus: str | None, confirm: str | None) -> None:
    if scope.kind == "database" and (not corpus or confirm != corpus):
        raise ValueError("purging a whole corpus needs confirm = its exact name")


def purge(
    tables: dict[str, DataFrame], scope: Scope, corpus: str | None = None, confirm: str | None = None
) -> dict[str, DataFrame]:
    """Tables without the rows of the scope.  Batches left without queued jobs
    in the scope are not touched."""
    _guard(scope, corpus, confirm)
    scope = resolve(scope, tables.get("toc"))
    return {name: df.where(~_doomed(name, scope)) for name, df in tables.items()}


def purge_preview(tables: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """Rows to delete and human rows kept, per table: exactly what purge does."""
    scope = resolve(scope, tables.get("toc"))
    rows = None
    for name, df in tables.items():
        kept = (
            in_scope(scope) & F.coalesce("is_human_edited", F.lit(False))
            if name in HUMAN and scope.preserve_human and scope.kind not in ("database", "curriculum_only")
            and not (scope.kind == "artifacts_only" and name != "artifacts")
            else F.lit(False)
        )
        part = df.agg(
            F.count(F.when(_doomed(name, scope), 1)).alias("deleted"),
            F.count(F.when(kept, 1)).alias("preserved_human"),
        ).select(F.lit(name).alias("table"), "deleted", "preserved_human")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def reprocess(tables: dict[str, DataFrame], scope: Scope, batch_id: str) -> dict[str, DataFrame]:
    """Purge a scope, then queue the same pages again."""
    scope = resolve(scope, tables["toc"])
    clean = purge(tables, scope)
    mode = "page_range" if scope.kind in ("page", "page_range", "chapter") else "document"
    request = clean["documents"].where(F.col("document_id") == scope.document_id).select(
        F.lit(batch_id).alias("batch_id"), "document_id", F.lit(mode).alias("mode"),
        F.lit(scope.page_start).cast("int").alias("page_start"),
        (F.coalesce(F.lit(scope.page_end).cast("int"), F.lit(scope.page_start).cast("int"))
         if scope.kind == "page" else F.coalesce(F.lit(scope.page_end).cast("int"), F.col("total_pages"))).alias("page_end"),
        F.lit(None).cast(clean["toc"].schema["toc_id"].dataType).alias("toc_id"),
    )
    new = enqueue(request, clean["documents"], clean["toc"], clean["jobs"])
    clean["jobs"] = clean["jobs"].unionByName(new, allowMissingColumns=True)
    return clean


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key."""
    return df.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")


def reingest(existing: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace the pages named in ``new["page_scans"]``.

    Human rows stay and hold their chunk_index; artifacts hang on the first
    new chunk of their page; scans are upserted, bench rows appended.
    """
    page = ["document_id", "page_number"]
    pages = new["page_scans"].select(*page).distinct().withColumn("_redo", F.lit(True))

    def kept(name: str) -> DataFrame:
        marked = existing[name].join(pages, page, "left")
        old = F.coalesce("_redo", F.lit(False)) & ~F.coalesce("is_human_edited", F.lit(False))
        return marked.where(~old).drop("_redo")

    old_chunks = kept("chunks")
    ids = new["chunks"].withColumn(
        "chunk_id",
        key_id("chunk", F.col("document_id"), F.col("page_number"), F.col("chunk_index"))
        .cast(existing["chunks"].schema["chunk_id"].dataType),
    ) if "chunk_id" not in new["chunks"].columns else new["chunks"]
    added = unprotected(ids, old_chunks)
    first = added.where("chunk_index = 0").select(*page, F.col("chunk_id").alias("_first"))
    artifacts = (
        new["artifacts"].where("raw_data is not null or raw_binary is not null")
        .drop("chunk_id").join(first, page, "left").withColumnRenamed("_first", "chunk_id")
    )
    out = {
        "chunks": old_chunks.unionByName(added, allowMissingColumns=True),
        "artifacts": kept("artifacts").unionByName(artifacts, allowMissingColumns=True),
        "page_scans": upsert(existing["page_scans"], new["page_scans"], page),
    }
    if "benchmarks" in new:
        out["benchmarks"] = existing["benchmarks"].unionByName(new["benchmarks"], allowMissingColumns=True)
    return out


CHUNK_FIELDS = ("content_markdown", "section_title", "pedagogical_type")
ARTIFACT_FIELDS = ("raw_data", "caption", "render_config_json")


def apply_edits(df: DataFrame, patches: DataFrame, key: str, fields: tuple[str, ...], now: Column) -> DataFrame:
    """Human corrections: null patch fields keep the old value; the row is
    flagged and stamped.  New raw data also becomes the search text."""
    renamed = patches.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_edit"))
    joined = df.join(renamed, key, "left")
    edited = F.coalesce("_edit", F.lit(False))
    new = {f: F.coalesce(f"_p_{f}", f) for f in fields}
    new["is_human_edited"] = F.when(edited, F.lit(True)).otherwise(F.col("is_human_edited"))
    new["updated_at"] = F.when(edited, now).otherwise(F.col("updated_at"))
    if "raw_data" in fields and "searchable_text" in df.columns:
        new["searchable_text"] = F.coalesce("_p_raw_data", "searchable_text")
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def edit_report(edited: DataFrame, patches: DataFrame) -> DataFrame:
    """Lint result of each corrected chunk; edits are kept whatever it says."""
    touched = edited.join(patches.select("chunk_id").distinct(), "chunk_id", "left_semi")
    errors = lint_chunk(F.col("content_markdown"))
    return touched.select("chunk_id", F.size(errors).alias("n_errors"), (F.size(errors) == 0).alias("is_valid"))


def reembed(vectors: DataFrame, edited: DataFrame, patches: DataFrame, encoder) -> DataFrame:
    """Vectors after corrections: those of the corrected chunks are made anew from their whole text, a chunk
    that had none gets one.  Only corrected chunks reach the model."""
    from foliospark.plans.chunk_corpus import embed

    touched = edited.join(patches.select("chunk_id").distinct(), "chunk_id", "left_semi")
    fresh = embed(touched.select("chunk_id", "content_markdown"), encoder).select(
        "chunk_id", F.col("embedding").alias("_new"))
    known = vectors.join(fresh, "chunk_id", "left")
    updated = known.select(*[
        F.coalesce("_new", "embedding").alias(c) if c == "embedding" else F.col(c) for c in vectors.columns])
    others = touched.join(vectors.select("chunk_id"), "chunk_id", "left_anti").join(fresh, "chunk_id")
    added = others.withColumn("embedding", F.col("_new")).select(*[
        F.col(c) if c in (*others.columns, "embedding") else F.lit(None).cast(vectors.schema[c].dataType).alias(c)
        for c in vectors.columns])
    return updated.unionByName(added)


def cascade_delete(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Drop documents with their dependents; links that point at a dropped
    chunk or entry become null.  Links and their targets meet in tasks of
    about ``session.TASK_ROWS`` rows where there are more than that."""
    gone = documents.select("document_id").distinct()
    out = {
        name: df.join(gone, "document_id", "left_anti") if "document_id" in df.columns else df
        for name, df in tables.items()
    }

    held: dict[str, int] = {}

    def size(name: str) -> int:
        if name not in held:
            held[name] = tables[name].count()
        return held[name]

    def null_out(name: str, column: str, parent: str, key: str) -> None:
        if name not in out or parent not in out or column not in out[name].columns:
            return
        alive, linked = out[parent].select(F.col(key).alias("_alive")), out[name].where(F.col(column).isNotNull())
        rows = size(name) + size(parent)
        if rows > session.TASK_ROWS:
            # Adaptive execution would join small partitions by their compressed bytes, which say little of the memory of a sort.
            tasks = session.tasks_for(linked.sparkSession, rows)
            alive, linked = alive.repartition(tasks, "_alive"), linked.repartition(tasks, column)
        df = linked.join(alive.distinct(), F.col(column) == F.col("_alive"), "left")
        kept = df.withColumn(column, F.col("_alive")).select(*out[name].columns)
        out[name] = kept.unionByName(out[name].where(F.col(column).isNull()))

    null_out("chunks", "toc_id", "toc", "toc_id")
    null_out("chunks", "linked_solution_chunk_id", "chunks", "chunk_id")
    null_out("artifacts", "chunk_id", "chunks", "chunk_id")
    return out
