"""Counts and averages over the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.operators.filters import EXERCISES
from foliospark.operators.joins import page_chapter, term_exercises
from foliospark.operators.scans import row_number_by

count_if = lambda c: F.count(F.when(c, 1))


def facets(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts per domain, pedagogical type and artifact type in one pass over
    each table."""
    pairs = lambda *names: F.explode(
        F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in names])
    )
    art = artifacts.select(pairs("domain", "artifact_type").alias("f"))
    chk = chunks.where("pedagogical_type is not null").select(pairs("pedagogical_type").alias("f"))
    return art.unionByName(chk).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def corpus_metrics(documents: DataFrame, chunks: DataFrame, artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Five counts per corpus; a corpus missing from a table counts zero."""
    parts = [
        documents.groupBy("corpus").agg(
            F.count("*").alias("documents"), F.sum("total_pages").cast("long").alias("pages")
        ),
        chunks.groupBy("corpus").agg(F.count("*").alias("chunks")),
        artifacts.groupBy("corpus").agg(F.count("*").alias("artifacts")),
        jobs.where("status = 'READY'").groupBy("corpus").agg(F.count("*").alias("ready_jobs")),
    ]
    joined = reduce(lambda a, b: a.join(b, "corpus", "full_outer"), parts)
    names = ("documents", "pages", "chunks", "artifacts", "ready_jobs")
    return joined.select("corpus", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def corpus_totals(metrics: DataFrame) -> DataFrame:
    """Per corpus and overall (null corpus)."""
    names = [c for c in metrics.columns if c != "corpus"]
    return metrics.rollup("corpus").agg(*[F.sum(n).cast("long").alias(n) for n in names])


def term_counts(terms: DataFrame, programs: DataFrame, assessments: DataFrame, links: DataFrame) -> DataFrame:
    linked = (
        links.where("link_type = 'course_program'")
        .join(programs.select(F.col("program_id").alias("to_id"), "term_id"), "to_id")
        .groupBy("term_id")
        .agg(F.countDistinct("from_id").alias("courses"))
    )
    parts = [
        programs.groupBy("term_id").agg(F.count("*").alias("programs")),
        assessments.groupBy("term_id").agg(F.count("*").alias("assessments")),
        linked,
        term_exercises(links, programs).groupBy("term_id").agg(F.count("*").alias("exercises")),
    ]
    joined = reduce(lambda a, b: a.join(b, "term_id", "left"), parts, terms.select("term_id"))
    names = ("programs", "assessments", "courses", "exercises")
    return joined.select("term_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def global_counts(
    documents: DataFrame, toc: DataFrame, chunks: DataFrame, assessments: DataFrame, scans: DataFrame
) -> DataFrame:
    """Courses fall back to documents without chapters; assessments are the
    larger of the table and the exam chunks."""
    c = chunks.agg(
        count_if(F.col("pedagogical_type").isin(*EXERCISES)).alias("exercises"),
        count_if(F.col("pedagogical_type") == "solution_only").alias("solutions"),
        count_if(F.col("pedagogical_type") == "evaluation_exam").alias("exam_chunks"),
    )
    t = toc.agg(count_if(F.col("level") == 1).alias("chapters"))
    d = documents.agg(F.count("*").alias("documents"))
    a = assessments.agg(F.count("*").alias("assessment_rows"))
    s = scans.agg(F.count("*").alias("scans"))
    # One row each, so joining on a constant key is a join of single rows.
    one = reduce(lambda x, y: x.join(y, "_k"), [p.withColumn("_k", F.lit(1)) for p in (c, t, d, a, s)])
    return one.select(
        F.when(F.col("chapters") > 0, F.col("chapters")).otherwise(F.col("documents")).alias("courses"),
        F.greatest("assessment_rows", "exam_chunks").alias("assessments"),
        "exercises", "solutions", "scans", "chapters",
    )


def page_manifest(scans: DataFrame, toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scans with their chapter and exercise count; no image is read."""
    pages = scans.select("document_id", "page_number", "width_px", "height_px")
    counts = (
        chunks.where(F.col("pedagogical_type").isin(*EXERCISES))
        .groupBy("document_id", "page_number")
        .agg(F.count("*").alias("exercises_count"))
    )
    return (
        page_chapter(pages, toc)
        .join(counts, ["document_id", "page_number"], "left")
        .withColumn("exercises_count", F.coalesce("exercises_count", F.lit(0)))
    )


def telemetry_averages(bench: DataFrame, document_id=None) -> DataFrame:
    if document_id is not None:
        bench = bench.where(F.col("document_id") == document_id)
    mean = lambda c, digits: F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))
    flag = lambda c: c.cast("double")
    return bench.agg(
        mean("execution_time_ms", 1).alias("avg_latency_ms"),
        mean("confidence_score", 3).alias("avg_confidence"),
        mean("ram_peak_mb", 1).alias("avg_ram_mb"),
        mean(flag(F.col("vlm_provider_used").isNotNull()), 3).alias("vlm_rate"),
        mean(flag(F.col("fallback_triggered")), 3).alias("fallback_rate"),
    )


def batch_progress(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    done = jobs.groupBy("batch_id").agg(
        count_if(F.col("status") == "READY").alias("ready"),
        F.count("*").alias("total"),
        F.countDistinct("document_id").alias("documents"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return batches.select("batch_id").join(done, "batch_id", "left").select(
        "batch_id", zero("ready").alias("ready"), zero("total").alias("total"), zero("documents").alias("documents"),
        (zero("ready") == zero("total")).alias("success"),
    )


def queue_state(jobs: DataFrame, today: Column | None = None) -> DataFrame:
    day = F.current_date() if today is None else today
    return jobs.agg(
        count_if(F.col("status") == "QUEUED").alias("queued"),
        count_if((F.col("status") == "READY") & (F.to_date("updated_at") == day)).alias("ready_today"),
    )


def lint_report(linted: DataFrame) -> DataFrame:
    """Errors per code and severity."""
    return (
        linted.select(F.explode("errors").alias("e"))
        .groupBy("e.error_type", "e.severity")
        .agg(F.count("*").alias("n"))
    )


def lint_pages(linted: DataFrame) -> DataFrame:
    """Per page: valid iff no error; a model is needed iff any ERROR."""
    errors = F.size(F.filter("errors", lambda e: e["severity"] == "ERROR"))
    return (
        linted.select("document_id", "page_number", errors.alias("e"), (F.size("errors") - errors).alias("w"))
        .groupBy("document_id", "page_number")
        .agg(F.sum("e").alias("n_errors"), F.sum("w").alias("n_warnings"))
        .withColumn("is_valid", F.col("n_errors") + F.col("n_warnings") == 0)
        .withColumn("skip_vlm", F.col("n_errors") == 0)
    )


def throughput_eta(bench: DataFrame, pages_total: int, now: Column, last: int = 10) -> DataFrame:
    """Pages per hour and finish time from the last few page latencies."""
    recent = bench.orderBy(F.desc("created_at"), F.desc("page_number")).limit(last)
    done = bench.agg(F.count("*").alias("n")).scalar()
    left = F.greatest(F.lit(0), F.lit(pages_total) - done)
    return recent.agg(F.avg("execution_time_ms").alias("avg_ms")).select(
        F.round("avg_ms", 4).alias("avg_ms"),
        F.round(F.lit(3.6e6) / F.col("avg_ms")).cast("long").alias("pages_per_hour"),
        left.cast("long").alias("remaining"),
        F.round(left * F.col("avg_ms") / 1000).cast("long").alias("seconds_left"),
        (now + F.make_interval(secs=F.round(left * F.col("avg_ms") / 1000).cast("decimal(18,6)"))).alias("finish_at"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def evaluation_groups(chunks: DataFrame) -> DataFrame:
    """One row per (subject, correction): corrections belong to the first
    subject of their document, other subjects stand alone, corrections without
    a subject stay, documents with neither vanish."""
    subjects = chunks.where("pedagogical_type = 'evaluation_exam'")
    corrections = chunks.where("pedagogical_type = 'solution_only'").select(
        "document_id", F.col("chunk_id").alias("correction_id")
    )
    first = subjects.groupBy("document_id").agg(
        F.min_by("chunk_id", F.struct("page_number", "chunk_index", "chunk_id")).alias("subject_id")
    )
    attached = corrections.join(first, "document_id", "left").select("document_id", "subject_id", "correction_id")
    alone = subjects.select("document_id", F.col("chunk_id").alias("subject_id")).join(
        attached.select("subject_id").where("subject_id is not null").distinct(), "subject_id", "left_anti"
    )
    return attached.unionByName(alone.withColumn("correction_id", F.lit(None).cast(attached.schema["correction_id"].dataType)))


def reading_order(chunks: DataFrame) -> DataFrame:
    """Position of each chunk on its page."""
    keyed = chunks.select("document_id", "page_number", "chunk_id", "chunk_index")
    return row_number_by(
        keyed, ["document_id", "page_number"], [F.col("chunk_index"), F.col("chunk_id")],
        F.floor(F.col("chunk_index") / 64), "position",
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def table_census(tables: dict[str, DataFrame], sizes: DataFrame | None = None) -> DataFrame:
    """Rows per table and corpus with totals (null corpus); ``sizes`` may give
    ``corpus, size_bytes``."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.groupBy("corpus").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
            for name, df in tables.items()
        ],
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    wide = counts.rollup("corpus").agg(
        *[zero(F.when(F.col("table") == name, F.col("n"))).alias(name) for name in tables],
        F.sum("n").cast("long").alias("total_rows"),
        F.countDistinct("table").alias("tables"),
    )
    if sizes is None:
        return wide
    mb = sizes.rollup("corpus").agg(F.round(F.sum("size_bytes") / 1048576, 2).alias("size_mb"))
    return wide.join(mb, wide["corpus"].eqNullSafe(mb["corpus"]), "left").drop(mb["corpus"])


def term_matrix(terms: DataFrame, courses: DataFrame, programs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Items of each term, one row per (term, kind, item); a term without
    items keeps one row, items of unknown terms are dropped."""
    side = lambda df, kind, ident, n: df.select(
        "term_id", F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("item_id"), n.cast("long").alias("exercises")
    )
    items = (
        side(courses, "course", "course_id", F.col("exercises_count"))
        .unionByName(side(programs, "sequence", "program_id", F.lit(0)))
        .unionByName(side(assessments, "assessment", "assessment_id", F.lit(0)))
    )
    return terms.select("term_id").join(items, "term_id", "left")


def term_matrix_counts(matrix: DataFrame) -> DataFrame:
    kind = lambda k: count_if(F.col("kind") == k)
    return matrix.groupBy("term_id").agg(
        kind("course").alias("courses"), kind("sequence").alias("sequences"),
        kind("assessment").alias("assessments"),
        F.coalesce(F.sum("exercises"), F.lit(0)).cast("long").alias("exercises"),
    )


def latency_share(bench: DataFrame) -> DataFrame:
    """Every bench pass relative to the slowest one of its page."""
    top = F.max("execution_time_ms").over(W.partitionBy("document_id", "page_number"))
    return bench.withColumn("share", F.when(top > 0, F.col("execution_time_ms") / top).otherwise(0.0))
