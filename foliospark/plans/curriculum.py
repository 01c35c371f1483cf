"""Curriculum derived from contents, typed chunks and exam documents.

Every table carries ``document_id``: builds, purges and range joins work per
document, and ids are hashes of their keys, so a rerun writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.filters import EXERCISES
from foliospark.operators.joins import page_lesson
from foliospark.operators.scans import row_number_by
from foliospark.session import checkpointed

# Fixed values.
AUTO = "auto"
TERM_INDEX, TERM_LABEL = 1, "البرنامج"
COURSE_TYPES = ("course_theory", "proof_demonstration")
EXAM_DOC_TYPES = ("sujet", "exam", "examen", "subject", "assessment")
EXAM_TITLE, EXAM_PAGE_TITLE, SERIES_TITLE = "تقييم", "تقييم — صفحة ", "سلسلة تمارين"
TABLES = ("terms", "programs", "links", "assessments")
_META = {
    "terms": "metadata_json", "programs": "competencies_json", "links": "metadata_json",
    "assessments": "scale_json",
}


def key_id(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(":", *cols), 256)


def is_auto(column: str) -> Column:
    return F.coalesce(F.get_json_object(column, "$.source") == AUTO, F.lit(False))


def sequence_lessons(toc: DataFrame) -> DataFrame:
    """Level-one entries numbered per document by (start, title)."""
    lessons = toc.where("level = 1")
    return row_number_by(
        lessons, ["document_id"], [F.col("page_start"), F.col("title"), F.col("toc_id")],
        F.floor(F.col("page_start") / 64), "seq_index",
    )


def lesson_chunks(toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """Course and exercise chunks with their lesson; chunks outside every
    lesson dropped.  One range join serves both kinds of edges."""
    wanted = chunks.where(F.col("pedagogical_type").isin(*COURSE_TYPES, *EXERCISES)).select(
        "document_id", "chunk_id", "page_number", "chunk_index",
        F.col("pedagogical_type").isin(*COURSE_TYPES).alias("is_course"),
    )
    return page_lesson(wanted, toc, how="inner")


def _edges(df: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    return df.select(
        "document_id",
        key_id(kind, F.col(source), F.col(target)).alias("link_id"),
        F.lit(kind).alias("link_type"),
        F.col(source).cast("string").alias("from_id"),
        F.col(target).cast("string").alias("to_id"),
        F.col("page_number").cast("int").alias("page_number"),
        F.lit(f'{{"source": "{AUTO}"}}').alias("metadata_json"),
    )


def course_program_edges(placed: DataFrame) -> DataFrame:
    courses = placed.where("is_course").withColumn("program_id", key_id("program", F.col("lesson_id")))
    return _edges(courses, "course_program", "chunk_id", "program_id")


def course_exercise_edges(placed: DataFrame) -> DataFrame:
    """First course chunk of a lesson to each of the lesson's exercises; a
    lesson without course gives no edge."""
    first = placed.where("is_course").groupBy("lesson_id").agg(
        F.min_by("chunk_id", F.struct("page_number", "chunk_index", "chunk_id")).alias("course_id")
    )
    exercises = placed.where("not is_course").join(first, "lesson_id")
    return _edges(exercises, "course_exercise", "course_id", "chunk_id")


def exam_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.lower("doc_type").isin(*EXAM_DOC_TYPES))


def build_curriculum(
    toc: DataFrame, chunks: DataFrame, documents: DataFrame, existing: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The four curriculum tables.  Rows entered by people stay, rows built
    before are replaced, a document without structure gets nothing."""
    lessons = sequence_lessons(toc)
    exams = chunks.where("pedagogical_type = 'evaluation_exam'")
    exam_docs = exam_documents(documents)
    structured = (
        lessons.select("document_id").unionByName(exams.select("document_id"))
        .unionByName(exam_docs.select("document_id")).distinct()
    )
    auto = F.lit(f'{{"source": "{AUTO}"}}')
    terms = structured.select(
        "document_id", key_id("term", F.col("document_id")).alias("term_id"),
        F.lit(TERM_INDEX).alias("term_index"), F.lit(TERM_LABEL).alias("label"), auto.alias("metadata_json"),
    )
    programs = lessons.select(
        "document_id", key_id("program", F.col("toc_id")).alias("program_id"),
        key_id("term", F.col("document_id")).alias("term_id"), F.col("seq_index").cast("int").alias("seq_index"),
        F.coalesce("title", F.lit("")).alias("title"), F.lit(AUTO).alias("source"),
        F.to_json(F.struct(
            F.lit(AUTO).alias("source"), F.col("toc_id").cast("string").alias("toc_id"), "page_start", "page_end"
        )).alias("competencies_json"),
        F.col("page_start").alias("page_number"),
    )
    placed = checkpointed(lesson_chunks(toc, chunks))
    links = (
        _edges(programs, "program_term", "program_id", "term_id")
        .unionByName(course_program_edges(placed))
        .unionByName(course_exercise_edges(placed))
    )
    title = F.trim(F.coalesce("section_title", F.lit("")))
    by_page = F.concat(F.lit(EXAM_PAGE_TITLE), F.col("page_number").cast("string"))
    none = F.lit(None).cast("string")
    from_chunks = exams.select(
        "document_id", key_id("assessment", F.col("chunk_id")).alias("assessment_id"), none.alias("term_id"),
        F.lit("autre").alias("kind"),
        F.when(title != "", title).otherwise(F.coalesce(by_page, F.lit(EXAM_TITLE))).alias("title"),
        F.col("chunk_id").cast("string").alias("subject_chunk_id"),
        F.col("linked_solution_chunk_id").cast("string").alias("correction_chunk_id"), auto.alias("scale_json"),
    )
    from_documents = exam_docs.select(
        "document_id", key_id("assessment-document", F.col("document_id")).alias("assessment_id"),
        none.alias("term_id"), F.lit("autre").alias("kind"),
        F.coalesce("title", F.lit(SERIES_TITLE)).alias("title"),
        none.alias("subject_chunk_id"), none.alias("correction_chunk_id"), auto.alias("scale_json"),
    )
    built = {
        "terms": terms,
        "programs": programs.drop("page_number"),
        "links": links,
        "assessments": from_chunks.unionByName(from_documents),
    }
    for name, old in (existing or {}).items():
        built[name] = old.where(~is_auto(_META[name])).unionByName(built[name], allowMissingColumns=True)
    return built


def curriculum_counts(built: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """lessons, exercises, solutions, assessments of the rows just built, per
    document."""
    parts = [
        built["programs"].where(is_auto("competencies_json")).select("document_id", F.lit("lessons").alias("k")),
        built["links"].where(is_auto("metadata_json") & (F.col("link_type") == "course_exercise"))
        .select("document_id", F.lit("exercises").alias("k")),
        chunks.where("pedagogical_type = 'solution_only'").select("document_id", F.lit("solutions").alias("k")),
        built["assessments"].where(is_auto("scale_json")).select("document_id", F.lit("assessments").alias("k")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    count = lambda k: F.count(F.when(F.col("k") == k, 1)).alias(k)
    return rows.groupBy("document_id").agg(*[count(k) for k in ("lessons", "exercises", "solutions", "assessments")])
