"""Joins of the corpus tables.

Only inputs with a fixed row limit are hinted for broadcast; for all others
the optimizer decides from the sizes it sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.text import ANCHOR
from foliospark.operators.ranges import range_match

PAGE = ["document_id", "page_number"]


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Search hits with their chunk and document; ``hits`` holds top-k rows
    only, so it is the broadcast side.  ``max_chars`` cuts the texts."""
    body = F.col("content_markdown") if max_chars is None else F.substring("content_markdown", 1, max_chars)
    text = chunks.select(
        "chunk_id", "document_id", "page_number", "section_title", body.alias("content_markdown"), "pedagogical_type",
    )
    found = text.join(F.broadcast(hits), "chunk_id")
    titles = documents.select("document_id", F.col("title").alias("document_title"))
    return titles.join(F.broadcast(found), "document_id")


def with_page_dims(artifacts: DataFrame, scans: DataFrame) -> DataFrame:
    dims = scans.select(*PAGE, "width_px", "height_px")
    return artifacts.join(dims, PAGE, "left")


def page_chapter(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Latest level-one entry that starts at or before the page and holds it."""
    chapters = toc.where("level = 1").select(
        "document_id", F.col("toc_id").alias("chapter_id"), F.col("title").alias("chapter_title"),
        "page_start", "page_end",
    )
    return range_match(
        pages, chapters, ["document_id"], "page_number", "page_start", "page_end",
        ["chapter_id", "chapter_title"], [F.col("page_start"), F.col("chapter_id")], pick="latest",
    )


def page_lesson(chunks: DataFrame, toc: DataFrame, how: str = "left") -> DataFrame:
    """First lesson in (start, title) order whose pages hold the chunk."""
    lessons = toc.where("level = 1").select(
        "document_id", F.col("toc_id").alias("lesson_id"), F.col("title").alias("lesson_title"),
        "page_start", "page_end",
    )
    return range_match(
        chunks, lessons, ["document_id"], "page_number", "page_start", "page_end",
        ["lesson_id", "lesson_title"],
        [F.col("page_start"), F.col("lesson_title"), F.col("lesson_id")], how=how,
    )


def chunk_toc(chunks: DataFrame, toc: DataFrame) -> DataFrame:
    """First entry in document order that holds the chunk's page."""
    entries = toc.select("document_id", "toc_id", "ord", "page_start", "page_end")
    return range_match(
        chunks.drop("toc_id"), entries, ["document_id"], "page_number", "page_start", "page_end",
        ["toc_id"], [F.col("ord"), F.col("toc_id")],
    )


# ── exercises and solutions ────────────────────────────────────────────────


def _place() -> Column:
    return F.struct("page_number", "chunk_index", "chunk_id")


def first_solutions(chunks: DataFrame) -> DataFrame:
    """First solution and number of solutions per (document, index)."""
    solutions = chunks.where("pedagogical_type = 'solution_only' and pedagogical_index is not null")
    return solutions.groupBy("document_id", "pedagogical_index").agg(
        F.min_by("chunk_id", _place()).alias("solution_id"), F.count("*").alias("n_solutions")
    )


def link_solutions(chunks: DataFrame) -> DataFrame:
    """Chunks with unsolved exercises tied to the first solution of their index.

    Only numbered open exercises take part in the join; all other rows pass by
    without a shuffle (most chunks have no index, and null keys would pile up).
    """
    candidate = F.coalesce(
        (F.col("pedagogical_type") == "exercise_unsolved")
        & F.col("linked_solution_chunk_id").isNull()
        & F.col("pedagogical_index").isNotNull(),
        F.lit(False),
    )
    found = chunks.where(candidate).join(
        first_solutions(chunks).drop("n_solutions"), ["document_id", "pedagogical_index"], "left"
    )
    hit = F.col("solution_id").isNotNull()
    new = {
        "linked_solution_chunk_id": F.col("solution_id"),
        "has_solution": F.when(hit, F.lit(True)).otherwise(F.col("has_solution")),
        "pedagogical_type": F.when(hit, "exercise_solved").otherwise(F.col("pedagogical_type")),
    }
    linked = found.select(*[new.get(c, F.col(c)).alias(c) for c in chunks.columns])
    return linked.unionByName(chunks.where(~candidate))


def ambiguous_solutions(chunks: DataFrame) -> DataFrame:
    return first_solutions(chunks).where("n_solutions > 1").select("document_id", "pedagogical_index", "n_solutions")


def _course_edges(links: DataFrame) -> DataFrame:
    """course_exercise edges read in both directions."""
    edges = links.where("link_type = 'course_exercise'")
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "link_id").unionByName(
        edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "link_id")
    )


def resolve_solutions(exercises: DataFrame, solutions: DataFrame, links: DataFrame) -> DataFrame:
    """Solution of each exercise by decreasing reliability, with its source:
    direct link, graph edge, same index (last one), first of the document."""
    # Only exercises that carry a link look it up; null links would pile up
    # in one partition of a left join.
    direct = (
        exercises.where("linked_solution_chunk_id is not null")
        .select("chunk_id", F.col("linked_solution_chunk_id").alias("direct_id"))
        .join(solutions.select(F.col("chunk_id").alias("direct_id")), "direct_id")
    )
    by_edge = (
        _course_edges(links)
        .join(solutions.select(F.col("chunk_id").alias("b")), "b")
        .groupBy(F.col("a").alias("chunk_id"))
        .agg(F.min_by("b", "link_id").alias("edge_id"))
    )
    last = F.struct("document_id", "page_number", "chunk_index", "chunk_id")
    by_index = (
        solutions.where("pedagogical_index is not null")
        .groupBy("pedagogical_index")
        .agg(F.max_by("chunk_id", last).alias("index_id"))
    )
    # Only numbered exercises look their number up; the others would meet in one partition.
    numbered = exercises.where("pedagogical_index is not null").select("chunk_id", "pedagogical_index").join(
        by_index, "pedagogical_index").select("chunk_id", "index_id")
    by_document = solutions.groupBy("document_id").agg(F.min_by("chunk_id", _place()).alias("document_first_id"))
    sources = ("direct_id", "edge_id", "index_id", "document_first_id")
    label = F.coalesce(
        *[F.when(F.col(c).isNotNull(), n) for c, n in zip(sources, ("direct", "edge", "index", "document"))]
    )
    return (
        exercises.join(direct, "chunk_id", "left")
        .join(by_edge, "chunk_id", "left")
        .join(numbered, "chunk_id", "left")
        .join(by_document, "document_id", "left")
        .select("chunk_id", F.coalesce(*sources).alias("solution_id"), label.alias("link_source"))
    )


def solution_to_exercise(exercises: DataFrame, links: DataFrame) -> DataFrame:
    """Inverse index; direct links come before edges, then the first writer."""
    direct = exercises.where("linked_solution_chunk_id is not null").select(
        F.col("linked_solution_chunk_id").alias("solution_id"), F.col("chunk_id").alias("exercise_id"),
        F.struct(F.lit(0).alias("rank"), F.col("chunk_id").cast("string").alias("at")).alias("o"),
    )
    known = exercises.select(F.col("chunk_id").alias("x"))
    edges = links.where("link_type = 'course_exercise'")
    forward = edges.join(known, edges["from_id"] == known["x"], "left_semi").select(
        F.col("to_id").alias("solution_id"), F.col("from_id").alias("exercise_id"), "link_id"
    )
    backward = (
        edges.join(known, edges["to_id"] == known["x"], "left_semi")
        .join(known, edges["from_id"] == known["x"], "left_anti")
        .select(F.col("from_id").alias("solution_id"), F.col("to_id").alias("exercise_id"), "link_id")
    )
    by_edge = forward.unionByName(backward).select(
        "solution_id", "exercise_id",
        F.struct(F.lit(1).alias("rank"), F.col("link_id").cast("string").alias("at")).alias("o"),
    )
    return direct.unionByName(by_edge).groupBy("solution_id").agg(F.min_by("exercise_id", "o").alias("exercise_id"))


def course_terms(links: DataFrame, programs: DataFrame, terms: DataFrame) -> DataFrame:
    """Term index of each course through its program, either edge direction;
    the last edge of a course decides."""
    program_term = programs.join(terms, "term_id").select("program_id", "term_index")
    edges = links.where("link_type = 'course_program'").select("from_id", "to_id", "link_id")
    to_side = program_term.select(F.col("program_id").alias("to_id"), F.col("term_index").alias("to_term"))
    from_side = program_term.select(F.col("program_id").alias("from_id"), F.col("term_index").alias("from_term"))
    both = edges.join(to_side, "to_id", "left").join(from_side, "from_id", "left")
    placed = both.select(
        F.when(F.col("to_term").isNotNull(), F.col("from_id")).otherwise(F.col("to_id")).alias("course_id"),
        F.coalesce("to_term", "from_term").alias("term_index"), "link_id",
    ).where("term_index is not null")
    return placed.groupBy("course_id").agg(F.max_by("term_index", "link_id").alias("term_index"))


def exercise_terms(exercises: DataFrame, links: DataFrame, programs: DataFrame, terms: DataFrame) -> DataFrame:
    """exercise – course – program – term; null where the chain breaks."""
    found = (
        _course_edges(links)
        .join(course_terms(links, programs, terms), F.col("b") == F.col("course_id"))
        .groupBy(F.col("a").alias("chunk_id"))
        .agg(F.min_by("term_index", "link_id").alias("term_index"))
    )
    return exercises.select("chunk_id").join(found, "chunk_id", "left")


def term_exercises(links: DataFrame, programs: DataFrame) -> DataFrame:
    """course_exercise edges whose course is tied to a program of the term."""
    courses = (
        links.where("link_type = 'course_program'")
        .select(F.col("from_id").alias("course_id"), F.col("to_id").alias("program_id"))
        .join(programs.select("program_id", "term_id"), "program_id")
        .select("course_id", "term_id")
        .distinct()
    )
    edges = links.where("link_type = 'course_exercise'").select(
        F.col("from_id").alias("course_id"), F.col("to_id").alias("exercise_id")
    )
    return edges.join(courses, "course_id").select("term_id", "course_id", "exercise_id")


def finished_batches(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Batches without an unfinished job."""
    open_jobs = jobs.where(~F.col("status").isin("READY", "QUARANTINE", "INVALID_SOURCE")).select("batch_id")
    return batches.join(open_jobs, "batch_id", "left_anti")


# ── trees, assets, media ───────────────────────────────────────────────────


def toc_tree(toc: DataFrame) -> DataFrame:
    """Depth and title path of each entry; an unknown parent makes a root.
    Three levels at most, so two self-joins reach every root."""
    up = toc.select(F.col("toc_id").alias("p1"), F.col("title").alias("t1"), F.col("parent_id").alias("pp"))
    top = toc.select(F.col("toc_id").alias("p2"), F.col("title").alias("t2"))
    joined = toc.join(up, toc["parent_id"] == up["p1"], "left").join(top, up["pp"] == top["p2"], "left")
    depth = F.when(F.col("p1").isNull(), 1).when(F.col("p2").isNull(), 2).otherwise(3)
    return joined.select(
        "document_id", "toc_id", F.col("p1").alias("parent_id"), "level", "page_start",
        depth.alias("depth"), F.concat_ws(" / ", "t2", "t1", "title").alias("path"),
    )


def resolve_assets(chunks: DataFrame, artifacts: DataFrame, text: str = "content_markdown") -> DataFrame:
    """Artifact anchors in text with what can be shown for each."""
    anchors = chunks.where(F.col(text).contains("asset://artifacts/")).select(
        "chunk_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(ANCHOR), F.lit(2))).alias("pos", "artifact_ref")
    )
    known = artifacts.select(
        F.col("artifact_id").cast("string").alias("artifact_ref"), "artifact_type", "raw_data", "has_binary"
    )
    state = F.when(F.coalesce("raw_data", F.lit("")) != "", "structured").when(
        F.coalesce("has_binary", F.lit(False)), "original"
    ).when(F.col("artifact_type").isNull(), "unknown").otherwise("empty")
    return anchors.join(known, "artifact_ref", "left").select(
        "chunk_id", "pos", "artifact_ref", "artifact_type", state.alias("shown_as")
    )


def assessment_media(assessments: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts of the subject and of the correction of each assessment."""
    media = artifacts.select("artifact_id", "chunk_id", "artifact_type")

    def side(column: str, role: str) -> DataFrame:
        wanted = assessments.select("assessment_id", "term_id", F.col(column).alias("chunk_id"))
        return wanted.join(media, "chunk_id").select(
            "assessment_id", "term_id", F.lit(role).alias("role"), "artifact_id", "artifact_type"
        )

    return side("subject_chunk_id", "sujet").unionByName(side("correction_chunk_id", "corrige"))


# ── legacy star ────────────────────────────────────────────────────────────


def star_courses(courses: DataFrame, programs: DataFrame, subjects: DataFrame, exercises: DataFrame) -> DataFrame:
    """course ⋈ program ⋈ subject with the number of exercises per course."""
    counts = exercises.groupBy("course_id").agg(F.count("*").alias("exercises_count"))
    return (
        courses.join(programs, "program_id")
        .join(subjects, "subject_id")
        .join(counts, "course_id", "left")
        .withColumn("exercises_count", F.coalesce("exercises_count", F.lit(0)))
    )


def star_exercises(exercises: DataFrame, courses: DataFrame, programs: DataFrame) -> DataFrame:
    return exercises.join(courses, "course_id").join(programs, "program_id")


def page_course(
    pages: DataFrame, courses: DataFrame, exercises: DataFrame, keys: list[str], default_term: int = 1,
    default_label: str = "-",
) -> DataFrame:
    """First course by id whose closed page range holds the page, with its
    exercise count; pages outside every course get the defaults."""
    hit = range_match(
        pages, courses, keys, "page_number", "page_start", "page_end",
        ["course_id", "course_title", "term"], [F.col("course_id")],
    )
    counts = exercises.groupBy("course_id").agg(F.count("*").alias("exercises_count"))
    return hit.join(counts, "course_id", "left").select(
        *pages.columns, "course_id",
        F.coalesce("course_title", F.lit(default_label)).alias("course_title"),
        F.coalesce("term", F.lit(default_term)).alias("term"),
        F.coalesce("exercises_count", F.lit(0)).alias("exercises_count"),
    )
