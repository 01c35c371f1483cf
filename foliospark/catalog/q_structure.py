"""Range joins, links, contents, curriculum and ordering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.catalog.tables import Tables, register
from foliospark.operators import joins as j
from foliospark.operators.ranges import range_counts
from foliospark.operators.scans import (
    moving_average, rate_limit, row_number_by, running_count, window_count_before,
)
from foliospark.plans import curriculum as cur, toc as tc
from foliospark.session import staged, tasks_for

_RANGE = "p.document_id = r.document_id AND p.page_number BETWEEN r.page_start AND coalesce(r.page_end, 1000000000)"


@register("jn_page_chapter", f"""
    WITH m AS (SELECT p.document_id, p.page_number, r.toc_id, r.title,
                      row_number() OVER (PARTITION BY p.document_id, p.page_number ORDER BY r.page_start DESC) AS k
               FROM @b_scans p JOIN @b_toc r ON {_RANGE} WHERE r.level = 1)
    SELECT p.document_id, p.page_number, m.toc_id AS chapter_id, m.title AS chapter_title
    FROM @b_scans p LEFT JOIN m ON m.document_id = p.document_id AND m.page_number = p.page_number AND k = 1""")
def jn_page_chapter(t: Tables) -> DataFrame:
    return j.page_chapter(t["b_scans"].select("document_id", "page_number"), t["b_toc"])


_LESSON = f"""
    les AS (SELECT p.chunk_id, r.toc_id AS lesson_id, r.title AS lesson_title,
                   row_number() OVER (PARTITION BY p.chunk_id ORDER BY r.page_start, r.title, r.toc_id) AS k
            FROM @b_chunks p JOIN @b_toc r ON {_RANGE} WHERE r.level = 1)"""


@register("jn_page_lesson", f"""
    WITH {_LESSON}
    SELECT p.chunk_id, l.lesson_id, l.lesson_title FROM @b_chunks p LEFT JOIN les l ON l.chunk_id = p.chunk_id AND k = 1""")
def jn_page_lesson(t: Tables) -> DataFrame:
    return j.page_lesson(t["b_chunks"], t["b_toc"]).select("chunk_id", "lesson_id", "lesson_title")


@register("jn_chunk_toc", f"""
    WITH m AS (SELECT p.chunk_id, r.toc_id, row_number() OVER (PARTITION BY p.chunk_id ORDER BY r.ord) AS k
               FROM @b_chunks p JOIN @b_toc r ON {_RANGE})
    SELECT p.chunk_id, m.toc_id FROM @b_chunks p LEFT JOIN m ON m.chunk_id = p.chunk_id AND k = 1""")
def jn_chunk_toc(t: Tables) -> DataFrame:
    return j.chunk_toc(t["b_chunks"], t["b_toc"]).select("chunk_id", "toc_id")


@register("range_all_matches", f"""
    SELECT p.chunk_id, count(r.toc_id) AS entries FROM @b_chunks p LEFT JOIN @b_toc r ON {_RANGE} GROUP BY p.chunk_id""")
def range_all_matches(t: Tables) -> DataFrame:
    """Number of entries that cover a chunk's page."""
    chunks = t["b_chunks"].select("chunk_id", "document_id", "page_number")
    toc = t["b_toc"].select("document_id", "toc_id", "page_start", "page_end")
    return range_counts(
        chunks, toc, ["document_id"], "page_number", "page_start", "page_end", "entries"
    ).select("chunk_id", "entries")


_FIRST_SOLUTION = """
    fs AS (SELECT document_id, pedagogical_index, chunk_id AS solution_id,
                  row_number() OVER (PARTITION BY document_id, pedagogical_index ORDER BY page_number, chunk_index, chunk_id) AS k
           FROM {0} WHERE pedagogical_type = 'solution_only' AND pedagogical_index IS NOT NULL)"""


def _link_sql(table: str) -> str:
    return f"""
    WITH {_FIRST_SOLUTION.format(table)}
    SELECT c.chunk_id, CASE WHEN solution_id IS NOT NULL THEN 'exercise_solved' ELSE pedagogical_type END AS pedagogical_type,
           coalesce(solution_id, linked_solution_chunk_id) AS linked_solution_chunk_id,
           CAST(solution_id IS NOT NULL OR has_solution AS INT) AS has_solution
    FROM {table} c LEFT JOIN fs ON fs.document_id = c.document_id AND fs.pedagogical_index = c.pedagogical_index AND k = 1
         AND c.pedagogical_type = 'exercise_unsolved' AND c.linked_solution_chunk_id IS NULL"""


def _linked(df: DataFrame) -> DataFrame:
    return j.link_solutions(df).select(
        "chunk_id", "pedagogical_type", "linked_solution_chunk_id", F.col("has_solution").cast("int").alias("has_solution")
    )


@register("jn_solution_link", _link_sql("@b_chunks"))
def jn_solution_link(t: Tables) -> DataFrame:
    return _linked(t["b_chunks"])


@register("job_link_solutions", _link_sql("@v_chunks"))
def job_link_solutions(t: Tables) -> DataFrame:
    return _linked(t["v_chunks"])


@register("solution_ambiguous", """
    SELECT document_id, pedagogical_index, count(*) AS n_solutions FROM @b_chunks
    WHERE pedagogical_type = 'solution_only' AND pedagogical_index IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def solution_ambiguous(t: Tables) -> DataFrame:
    return j.ambiguous_solutions(t["b_chunks"])


def _exercises(t: Tables) -> DataFrame:
    ids = t["b_chunks"].where("pedagogical_type in ('exercise_unsolved', 'exercise_solved')")
    return ids.withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn(
        "linked_solution_chunk_id", F.col("linked_solution_chunk_id").cast("string")
    )


def _solutions(t: Tables) -> DataFrame:
    return t["b_chunks"].where("pedagogical_type = 'solution_only'").withColumn(
        "chunk_id", F.col("chunk_id").cast("string")
    )


_EXO = """
    exo AS (SELECT CAST(chunk_id AS STRING) AS chunk_id, document_id, pedagogical_index,
                   CAST(linked_solution_chunk_id AS STRING) AS linked FROM @b_chunks
            WHERE pedagogical_type IN ('exercise_unsolved', 'exercise_solved')),
    sol AS (SELECT CAST(chunk_id AS STRING) AS chunk_id, document_id, pedagogical_index, page_number, chunk_index
            FROM @b_chunks WHERE pedagogical_type = 'solution_only'),
    ed AS (SELECT from_id AS a, to_id AS b, link_id FROM @b_edges
           UNION ALL SELECT to_id, from_id, link_id FROM @b_edges)"""


@register("jn_solution_resolve", f"""
    WITH {_EXO},
    e AS (SELECT a, min_by(b, link_id) AS edge_id FROM ed JOIN sol ON sol.chunk_id = b GROUP BY a),
    i AS (SELECT pedagogical_index, chunk_id AS index_id FROM sol WHERE pedagogical_index IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY pedagogical_index
                  ORDER BY document_id DESC, page_number DESC, chunk_index DESC, chunk_id DESC) = 1),
    d AS (SELECT document_id, chunk_id AS doc_id FROM sol
          QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index, chunk_id) = 1)
    SELECT exo.chunk_id, coalesce(s.chunk_id, edge_id, index_id, d.doc_id) AS solution_id,
           CASE WHEN s.chunk_id IS NOT NULL THEN 'direct' WHEN edge_id IS NOT NULL THEN 'edge'
                WHEN index_id IS NOT NULL THEN 'index' WHEN d.doc_id IS NOT NULL THEN 'document' END AS link_source
    FROM exo LEFT JOIN sol s ON s.chunk_id = linked LEFT JOIN e ON e.a = exo.chunk_id
    LEFT JOIN i ON i.pedagogical_index = exo.pedagogical_index LEFT JOIN d ON d.document_id = exo.document_id""")
def jn_solution_resolve(t: Tables) -> DataFrame:
    return j.resolve_solutions(_exercises(t), _solutions(t), t["b_edges"])


@register("jn_solution_inverse", f"""
    WITH {_EXO},
    c AS (SELECT linked AS solution_id, chunk_id AS exercise_id, 0 AS r, chunk_id AS o FROM exo WHERE linked IS NOT NULL
          UNION ALL SELECT to_id, from_id, 1, link_id FROM @b_edges WHERE from_id IN (SELECT chunk_id FROM exo)
          UNION ALL SELECT from_id, to_id, 1, link_id FROM @b_edges WHERE to_id IN (SELECT chunk_id FROM exo)
                    AND from_id NOT IN (SELECT chunk_id FROM exo))
    SELECT solution_id, exercise_id FROM c QUALIFY row_number() OVER (PARTITION BY solution_id ORDER BY r, o) = 1""")
def jn_solution_inverse(t: Tables) -> DataFrame:
    return j.solution_to_exercise(_exercises(t), t["b_edges"])


@register("jn_exercise_term", """
    WITH ct AS (SELECT c.from_id AS course_id, p.term_id FROM @b_links c JOIN @b_programs p ON p.program_id = c.to_id
                WHERE link_type = 'course_program')
    SELECT x.exercise_id AS chunk_id, t.term_index FROM @b_exercises x
    LEFT JOIN @b_links l ON l.link_type = 'course_exercise' AND l.to_id = x.exercise_id
    LEFT JOIN ct ON ct.course_id = l.from_id LEFT JOIN @b_terms t ON t.term_id = ct.term_id""")
def jn_exercise_term(t: Tables) -> DataFrame:
    exercises = t["b_exercises"].withColumnRenamed("exercise_id", "chunk_id")
    return j.exercise_terms(exercises, t["b_links"], t["b_programs"], t["b_terms"])


_COURSE = f"""
    {_LESSON},
    pl AS (SELECT p.*, l.lesson_id FROM @b_chunks p JOIN les l ON l.chunk_id = p.chunk_id AND k = 1),
    crs AS (SELECT * FROM pl WHERE pedagogical_type IN ('course_theory', 'proof_demonstration')),
    rep AS (SELECT lesson_id, chunk_id AS course_id FROM crs
            QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY page_number, chunk_index, chunk_id) = 1),
    xe AS (SELECT rep.course_id, pl.chunk_id, pl.document_id, pl.page_number, pl.lesson_id FROM pl JOIN rep USING (lesson_id)
           WHERE pedagogical_type IN ('exercise_unsolved', 'exercise_solved'))"""


@register("jn_course_program", f"""
    WITH {_COURSE}
    SELECT CAST(chunk_id AS STRING) AS from_id, sha256('program:' || CAST(lesson_id AS STRING)) AS to_id, page_number FROM crs""")
def jn_course_program(t: Tables) -> DataFrame:
    return cur.course_program_edges(cur.lesson_chunks(t["b_toc"], t["b_chunks"])).select("from_id", "to_id", "page_number")


@register("jn_course_exercise", f"""
    WITH {_COURSE}
    SELECT CAST(course_id AS STRING) AS from_id, CAST(chunk_id AS STRING) AS to_id, page_number FROM xe""")
def jn_course_exercise(t: Tables) -> DataFrame:
    return cur.course_exercise_edges(cur.lesson_chunks(t["b_toc"], t["b_chunks"])).select("from_id", "to_id", "page_number")


@register("job_build_curriculum", f"""
    WITH {_COURSE},
    k AS (SELECT document_id, 'lessons' AS kind FROM @b_toc WHERE level = 1
          UNION ALL SELECT document_id, 'exercises' FROM xe
          UNION ALL SELECT document_id, 'solutions' FROM @b_chunks WHERE pedagogical_type = 'solution_only'
          UNION ALL SELECT document_id, 'assessments' FROM @b_chunks WHERE pedagogical_type = 'evaluation_exam'
          UNION ALL SELECT document_id, 'assessments' FROM @b_documents WHERE lower(doc_type) IN ('sujet', 'examen'))
    SELECT document_id, count(*) FILTER (WHERE kind = 'lessons') AS lessons,
           count(*) FILTER (WHERE kind = 'exercises') AS exercises, count(*) FILTER (WHERE kind = 'solutions') AS solutions,
           count(*) FILTER (WHERE kind = 'assessments') AS assessments FROM k GROUP BY document_id""")
def job_build_curriculum(t: Tables) -> DataFrame:
    built = cur.build_curriculum(t["b_toc"], t["b_chunks"], t["b_documents"])
    return cur.curriculum_counts(built, t["b_chunks"])


@register("curriculum_links", f"""
    WITH {_COURSE}
    SELECT document_id, 'program_term' AS link_type, count(*) AS n FROM @b_toc WHERE level = 1 GROUP BY document_id
    UNION ALL SELECT document_id, 'course_program', count(*) FROM crs GROUP BY document_id
    UNION ALL SELECT document_id, 'course_exercise', count(*) FROM xe GROUP BY document_id""")
def curriculum_links(t: Tables) -> DataFrame:
    built = cur.build_curriculum(t["b_toc"], t["b_chunks"], t["b_documents"])
    return built["links"].groupBy("document_id", "link_type").agg(F.count("*").alias("n"))


@register("jn_semi_term_exercises", """
    SELECT p.term_id, e.from_id AS course_id, e.to_id AS exercise_id FROM @b_links e
    JOIN @b_links c ON c.link_type = 'course_program' AND c.from_id = e.from_id
    JOIN @b_programs p ON p.program_id = c.to_id WHERE e.link_type = 'course_exercise'""")
def jn_semi_term_exercises(t: Tables) -> DataFrame:
    return j.term_exercises(t["b_links"], t["b_programs"])


@register("jn_anti_open_batches", """
    SELECT batch_id FROM @v_batches b WHERE NOT EXISTS (SELECT 1 FROM @v_jobs jb WHERE jb.batch_id = b.batch_id
           AND status NOT IN ('READY', 'QUARANTINE', 'INVALID_SOURCE'))""")
def jn_anti_open_batches(t: Tables) -> DataFrame:
    return j.finished_batches(t["v_batches"], t["v_jobs"])


@register("jn_artifact_scan", """
    SELECT artifact_id, s.width_px, s.height_px FROM @b_artifacts a
    LEFT JOIN @b_scans s ON s.document_id = a.document_id AND s.page_number = a.page_number""")
def jn_artifact_scan(t: Tables) -> DataFrame:
    return j.with_page_dims(t["b_artifacts"], t["b_scans"]).select("artifact_id", "width_px", "height_px")


_PARENTS = """
    w AS (SELECT *, last_value(CASE WHEN level = 1 THEN toc_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l1 FROM @b_toc),
    pt AS (SELECT document_id, toc_id, level, title, page_start, CASE WHEN level = 2 THEN l1 END AS parent_id FROM w)"""


@register("win_toc_parent", f"WITH {_PARENTS} SELECT toc_id, parent_id FROM pt")
def win_toc_parent(t: Tables) -> DataFrame:
    return tc.toc_parents(t["b_toc"]).select("toc_id", "parent_id")


@register("jn_toc_tree", f"""
    WITH {_PARENTS}
    SELECT a.document_id, a.toc_id, p.toc_id AS parent_id, a.level, a.page_start,
           CASE WHEN p.toc_id IS NULL THEN 1 WHEN g.toc_id IS NULL THEN 2 ELSE 3 END AS depth,
           concat_ws(' / ', g.title, p.title, a.title) AS path
    FROM pt a LEFT JOIN pt p ON p.toc_id = a.parent_id LEFT JOIN pt g ON g.toc_id = p.parent_id""")
def jn_toc_tree(t: Tables) -> DataFrame:
    return j.toc_tree(tc.toc_parents(t["b_toc"]))


@register("jn_asset_resolve", """
    SELECT c.chunk_id, CAST(0 AS INT) AS pos, CAST(c.chunk_id AS STRING) AS artifact_ref, a.artifact_type,
           CASE WHEN coalesce(a.raw_data, '') <> '' THEN 'structured' WHEN a.has_binary THEN 'original'
                WHEN a.artifact_type IS NULL THEN 'unknown' ELSE 'empty' END AS shown_as
    FROM @b_chunks c LEFT JOIN @b_artifacts a ON a.artifact_id = c.chunk_id
    UNION ALL SELECT c.chunk_id, 1, 'missing', NULL, 'unknown' FROM @b_chunks c""")
def jn_asset_resolve(t: Tables) -> DataFrame:
    text = F.expr("'see ![f](asset://artifacts/' || chunk_id || ') and ![](asset://artifacts/missing)'")
    return j.resolve_assets(t["b_chunks"].withColumn("content_markdown", text), t["b_artifacts"])


@register("jn_assessment_media", """
    SELECT assessment_id, term_id, 'sujet' AS role, artifact_id, artifact_type FROM @b_assessments s
    JOIN @b_artifacts a ON a.chunk_id = s.subject_chunk_id
    UNION ALL SELECT assessment_id, term_id, 'corrige', artifact_id, artifact_type FROM @b_assessments s
    JOIN @b_artifacts a ON a.chunk_id = s.correction_chunk_id""")
def jn_assessment_media(t: Tables) -> DataFrame:
    return j.assessment_media(t["b_assessments"], t["b_artifacts"])


_STAR = """
    pr AS (SELECT program_id, term_id AS subject_id, title AS program_title FROM @b_programs),
    co AS (SELECT course_id, program_id, course_title, term, page_start, page_end FROM @b_courses)"""


def _star(t: Tables) -> tuple[DataFrame, DataFrame]:
    programs = t["b_programs"].select("program_id", F.col("term_id").alias("subject_id"), F.col("title").alias("program_title"))
    courses = t["b_courses"].select("course_id", "program_id", "course_title", "term", "page_start", "page_end")
    return courses, programs


@register("jn_star_courses", f"""
    WITH {_STAR}, n AS (SELECT course_id, count(*) AS c FROM @b_exercises GROUP BY course_id)
    SELECT co.*, subject_id, program_title, subject_name, coalesce(c, 0) AS exercises_count
    FROM co JOIN pr USING (program_id) JOIN @b_subjects USING (subject_id) LEFT JOIN n USING (course_id)""")
def jn_star_courses(t: Tables) -> DataFrame:
    return j.star_courses(*_star(t), t["b_subjects"], t["b_exercises"])


@register("jn_star_exercises", f"""
    WITH {_STAR} SELECT exercise_id, state, co.*, subject_id, program_title
    FROM @b_exercises JOIN co USING (course_id) JOIN pr USING (program_id)""")
def jn_star_exercises(t: Tables) -> DataFrame:
    return j.star_exercises(t["b_exercises"], *_star(t))


@register("jn_page_course_legacy", """
    WITH pg AS (SELECT DISTINCT document_id % 50 AS book_id, page_number FROM @b_scans),
    m AS (SELECT pg.book_id, pg.page_number, c.course_id, c.course_title, c.term,
                 row_number() OVER (PARTITION BY pg.book_id, pg.page_number ORDER BY c.course_id) AS k
          FROM pg JOIN @b_courses c ON c.book_id = pg.book_id AND pg.page_number BETWEEN c.page_start AND c.page_end),
    n AS (SELECT course_id, count(*) AS c FROM @b_exercises GROUP BY course_id)
    SELECT pg.book_id, pg.page_number, m.course_id, coalesce(course_title, '-') AS course_title, coalesce(term, 1) AS term,
           coalesce(c, 0) AS exercises_count
    FROM pg LEFT JOIN m ON m.book_id = pg.book_id AND m.page_number = pg.page_number AND k = 1
    LEFT JOIN n ON n.course_id = m.course_id""")
def jn_page_course_legacy(t: Tables) -> DataFrame:
    pages = t["b_scans"].select((F.col("document_id") % 50).alias("book_id"), "page_number").distinct()
    return j.page_course(pages, t["b_courses"], t["b_exercises"], ["book_id"])


# ── window-shaped logic ────────────────────────────────────────────────────


@register("win_toc_page_end", """
    WITH n AS (SELECT a.toc_id, min(b.page_start) AS nxt FROM @b_toc a JOIN @b_toc b
               ON b.document_id = a.document_id AND b.level <= a.level AND b.page_start > a.page_start GROUP BY a.toc_id)
    SELECT toc_id, CAST(greatest(page_start, least(coalesce(nxt - 1, total_pages, page_start), coalesce(total_pages, page_start)))
           AS INT) AS page_end
    FROM @b_toc t LEFT JOIN n USING (toc_id) LEFT JOIN @b_documents d ON d.document_id = t.document_id""")
def win_toc_page_end(t: Tables) -> DataFrame:
    entries = staged(t["b_toc"].drop("page_end"), "entries")
    return tc.toc_page_ends(entries, t["b_documents"], tasks_for(t.spark, entries.count())).select("toc_id", "page_end")


@register("win_toc_page_end_native", """
    WITH n AS (SELECT a.toc_id, arg_min(b.page_start, b.ord) AS nxt FROM @b_toc a JOIN @b_toc b
               ON b.document_id = a.document_id AND b.level <= a.level AND b.ord > a.ord AND b.page_start > a.page_start
               GROUP BY a.toc_id)
    SELECT toc_id, CAST(greatest(page_start, least(coalesce(nxt - 1, total_pages, page_start), coalesce(total_pages, page_start)))
           AS INT) AS page_end
    FROM @b_toc t LEFT JOIN n USING (toc_id) LEFT JOIN @b_documents d ON d.document_id = t.document_id""")
def win_toc_page_end_native(t: Tables) -> DataFrame:
    return tc.native_page_ends(t["b_toc"].drop("page_end"), t["b_documents"]).select("toc_id", "page_end")


_RELIABLE = """
    nx AS (SELECT a.toc_id, min(b.page_start) AS nxt FROM @b_toc a JOIN @b_toc b
           ON b.document_id = a.document_id AND b.level <= a.level AND b.page_start > a.page_start GROUP BY a.toc_id),
    mx AS (SELECT document_id, max(page_start) AS m FROM @b_toc GROUP BY document_id),
    rl AS (SELECT t.document_id, toc_id, level, title, page_start,
                  CAST(CASE WHEN page_end BETWEEN page_start AND least(coalesce(nxt - 1, m), m) THEN page_end
                            ELSE greatest(page_start, least(coalesce(nxt - 1, m), m)) END AS INT) AS page_end
           FROM @b_toc t LEFT JOIN nx USING (toc_id) JOIN mx USING (document_id))"""


@register("win_toc_reliable_end", f"WITH {_RELIABLE} SELECT toc_id, page_end FROM rl")
def win_toc_reliable_end(t: Tables) -> DataFrame:
    return tc.reliable_page_ends(t["b_toc"]).select("toc_id", "page_end")


_HEADINGS = """
    SELECT o_custkey AS document_id, CAST(o_orderkey AS INT) AS page_number, 0 AS chunk_index,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS level, o_orderpriority AS title FROM @orders"""


@register("win_toc_dedup", f"""
    WITH h AS ({_HEADINGS}),
    a AS (SELECT *, level = 1 AND title IS DISTINCT FROM lag(title) OVER (PARTITION BY document_id, level ORDER BY page_number)
                 AS new1 FROM h),
    s AS (SELECT *, sum(CASE WHEN new1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_number) AS part FROM a),
    b AS (SELECT *, level = 2 AND title IS DISTINCT FROM lag(title) OVER (PARTITION BY document_id, part, level
                 ORDER BY page_number) AS new2 FROM s)
    SELECT document_id, page_number, level, title FROM b WHERE new1 OR new2""")
def win_toc_dedup(t: Tables) -> DataFrame:
    """One heading per chunk, so the memory has a window form in SQL."""
    rows = t["orders"].select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").cast("int").alias("page_number"),
        F.lit(0).alias("chunk_index"),
        F.array(F.struct(
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("level"), F.col("o_orderpriority").alias("title")
        )).alias("hs"),
    )
    return tc.toc_entries(rows).drop("chunk_index")


@register("job_build_toc", """
    WITH e AS (SELECT document_id, page_number, trim(regexp_replace(trim(section_title), '\\s+', ' ', 'g'), '*# ')
               AS title, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS ord
               FROM @v_chunks WHERE section_title IS NOT NULL AND length(section_title) >= 3),
    n AS (SELECT *, lead(page_number) OVER (PARTITION BY document_id ORDER BY page_number) AS nxt FROM e),
    d AS (SELECT document_id, max(page_number) AS total_pages FROM @v_chunks GROUP BY document_id)
    SELECT document_id, ord, 1 AS level, title, page_number AS page_start, CAST(coalesce(nxt - 1, total_pages) AS INT) AS page_end
    FROM n JOIN d USING (document_id)""")
def job_build_toc(t: Tables) -> DataFrame:
    totals = t["v_chunks"].groupBy("document_id").agg(F.max("page_number").alias("total_pages"))
    toc, _ = tc.build_toc(t["v_chunks"], totals)
    return toc.select("document_id", "ord", "level", "title", "page_start", "page_end")


@register("win_seq_index", """
    SELECT toc_id, row_number() OVER (PARTITION BY document_id ORDER BY page_start, title, toc_id) AS seq_index
    FROM @b_toc WHERE level = 1""")
def win_seq_index(t: Tables) -> DataFrame:
    return cur.sequence_lessons(t["b_toc"]).select("toc_id", "seq_index")


@register("win_lesson_number", f"""
    WITH {_RELIABLE},
    ch AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_start) AS k FROM rl WHERE level = 1)
    SELECT document_id, CAST(toc_id AS STRING) AS unit_id, title, page_start, page_end,
           CASE WHEN title = 'AF' THEN toc_id % 10 ELSE k END AS lesson_number FROM ch
    UNION ALL
    SELECT document_id, 'doc_' || CAST(document_id AS STRING), title, 1, 60, 1 FROM @b_documents d
    WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.document_id = d.document_id)""")
def win_lesson_number(t: Tables) -> DataFrame:
    indexes = t["b_toc"].where("level = 1 and title = 'AF'").select("toc_id", (F.col("toc_id") % 10).alias("lesson_index"))
    units = tc.course_units(t["b_toc"], t["b_links"], t["b_documents"], indexes)
    return units.select("document_id", "unit_id", "title", "page_start", "page_end", "lesson_number")


@register("win_reading_order", """
    SELECT artifact_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, y0, x0, artifact_id) AS position
    FROM @b_artifacts""")
def win_reading_order(t: Tables) -> DataFrame:
    art = t["b_artifacts"].select("artifact_id", "document_id", "page_number", "y0", "x0")
    ranked = row_number_by(
        art, ["document_id"], [F.col(c) for c in ("page_number", "y0", "x0", "artifact_id")],
        F.floor(F.col("page_number") / 8), "position",
    )
    return ranked.select("artifact_id", "position")


@register("win_moving_latency", """
    SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS moving_avg
    FROM @events""")
def win_moving_latency(t: Tables) -> DataFrame:
    events = t["events"].select("event_id", "ts", "value")
    return moving_average(events, "value", ["ts", "event_id"]).select(
        "event_id", F.round("moving_avg", 4).alias("moving_avg")
    )


@register("win_rate_limit", """
    SELECT request_id, count(*) OVER (PARTITION BY key ORDER BY micros
           RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS before_n FROM @v_requests""")
def win_rate_limit(t: Tables) -> DataFrame:
    return window_count_before(t["v_requests"], "key", "micros", 3600, "before_n").select("request_id", "before_n")


@register("rate_limit_batch", """
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY micros, request_id) AS k FROM @v_requests),
    f AS (SELECT key, k, micros, request_id, [micros] AS acc, TRUE AS allowed FROM o WHERE k = 1
          UNION ALL
          SELECT o.key, o.k, o.micros, o.request_id,
                 CASE WHEN len(list_filter(f.acc, lambda x: o.micros - x <= 3600000000)) < 2
                      THEN list_append(list_filter(f.acc, lambda x: o.micros - x <= 3600000000), o.micros)
                      ELSE list_filter(f.acc, lambda x: o.micros - x <= 3600000000) END,
                 len(list_filter(f.acc, lambda x: o.micros - x <= 3600000000)) < 2
          FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
    SELECT request_id, CAST(allowed AS INT) AS allowed FROM f""")
def rate_limit_batch(t: Tables) -> DataFrame:
    return rate_limit(t["v_requests"], 2, 3600).select("request_id", F.col("allowed").cast("int").alias("allowed"))


@register("running_exercise_index", """
    SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS idx
    FROM @conversations""")
def running_exercise_index(t: Tables) -> DataFrame:
    """Running number of user turns, scanned in blocks of turns."""
    return running_count(
        t["conversations"].select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.floor(F.col("turn") / 4),
        F.col("role") == "user", "idx",
    ).drop("role")
