"""Schemas of the corpus tables.

Every table carries ``corpus``: one corpus is one database of the source
system and the partition column of all stored tables here.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

BBOX = T.StructType([T.StructField(n, D) for n in ("x0", "y0", "x1", "y1")])

LINT_ERROR = T.StructType(
    [
        T.StructField("block_id_ref", S),
        T.StructField("error_type", S),
        T.StructField("details", S),
        T.StructField("severity", S),
    ]
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("corpus", S)] + [T.StructField(n, t) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "documents": _table(
        document_id=S, title=S, filename=S, source_path=S, total_pages=I, file_size_bytes=L,
        doc_type=S, doc_source=S, academic_level=S, domain_tags=T.ArrayType(S), metadata_json=S,
        created_at=TS,
    ),
    "toc": _table(
        toc_id=S, document_id=S, parent_id=S, level=I, title=S, page_start=I, page_end=I, ord=L,
    ),
    "chunks": _table(
        chunk_id=S, document_id=S, toc_id=S, page_number=I, chunk_index=I, section_title=S,
        content_markdown=S, pedagogical_type=S, pedagogical_index=I, has_solution=B,
        linked_solution_chunk_id=S, is_human_edited=B, updated_at=TS,
        embedding=T.ArrayType(T.FloatType()), token_count=I,
    ),
    "artifacts": _table(
        artifact_id=S, document_id=S, chunk_id=S, page_number=I, domain=S, artifact_type=S,
        raw_data=S, raw_binary=T.BinaryType(), render_config_json=S, caption=S, searchable_text=S,
        bbox=BBOX, is_human_edited=B,
    ),
    "page_scans": _table(
        document_id=S, page_number=I, width_px=I, height_px=I, dpi=I,
        image_webp=T.BinaryType(), thumb_webp=T.BinaryType(),
    ),
    "benchmarks": _table(
        document_id=S, page_number=I, engine_used=S, vlm_provider_used=S, fallback_triggered=B,
        linter_errors=T.ArrayType(LINT_ERROR), execution_time_ms=L, ram_peak_mb=D,
        confidence_score=D, blur_score=D, deskew_angle=D, created_at=TS,
    ),
    "jobs": _table(
        job_id=S, document_id=S, page_number=I, status=S, batch_id=S, retry_count=I, error_log=S,
        updated_at=TS,
    ),
    "batches": _table(
        batch_id=S, source_path=S, mode=S, page_start=I, page_end=I, status=S, pages_total=I,
        pages_done=I, created_at=TS,
    ),
    "terms": _table(term_id=S, document_id=S, term_index=I, label=S, metadata_json=S),
    "programs": _table(
        program_id=S, document_id=S, term_id=S, seq_index=I, title=S, source=S, competencies_json=S,
    ),
    "assessments": _table(
        assessment_id=S, document_id=S, term_id=S, kind=S, title=S, subject_chunk_id=S,
        correction_chunk_id=S, scale_json=S,
    ),
    "links": _table(
        link_id=S, document_id=S, link_type=S, from_id=S, to_id=S, page_number=I, metadata_json=S,
    ),
}

# The closed sets of the data model.
PEDAGOGICAL_TYPES = (
    "course_theory", "proof_demonstration", "exercise_unsolved", "exercise_solved",
    "solution_only", "evaluation_exam", "practical_work", "general_content",
)
TRANSIENT_STATUSES = (
    "PROCESSING_CV", "SEGMENTING", "EXTRACTING", "LINTING", "VLM_RECOVERY", "INDEXED",
)
JOB_STATUSES = ("QUEUED", *TRANSIENT_STATUSES, "READY", "QUARANTINE", "INVALID_SOURCE")
SEMANTICS = ("demonstration", "illustration", "exercise_support")
