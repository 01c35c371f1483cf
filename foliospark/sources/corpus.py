"""Reading source trees, registering documents, importing structured files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions.artifacts import TEXT_IMPORT_TYPES, artifact_dim
from foliospark.plans.corpus_edit import upsert
from foliospark.plans.curriculum import key_id
from foliospark.schema import TABLES

# Fixed value: folder names that state a school level.
LEVEL = r"(?i)^(\d?A[MPS]|Term|BEM|BAC|L\d|M\d|\dAM|\dAP|\dAS)$"
# Fixed value: import types with render settings of their own.
IMPORT_RENDER_TYPES = ("pdb_protein", "cif_crystal", "cad_3d_model", "bim_ifc_slice", "geojson_map", "dicom_slice")
DEFAULT_RENDER = '{"renderer": "svg", "sanitize": true, "zoomable": true}'


def path_metadata(rel_dir: Column) -> Column:
    """``struct<doc_source,domain_tags,academic_level,corpus>`` of a document's
    folder, relative to the source root ('' at the root)."""
    clean = F.regexp_replace(F.replace(rel_dir, F.lit("\\"), F.lit("/")), r"^(?:\./|\.$)|/+$", "")
    parts = F.filter(F.split(clean, "/"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.struct(
        F.array_join(parts, "/").alias("doc_source"),
        parts.alias("domain_tags"),
        F.when(last.rlike(LEVEL), last).alias("academic_level"),
        F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise("root").alias("corpus"),
    )


def _rel_dir(path: Column, base: str) -> Column:
    """Folder part of a path below ``base`` (scheme and base removed)."""
    bare = F.regexp_replace(path, r"^[a-z0-9+.-]+:/*", "/")
    inner = F.when(
        bare.startswith(base.rstrip("/") + "/"), F.substr(bare, F.lit(len(base.rstrip("/")) + 2), F.length(bare))
    ).otherwise(bare)
    return F.regexp_replace(inner, r"/?[^/]*$", "")


def list_files(spark: SparkSession, base: str, glob: str = "*.pdf") -> DataFrame:
    """Path and size of every file below ``base``; contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
    )
    return files.select("path", F.col("length").alias("file_size_bytes"), "modificationTime")


def scan_corpus(files: DataFrame, documents: DataFrame, base: str) -> DataFrame:
    """Listing with target corpus and whether a document is already ingested."""
    meta = files.withColumn("m", path_metadata(_rel_dir(F.col("path"), base)))
    known = documents.select(F.col("source_path").alias("path")).distinct().withColumn("_known", F.lit(True))
    return meta.join(known, "path", "left").select(
        "path", "file_size_bytes", "m.corpus", "m.doc_source", "m.domain_tags", "m.academic_level",
        F.coalesce("_known", F.lit(False)).alias("ingested"),
    )


def register_documents(scanned: DataFrame) -> DataFrame:
    """Rows for the paths not registered yet; running twice adds nothing."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return scanned.where(~F.col("ingested")).dropDuplicates(["path"]).select(
        "corpus", key_id("document", F.col("path")).alias("document_id"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), name.alias("filename"),
        F.col("path").alias("source_path"), "file_size_bytes", "doc_source", "domain_tags", "academic_level",
    )


def catalog(tables: dict[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """Corpora with five counts, plus size and change time where ``files``
    (corpus, size_bytes, modified) is given."""
    from foliospark.operators.aggregates import corpus_metrics

    counts = corpus_metrics(tables["documents"], tables["chunks"], tables["artifacts"], tables["jobs"])
    if files is None:
        return counts
    size = files.groupBy("corpus").agg(F.sum("size_bytes").alias("size_bytes"), F.max("modified").alias("modified"))
    return counts.join(size, "corpus", "full_outer").select(
        "corpus", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "corpus"], "size_bytes", "modified"
    )


def import_artifacts(
    spark: SparkSession, requests: DataFrame, base: str, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Artifacts from the files below ``base`` that the requests name, and the requests refused.

    The listing carries no contents (the source prunes them): paths and lengths alone decide which
    request is refused, as ``missing`` or, over ``max_bytes``, as ``too_large``.  The length bound
    reaches the second read, which skips the contents of larger files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    listed = files.select(plain.alias("path"), "length")
    met = requests.join(listed, "path", "left")
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = F.when(F.col("length").isNull(), "missing").when(large, "too_large")
    refused = met.where(reason.isNotNull()).select(*requests.columns, reason.alias("reason"))
    wanted = met.where(reason.isNull()).select("path").distinct()
    small = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    contents = small.select(plain.alias("path"), "content").join(wanted, "path", "left_semi")
    return imported(spark, requests, contents), refused


def imported(spark: SparkSession, requests: DataFrame, files: DataFrame) -> DataFrame:
    """``requests(path, document_id, chunk_id, page_number, domain,
    artifact_type, caption)`` joined to ``files(path, content)``; text types are decoded,
    all others kept as bytes."""
    dim = artifact_dim(spark).where(F.col("artifact_type").isin(*IMPORT_RENDER_TYPES))
    is_text = F.col("artifact_type").isin(*TEXT_IMPORT_TYPES)
    joined = requests.join(files, "path").join(
        F.broadcast(dim.select("artifact_type", F.col("render_config_json").alias("_rc"))), "artifact_type", "left"
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return joined.select(
        key_id("import", F.col("document_id"), F.col("path")).alias("artifact_id"),
        "document_id", "chunk_id", "page_number", "domain", "artifact_type",
        F.when(is_text, F.decode(F.col("content"), "UTF-8")).alias("raw_data"),
        F.when(~is_text, F.col("content")).alias("raw_binary"),
        F.coalesce("_rc", F.lit(DEFAULT_RENDER)).alias("render_config_json"), "caption",
        F.concat(F.coalesce("caption", "artifact_type"), F.lit(" "), name).alias("searchable_text"),
        F.lit(True).alias("is_human_edited"),
    )


CURRICULUM_KINDS = {"terms": "term_id", "programs": "program_id", "assessments": "assessment_id", "links": "link_id"}


def read_curriculum(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of one curriculum kind under its fixed schema."""
    return spark.read.schema(TABLES[kind]).json(path)


def import_curriculum(
    existing: dict[str, DataFrame], payload: dict[str, DataFrame], mode: str = "merge"
) -> dict[str, DataFrame]:
    """``merge`` inserts or replaces by id, ``replace`` drops what was there."""
    if mode not in ("merge", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    out = dict(existing)
    for kind, rows in payload.items():
        if kind not in CURRICULUM_KINDS:
            raise ValueError(f"unknown section {kind!r}")
        key = CURRICULUM_KINDS[kind]
        rows = rows.dropDuplicates([key])
        if mode == "replace" or kind not in existing:
            out[kind] = rows
        else:
            out[kind] = upsert(existing[kind], rows, [key])
    return out


def all_paths(corpora: list[DataFrame]) -> DataFrame:
    """Distinct source paths over several document tables."""
    return reduce(DataFrame.unionByName, [d.select("source_path") for d in corpora]).distinct()
