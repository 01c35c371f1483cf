"""BM25, nearest neighbours and rank fusion over one or many corpora.

Two BM25 paths give the same scores:

* ``scan_bm25`` reads the rows once and counts only the query's terms in each
  text.  Nothing but top-k rows is shuffled.
* ``build_index`` makes postings with positions, row lengths and corpus statistics,
  written once; ``index_bm25`` then reads the postings of the query's terms only.

Searches take either: rows are scanned, an ``Index`` is looked up.

``query_id`` and ``corpus`` are partition keys throughout, so many corpora and
many queries share one plan.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.functions.text import (
    context_block,
    line_length,
    phrase_count,
    query_phrases,
    token_line,
    tokens,
)
from foliospark.operators.joins import hydrate
from foliospark.operators.topk import top_k
from foliospark.session import checkpointed, staged, tasks_for

# Ranking constants and default thresholds.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
CHANNEL_TOP = 20
TOP_K = 5
BM25_THRESHOLD = -0.3
VEC_THRESHOLD = 0.45
INDEXED = ["title", "section_title", "pedagogical_type", "search_content"]
# Words counted at a time by a Python worker; a longer row is counted alone.
SLICE = 1 << 18


def _idf(n_rows: Column, n_hits: Column) -> Column:
    raw = F.log((n_rows - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


# ── BM25 by scan ───────────────────────────────────────────────────────────


def scan_counts(
    rows: DataFrame, phrases: list[list[str]], columns: list[str] = INDEXED, arabic_fold: bool = True
) -> DataFrame:
    """Rows with their token count ``dl`` and one frequency ``tf<i>`` per phrase."""
    # The lines are columns of their own, read many times but made once.
    names = [f"_line{i}" for i in range(len(columns))]
    kept = [c for c in rows.columns if c not in columns]
    lines = rows.select(*kept, *[token_line(F.col(c), arabic_fold).alias(n) for c, n in zip(columns, names)])
    total = lambda count: reduce(lambda a, b: a + b, [count(F.col(n)) for n in names])
    return lines.select(
        *kept,
        total(line_length).alias("dl"),
        *[total(lambda line, p=p: phrase_count(line, p)).alias(f"tf{i}") for i, p in enumerate(phrases)],
    )


def _scored(counted: DataFrame, stats: DataFrame, count: int) -> DataFrame:
    """Score rows (``dl``, ``tf<i>``) with their corpus statistics (``n_rows``, ``avg_dl``, ``n<i>``)."""
    every = range(count)
    hits = counted.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in every]))
    parts = [
        _idf(F.col("n_rows"), F.col(f"n{i}")) * _weight(F.col(f"tf{i}"), F.col("dl"), F.col("avg_dl")) for i in every
    ]
    scored = hits.join(stats, "corpus").withColumn("score", -reduce(lambda a, b: a + b, parts))
    return scored.drop("dl", "n_rows", "avg_dl", *[c for i in every for c in (f"tf{i}", f"n{i}")])


def _matching(count: int) -> list[Column]:
    return [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(count)]


def scan_bm25(
    rows: DataFrame, query: str, columns: list[str] = INDEXED, arabic_fold: bool = True
) -> DataFrame:
    """Scored matching rows (negative, smaller is better), statistics per corpus."""
    phrases = query_phrases(query, arabic_fold)
    if not phrases:
        return rows.drop(*columns).where("false").withColumn("score", F.lit(0.0))
    # Text is scanned once: the few numbers per row go to the shared folder,
    # and both the statistics and the scores read them from there.
    counted = checkpointed(scan_counts(rows, phrases, columns, arabic_fold))
    stats = counted.groupBy("corpus").agg(
        F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl"), *_matching(len(phrases)))
    return _scored(counted, stats, len(phrases))


# ── BM25 by stored index ───────────────────────────────────────────────────


@dataclass
class Index:
    """Postings, row lengths and corpus statistics."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    # Rows with their words, and those of a sample, where the index is made from these.
    cut: DataFrame | None = None
    sample: DataFrame | None = None

    def write(self, path: str) -> None:
        """Postings lie sorted by term inside each corpus, so a query skips
        all row groups but those of its terms.  Texts are cut once, for postings and lengths together; a sample of
        the texts, cut before, tells the ranges of terms.  Where it is too small for that, the ranges are sampled from what was cut."""
        spark = self.postings.sparkSession
        if self.cut is None or self.sample is None:
            told = _both(self.postings, self.lengths)
            ranges, tasks = [], 0
        else:
            ranges, tasks = _ranges(self.sample)
            told = self.cut.mapInArrow(_tell(ranges), f"{_kinds(self.cut)}, {TOLD}")
        if ranges:
            dealt = told.repartitionById(tasks, F.col("range"))
        else:
            dealt = staged(told, "postings").repartitionByRange("kind", "corpus", "term", "row_id")
        (
            dealt.drop("range").sortWithinPartitions("kind", "corpus", "term")
            .write.mode("overwrite").partitionBy("kind", "corpus").parquet(f"{path}/rows")
        )
        self.read_rows(spark, path)[1].transform(corpus_stats).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of a stored index."""
        of = lambda kind: spark.read.parquet(f"{path}/rows/kind={kind}")
        return of("postings"), of("lengths").drop("term", "tf", "positions")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Index":
        return Index(*Index.read_rows(spark, path), spark.read.parquet(f"{path}/stats"))


def read_corpora(spark: SparkSession, paths: dict[str, str]) -> tuple[Index | None, dict[str, str]]:
    """One index over the stored ones that can be read, and why each other corpus is left out."""
    found, failed = [], {}
    for corpus, path in paths.items():
        try:
            found.append(Index.read(spark, path))
        except AnalysisException as error:
            failed[corpus] = str(error).splitlines()[0]
    if not found:
        return None, failed
    both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return Index(*[reduce(both, [getattr(ix, n) for ix in found]) for n in ("postings", "lengths", "stats")]), failed


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("corpus").agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE`` words together, or a single row, so that memory does not grow with the batch."""
    ends, at = batch.column("w").offsets.to_numpy(), 0
    while at < batch.num_rows:
        after = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield batch.slice(at, after - at)
        at = after


def _counted(batch: pa.RecordBatch) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Postings of each row, the rows they are of and the lengths of all rows; an empty word parts two columns and
    takes a position of its own."""
    words = batch.column("w")
    starts = words.offsets.to_numpy().astype(np.int64)
    at = np.repeat(np.arange(batch.num_rows), np.diff(starts))
    place = np.arange(len(at)) - (starts[:-1] - starts[0])[at]
    flat = pa.table({"at": at, "term": pc.list_flatten(words), "position": place.astype(np.int32)})
    flat = flat.filter(pc.not_equal(flat["term"], ""))
    lengths = np.bincount(flat["at"].to_numpy(), minlength=batch.num_rows).astype(np.int32)
    counted = flat.group_by(["at", "term"], use_threads=False).aggregate([([], "count_all"), ("position", "list")])
    at = counted["at"]
    kept = [n for n in batch.schema.names if n != "w"]
    return pa.table({
        **{n: pc.take(batch.column(n), at) for n in kept},
        "dl": pc.take(pa.array(lengths), at),
        "term": counted["term"],
        "tf": counted["count_all"].cast(pa.int32()),
        "positions": counted["position_list"],
    }), at.to_numpy(), lengths


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _slices(whole)):
        yield from _counted(batch)[0].to_batches()


POSTING = "dl int, term string, tf int, positions array<int>"
TOLD = f"{POSTING}, kind string, range int"
# One text in so many tells the ranges of terms; of its postings the driver sees at most so many.
SAMPLE, SEEN = 64, 1 << 14


def _kinds(cut: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "w")


def _both(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """Postings and lengths as rows of one table."""
    kind = lambda df, name: df.withColumns({"kind": F.lit(name), "range": F.lit(0)})
    return kind(postings, "postings").unionByName(kind(lengths, "lengths"), allowMissingColumns=True)


def _ranges(sampled: DataFrame) -> tuple[list[tuple[str, str]], int]:
    """The (corpus, term) at which each range after the first begins, and the number of ranges; a term that fills several
    ranges is named several times.  Nothing where the sample is too small."""
    spark = sampled.sparkSession
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("corpus", "term")]
    sample = staged(sampled.mapInArrow(_count_terms, f"{_kinds(sampled)}, {POSTING}").select(*keys), "sample")
    rows = sample.count()
    # Two tasks' worth of rows, as they are narrow.
    tasks = tasks_for(spark, rows * SAMPLE // 2)
    if rows < 16 * tasks:
        return [], 0
    seen = sample if rows <= SEEN else sample.orderBy(F.rand(7)).limit(SEEN)
    found = sorted(map(tuple, seen.collect()))
    return [found[len(found) * n // tasks] for n in range(1, tasks)], tasks


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Places of the values among the different ones in order, and these."""
    coded = column.combine_chunks().dictionary_encode("encode")
    order = pc.sort_indices(coded.dictionary)
    ranks = np.empty(len(order), np.int64)
    ranks[order.to_numpy()] = np.arange(len(order))
    return ranks[coded.indices.to_numpy()], coded.dictionary.take(order).to_pylist()


def _tell(ranges: list[tuple[str, str]]):
    """Postings, and a row without term for the length of each text, with the range that each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in (part for whole in batches for part in _slices(whole)):
            postings, at, lengths = _counted(batch)
            if postings.num_rows:
                (corpus, names), (term, terms) = (_ranked(postings[c]) for c in ("corpus", "term"))
                code = corpus * len(terms) + term
                # Sorted runs, which the sort of a range only has to merge.
                order = np.argsort(code, kind="stable")
                pairs, place = np.unique(code[order], return_inverse=True)
                keys = [("" if names[n // len(terms)] is None else str(names[n // len(terms)]), terms[n % len(terms)]) for n in pairs.tolist()]
                first = np.array([bisect_left(ranges, k) for k in keys])
                span = np.array([bisect_right(ranges, k) for k in keys]) - first + 1
                placed = (first[place] + (row + at[order]) % span[place]).astype(np.int32)
                kind = pa.array(["postings"] * len(at), pa.string())
                yield from postings.take(pa.array(order)).append_column("kind", kind).append_column("range", pa.array(placed)).to_batches()
            own = {n: batch.column(n) for n in batch.schema.names if n != "w"}
            spread = (row + np.arange(batch.num_rows)) % (len(ranges) + 1)
            none = lambda kind: pa.nulls(batch.num_rows, kind)
            yield pa.RecordBatch.from_pydict({
                **own, "dl": pa.array(lengths), "term": none(pa.string()), "tf": none(pa.int32()), "positions": none(pa.list_(pa.int32())),
                "kind": pa.array(["lengths"] * batch.num_rows, pa.string()), "range": pa.array(spread.astype(np.int32))})
            row += batch.num_rows

    return run


def build_index(
    rows: DataFrame, columns: list[str] = INDEXED, keep: tuple[str, ...] = ("chunk_id",), arabic_fold: bool = True
) -> Index:
    """Terms are counted inside their own row, on Arrow batches, so building
    needs no shuffle however many postings there are."""
    gap = F.array(F.lit(""))
    parts = [tokens(F.coalesce(F.col(c), F.lit("")), arabic_fold) for c in columns]
    words = F.concat(*[x for part in parts for x in (gap, part)][1:])
    names = ["corpus", "row_id", *keep]
    # The sample is drawn before the texts are cut.
    cut, sample = (df.select(*names, words.alias("w")) for df in (rows, rows.sample(1 / SAMPLE, 7)))
    postings = cut.mapInArrow(_count_terms, f"{_kinds(cut)}, {POSTING}")
    lengths = cut.select(*names, (F.size("w") - len(columns) + 1).alias("dl"))
    return Index(postings, lengths, corpus_stats(lengths), cut, sample)


def index_counts(index: Index, phrases: list[list[str]], corpora: list[str] | None = None) -> DataFrame:
    """Matching rows with ``dl`` and one frequency ``tf<i>`` per phrase, from the postings of its words.

    The words, and the corpora when named, are literals that reach the scan.  Words of a phrase
    meet by their positions.
    """
    words = sorted({w for phrase in phrases for w in phrase})
    hits = index.postings.where(F.col("term").isin(words))
    if corpora is not None:
        hits = hits.where(F.col("corpus").isin(corpora))
    keys = [c for c in index.postings.columns if c not in ("term", "tf", "positions")]
    of = lambda c, w: F.max(F.when(F.col("term") == w, F.col(c)))
    single = {p[0] for p in phrases if len(p) == 1}
    joint = sorted({w for p in phrases if len(p) > 1 for w in p})
    met = hits.groupBy(*keys).agg(
        *[of("tf", w).alias(f"_tf{i}") for i, w in enumerate(words) if w in single],
        *[of("positions", w).alias(f"_at{i}") for i, w in enumerate(words) if w in joint])

    def together(phrase: list[str]) -> Column:
        first, *rest = [F.col(f"_at{words.index(w)}") for w in phrase]
        return F.size(F.filter(first, lambda p: reduce(
            lambda a, b: a & b, [F.coalesce(F.array_contains(at, p + n), F.lit(False)) for n, at in enumerate(rest, 1)])))

    frequency = lambda p: F.col(f"_tf{words.index(p[0])}") if len(p) == 1 else together(p)
    # The size of no list at all is -1 or null.
    return met.select(*keys, *[
        F.greatest(F.coalesce(frequency(p), F.lit(0)), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)])


def index_bm25(index: Index, query: str, arabic_fold: bool = True, corpora: list[str] | None = None) -> DataFrame:
    """Scored matching rows as from :func:`scan_bm25`, read from the stored index."""
    phrases = query_phrases(query, arabic_fold)
    if not phrases:
        return index.lengths.where("false").drop("dl").withColumn("score", F.lit(0.0))
    counted = index_counts(index, phrases, corpora)
    # The same exchange feeds the counts per corpus and the scores.
    stats = counted.groupBy("corpus").agg(*_matching(len(phrases))).join(index.stats, "corpus")
    return _scored(counted, stats, len(phrases))


def bm25(index: Index, queries: dict[str, str], arabic_fold: bool = True, corpora: list[str] | None = None) -> DataFrame:
    """The same for several typed-in queries, with their ``query_id``."""
    found = [index_bm25(index, text, arabic_fold, corpora).withColumn("query_id", F.lit(name))
             for name, text in queries.items()]
    return reduce(DataFrame.unionByName, found)


# ── nearest neighbours ─────────────────────────────────────────────────────


def scored_vectors(vectors: DataFrame, query: list[float], metric: str = "l2", top: int | None = None) -> DataFrame:
    """Add ``score``, the distance to the query vector, and drop the embedding.

    Arrow batches are scored as one matrix each.  With ``top`` a batch returns
    its own best rows only, ties at the edge included, so that the overall top
    is unchanged.  Vectors of another length are not comparable and left out.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    wanted = np.asarray(query, dtype=np.float64)
    kept = [c for c in vectors.columns if c != "embedding"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = flat.reshape(-1, len(wanted)).astype(np.float64)
            if metric == "l2":
                gap = matrix - wanted
                values = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            else:
                norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * np.linalg.norm(wanted)
                with np.errstate(divide="ignore", invalid="ignore"):
                    values = 1.0 - (matrix @ wanted) / norms
            out = pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(values)], names=[*kept, "score"]
            )
            # A zero vector has no angle and a broken one no distance: neither is a hit.
            finite = np.isfinite(values)
            out, values = out.filter(pa.array(finite)), values[finite]
            if top is not None and len(values) > top:
                out = out.filter(pa.array(values <= np.partition(values, top - 1)[top - 1]))
            yield out

    usable = vectors.where(F.size("embedding") == len(wanted)).select(*kept, "embedding")
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept) + ", score double"
    return usable.mapInArrow(score, schema)


def knn(
    vectors: DataFrame, query: list[float], top: int = CHANNEL_TOP, metric: str = "l2",
    partition: list[str] | None = None,
) -> DataFrame:
    """Nearest vectors by full scan; only the best rows of each task travel."""
    scored = scored_vectors(vectors, query, metric, None if partition else top)
    return top_k(scored, top, [F.asc("score"), F.asc("chunk_id")], partition)


# ── ranks and fusion ───────────────────────────────────────────────────────


def channel_rank(scored: DataFrame, threshold: float, keys: list[str], name: str, row: str | None = None) -> DataFrame:
    """Unique ranks of the eligible chunks.  ``scored`` holds the channel's
    top rows only; the best row of each chunk counts."""
    from pyspark.sql import Window as W

    order = F.struct("score", *([row] if row else []))
    best = (
        scored.where((F.col("score") <= threshold) & F.col("chunk_id").isNotNull())
        .groupBy(*keys, "chunk_id")
        .agg(F.min(order).alias("_o"))
    )
    rank = F.row_number().over(
        W.partitionBy(*keys).orderBy(F.col("_o.score"), F.col("chunk_id"), *([F.col(f"_o.{row}")] if row else []))
    )
    return best.select(*keys, "chunk_id", rank.alias(name))


def fuse_ranks(bm25_ranks: DataFrame, vec_ranks: DataFrame | None, keys: list[str], k: int = RRF_K) -> DataFrame:
    if vec_ranks is None:
        both = bm25_ranks.withColumn("vec_rank", F.lit(None).cast("int"))
    else:
        both = bm25_ranks.join(vec_ranks, [*keys, "chunk_id"], "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + k), F.lit(0.0))
    return both.withColumn("_rrf", term("bm25_rank") + term("vec_rank")).withColumn("rrf_score", F.round("_rrf", 5))


@dataclass
class Settings:
    """Ranking parameters.  ``filter_scope="bm25"`` lets vector hits escape
    the type and section filters; ``"both"`` holds them to it."""

    top_k: int = TOP_K
    bm25_threshold: float = BM25_THRESHOLD
    vec_threshold: float = VEC_THRESHOLD
    metric: str = "l2"
    filter_scope: str = "both"
    arabic_fold: bool = True
    max_chars: int | None = None


def ranked_hits(
    source: DataFrame | Index, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    chunk_filter: DataFrame | None = None, settings: Settings = Settings(), columns: list[str] = INDEXED,
) -> DataFrame:
    """Fused hits per corpus, ``top_k`` each, from rows to scan or from an index.
    ``chunk_filter`` holds the ids that pass the filters; statistics still count every row."""
    s, keys = settings, ["corpus"]
    if isinstance(source, Index):
        scored = index_bm25(source, query, s.arabic_fold)
    else:
        scored = scan_bm25(source, query, columns, s.arabic_fold)
    scored = scored.where("chunk_id is not null")
    if chunk_filter is not None:
        scored = scored.join(chunk_filter.select("chunk_id").distinct(), "chunk_id", "left_semi")
    best = top_k(scored, CHANNEL_TOP, [F.asc("score"), F.asc("chunk_id"), F.asc("row_id")], keys)
    bm25_ranks = channel_rank(best, s.bm25_threshold, keys, "bm25_rank", "row_id")
    vec_ranks = None
    if vectors is not None and query_vector is not None:
        if chunk_filter is not None and s.filter_scope == "both":
            vectors = vectors.join(chunk_filter.select("chunk_id").distinct(), "chunk_id", "left_semi")
        near = knn(vectors, query_vector, CHANNEL_TOP, s.metric, keys)
        vec_ranks = channel_rank(near, s.vec_threshold, keys, "vec_rank")
    fused = fuse_ranks(bm25_ranks, vec_ranks, keys)
    return top_k(fused, s.top_k, [F.desc("_rrf"), F.desc("chunk_id")], keys)


def hybrid_search(
    source: DataFrame | Index, chunks: DataFrame, documents: DataFrame, query: str, vectors: DataFrame | None = None,
    query_vector: list[float] | None = None, chunk_filter: DataFrame | None = None,
    settings: Settings = Settings(), columns: list[str] = INDEXED,
) -> DataFrame:
    """Search one or many corpora; the merged list is cut to ``top_k``.

    The few ids of that list become a filter on the chunks, so a store sorted by chunk reads
    the row groups of the hits only.
    """
    hits = ranked_hits(source, query, vectors, query_vector, chunk_filter, settings, columns)
    merged = top_k(hits, settings.top_k, [F.desc("rrf_score"), F.asc("corpus"), F.desc("_rrf"), F.desc("chunk_id")])
    return hydrate_best(merged.drop("_rrf"), chunks, documents, settings.max_chars)


def hydrate_best(hits: DataFrame, chunks: DataFrame, documents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The few rows of a top-k list with their chunks and documents; their ids are literals that reach the scan of the chunks."""
    best = hits.collect()
    found = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in best]))
    return hydrate(chunks.sparkSession.createDataFrame(best, hits.schema), found, documents, max_chars)


def rag_context(hits: DataFrame) -> DataFrame:
    """One row: the provenance-formatted context, or the no-context flag."""
    block = context_block(
        F.col("document_title"), F.col("page_number"), F.col("section_title"), F.col("pedagogical_type"),
        F.col("content_markdown"),
    )
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("rrf_score")).alias("o"), "corpus", "chunk_id", block.alias("block")))
    )
    return hits.agg(ordered.alias("b")).select(
        F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"),
        F.size("b").alias("sources"),
        (F.size("b") == 0).alias("no_context"),
    )
