"""Search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from foliospark.catalog.tables import Tables, register
from foliospark.functions.text import fold_pair, tokens
from foliospark.operators.sets import index_rows
from foliospark.operators.topk import top_k
from foliospark.plans.search import (
    CHANNEL_TOP, Index, Settings, build_index, channel_rank, fuse_ranks, hybrid_search, hydrate_best, index_bm25, knn,
    rag_context, ranked_hits, scan_bm25,
)
from foliospark.plans.segments import SegmentedIndex
from foliospark.plans.vectors import knn_many
from foliospark.session import shared_dir

QUERY = "esat estion ndat"
TERMS = QUERY.split()
COLUMNS = ["search_content"]
VEC_LIMIT = 1.25
SETTINGS = Settings(vec_threshold=VEC_LIMIT)


def query_vector(t: Tables) -> list[float]:
    """The vector a user asks with: that of the first embedding."""
    return list(t["embeddings"].where("vec_id = 0").select("embedding").first()[0])


# ── oracle building blocks ─────────────────────────────────────────────────

_SRC, _DST = fold_pair()
TOKENS = (
    "list_filter(regexp_split_to_array(translate(lower({}), '" + _SRC + "', '" + _DST + "'), "
    "'[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"
)


def sql_bm25(rows: str = "@v_rows", corpus: str = "corpus", terms: list[str] = TERMS) -> str:
    """CTEs ending in ``scored(corpus, row_id, chunk_id, score)``."""
    words = ", ".join(f"'{w}'" for w in terms)
    return f"""
    toks AS (SELECT {corpus} AS corpus, row_id, chunk_id, {TOKENS.format('search_content')} AS w FROM {rows}),
    st AS (SELECT corpus, count(*) AS n_rows, avg(len(w)) AS a FROM toks GROUP BY corpus),
    post AS (SELECT corpus, row_id, chunk_id, dl, term, count(*) AS tf
             FROM (SELECT corpus, row_id, chunk_id, len(w) AS dl, unnest(w) AS term FROM toks)
             WHERE term IN ({words}) GROUP BY ALL),
    dfs AS (SELECT corpus, term, count(*) AS n FROM post GROUP BY ALL),
    idf AS (SELECT corpus, term, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0
            THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM dfs JOIN st USING (corpus)),
    scored AS (SELECT corpus, row_id, chunk_id,
               -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score
               FROM post JOIN idf USING (corpus, term) JOIN st USING (corpus) GROUP BY ALL)"""


SQL_VEC = """
    q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM @embeddings WHERE vec_id = 0),
    dist AS (SELECT corpus, chunk_id, list_distance(CAST(embedding AS DOUBLE[]), qv) AS score FROM {}, q)"""


def sql_ranks(bm25_limit: float = -0.3, vec_limit: float = VEC_LIMIT) -> str:
    return f"""
    bt AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY score, chunk_id, row_id) <= 20),
    br AS (SELECT corpus, chunk_id, row_number() OVER (PARTITION BY corpus ORDER BY score, chunk_id) AS bm25_rank
           FROM bt WHERE score <= {bm25_limit}),
    vt AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY score, chunk_id) <= 20),
    vr AS (SELECT corpus, chunk_id, row_number() OVER (PARTITION BY corpus ORDER BY score, chunk_id) AS vec_rank
           FROM vt WHERE score <= {vec_limit}),
    fused AS (SELECT corpus, chunk_id, bm25_rank, vec_rank,
              coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0) AS rrf
              FROM br FULL JOIN vr USING (corpus, chunk_id))"""


_ALL = "(SELECT 'all' AS corpus, row_id, chunk_id, search_content FROM @v_rows)"
_ALL_VEC = "(SELECT 'all' AS corpus, chunk_id, embedding FROM @v_vectors)"
_HIT_COLUMNS = """chunk_id, d.document_id, d.title AS document_title, c.page_number, c.section_title,
    c.content_markdown, c.pedagogical_type"""


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("corpus", F.lit("all"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("corpus", "chunk_id", "bm25_rank", "vec_rank", F.round("_rrf", 5).alias("rrf_score"))


_INDEXES: dict[tuple[str, str, str], str] = {}


def stored_index(t: Tables, name: str, rows: DataFrame) -> Index:
    """The index of a table set, written to the shared folder the first time a session asks for it."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _INDEXES:
        path = f"{shared_dir(t.spark).rstrip('/')}/index-{name}-{uuid.uuid4().hex}"
        build_index(rows, COLUMNS).write(path)
        target = t.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(t.spark._jsc.hadoopConfiguration()).deleteOnExit(target)
        _INDEXES[key] = path
    return Index.read(t.spark, _INDEXES[key])


# ── queries ────────────────────────────────────────────────────────────────


@register("top_bm25_20", f"""
    WITH {sql_bm25(_ALL)}
    SELECT chunk_id, round(score, 4) AS score FROM scored ORDER BY scored.score, chunk_id LIMIT 20""")
def top_bm25_20(t: Tables) -> DataFrame:
    scored = scan_bm25(_one(t["v_rows"]), QUERY, COLUMNS)
    best = top_k(scored, CHANNEL_TOP, [F.asc("score"), F.asc("chunk_id"), F.asc("row_id")])
    return best.select("chunk_id", F.round("score", 4).alias("score"))


@register("sr_bm25", f"""
    WITH {sql_bm25()} SELECT corpus, row_id, round(score, 4) AS score FROM scored""")
def sr_bm25(t: Tables) -> DataFrame:
    return scan_bm25(t["v_rows"], QUERY, COLUMNS).select("corpus", "row_id", F.round("score", 4).alias("score"))


@register("sr_bm25_index", f"""
    WITH {sql_bm25()} SELECT corpus, row_id, round(score, 4) AS score FROM scored""")
def sr_bm25_index(t: Tables) -> DataFrame:
    scores = index_bm25(stored_index(t, "corpora", t["v_rows"]), QUERY)
    return scores.select("corpus", "row_id", F.round("score", 4).alias("score"))


# Two words in a row, and one alone.
PHRASES = "of'the esat"


@register("sr_bm25_phrase", f"""
    WITH toks AS (SELECT corpus, row_id, {TOKENS.format('search_content')} AS w FROM @v_rows),
    st AS (SELECT corpus, count(*) AS n_rows, avg(len(w)) AS a FROM toks GROUP BY corpus),
    post AS (SELECT corpus, row_id, len(w) AS dl, p,
             CASE p WHEN 0 THEN len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))
                  ELSE len(list_filter(w, lambda x: x = 'esat')) END AS tf
             FROM toks, range(2) AS r(p)),
    dfs AS (SELECT corpus, p, count(*) FILTER (WHERE tf > 0) AS n FROM post GROUP BY ALL),
    idf AS (SELECT corpus, p, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0
            THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM dfs JOIN st USING (corpus))
    SELECT corpus, row_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS score
    FROM post JOIN idf USING (corpus, p) JOIN st USING (corpus) WHERE tf > 0 GROUP BY corpus, row_id""")
def sr_bm25_phrase(t: Tables) -> DataFrame:
    """A term of two tokens is a phrase, met by positions in the stored index."""
    scores = index_bm25(stored_index(t, "corpora", t["v_rows"]), PHRASES)
    return scores.select("corpus", "row_id", F.round("score", 4).alias("score"))


@register("sr_index_edit", f"""
    WITH {sql_bm25("(SELECT * FROM @v_rows WHERE row_id % 7 <> 0)")} SELECT corpus, row_id, round(score, 4) AS score FROM scored""")
def sr_index_edit(t: Tables) -> DataFrame:
    """Rows come in, change and go by edits of the index; scores are those of what is left."""
    rows, last = t["v_rows"], F.col("row_id") % 10
    index = SegmentedIndex(t.spark, f"{shared_dir(t.spark).rstrip('/')}/segments-{uuid.uuid4().hex}", COLUMNS)
    stale = F.when(last == 3, F.concat(F.lit("esat esat "), F.col("search_content"))).otherwise(F.col("search_content"))
    index.edit(rows.where(last != 0).withColumn("search_content", stale))
    index.edit(rows.where(last.isin(0, 3)), rows.where(F.col("row_id") % 7 == 1))
    index.edit(rows.where(F.col("row_id") % 7 == 1), rows.where(F.col("row_id") % 7 == 0))
    index.merge()
    return index_bm25(index.index(), QUERY).select("corpus", "row_id", F.round("score", 4).alias("score"))


@register("sr_index_build", f"""
    WITH toks AS (SELECT corpus, row_id, {TOKENS.format('search_content')} AS w FROM @v_rows),
    st AS (SELECT corpus, count(*) AS n_rows, round(avg(len(w)), 4) AS avg_dl FROM toks GROUP BY corpus),
    p AS (SELECT DISTINCT corpus, row_id, term FROM (SELECT corpus, row_id, unnest(w) AS term FROM toks)),
    pc AS (SELECT corpus, count(*) AS postings, count(DISTINCT term) AS terms FROM p GROUP BY corpus)
    SELECT corpus, n_rows, avg_dl, postings, terms FROM st JOIN pc USING (corpus)""")
def sr_index_build(t: Tables) -> DataFrame:
    index = build_index(t["v_rows"], COLUMNS)
    counted = index.postings.groupBy("corpus").agg(
        F.count("*").alias("postings"), F.countDistinct("term").alias("terms")
    )
    return index.stats.join(counted, "corpus").select(
        "corpus", "n_rows", F.round("avg_dl", 4).alias("avg_dl"), "postings", "terms"
    )


@register("top_vec_20", f"""
    WITH {SQL_VEC.format(_ALL_VEC)}
    SELECT chunk_id, round(score, 4) AS score FROM dist ORDER BY dist.score, chunk_id LIMIT 20""")
def top_vec_20(t: Tables) -> DataFrame:
    near = knn(t["v_vectors"], query_vector(t))
    return near.select("chunk_id", F.round("score", 4).alias("score"))


@register("sr_vector", f"""
    WITH {SQL_VEC.format('@v_vectors')}
    SELECT corpus, chunk_id, round(score, 4) AS score FROM dist
    QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY dist.score, chunk_id) <= 20""")
def sr_vector(t: Tables) -> DataFrame:
    near = knn(t["v_vectors"], query_vector(t), partition=["corpus"])
    return near.select("corpus", "chunk_id", F.round("score", 4).alias("score"))


@register("sr_vector_cosine", """
    WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM @embeddings WHERE vec_id = 0),
    dist AS (SELECT chunk_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM @v_vectors, q)
    SELECT chunk_id, round(score, 4) AS score FROM dist ORDER BY dist.score, chunk_id LIMIT 20""")
def sr_vector_cosine(t: Tables) -> DataFrame:
    near = knn(t["v_vectors"], query_vector(t), metric="cosine")
    return near.select("chunk_id", F.round("score", 4).alias("score"))


@register("sr_vector_many", """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM @embeddings),
    d AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_distance(v.e, q.e) AS score FROM v q, v WHERE q.vec_id % 25 = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score FROM d
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.score, chunk_id) <= 20""")
def sr_vector_many(t: Tables) -> DataFrame:
    """One vector in 25 asks, all of them in one plan."""
    vectors = t["embeddings"].select(F.col("vec_id").alias("chunk_id"), "embedding")
    questions = vectors.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "query_id")
    return knn_many(vectors, questions).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@register("sr_threshold", f"""
    WITH {sql_bm25()}
    SELECT corpus, count(*) AS eligible FROM scored WHERE score <= -0.3 GROUP BY corpus""")
def sr_threshold(t: Tables) -> DataFrame:
    scored = scan_bm25(t["v_rows"], QUERY, COLUMNS)
    return scored.where("score <= -0.3").groupBy("corpus").agg(F.count("*").alias("eligible"))


@register("win_channel_rank", f"""
    WITH {sql_bm25()}, {SQL_VEC.format('@v_vectors')}, {sql_ranks()}
    SELECT corpus, chunk_id, CAST(bm25_rank AS INT) AS bm25_rank FROM br""")
def win_channel_rank(t: Tables) -> DataFrame:
    scored = scan_bm25(t["v_rows"], QUERY, COLUMNS)
    best = top_k(scored, CHANNEL_TOP, [F.asc("score"), F.asc("chunk_id"), F.asc("row_id")], ["corpus"])
    return channel_rank(best, -0.3, ["corpus"], "bm25_rank", "row_id")


_FUSED = f"""
    WITH {sql_bm25()}, {SQL_VEC.format('@v_vectors')}, {sql_ranks()}
    SELECT corpus, chunk_id, CAST(bm25_rank AS INT) AS bm25_rank, CAST(vec_rank AS INT) AS vec_rank,
           round(rrf, 5) AS rrf_score FROM fused"""


def _channels(t: Tables) -> tuple[DataFrame, DataFrame]:
    scored = scan_bm25(t["v_rows"], QUERY, COLUMNS)
    best = top_k(scored, CHANNEL_TOP, [F.asc("score"), F.asc("chunk_id"), F.asc("row_id")], ["corpus"])
    near = knn(t["v_vectors"], query_vector(t), partition=["corpus"])
    return (
        channel_rank(best, -0.3, ["corpus"], "bm25_rank", "row_id"),
        channel_rank(near, VEC_LIMIT, ["corpus"], "vec_rank"),
    )


@register("jn_rank_fusion", _FUSED)
def jn_rank_fusion(t: Tables) -> DataFrame:
    return _ranked(fuse_ranks(*_channels(t), ["corpus"]))


@register("set_fused_keys", f"""
    WITH {sql_bm25()}, {SQL_VEC.format('@v_vectors')}, {sql_ranks()}
    SELECT DISTINCT corpus, chunk_id FROM fused""")
def set_fused_keys(t: Tables) -> DataFrame:
    return fuse_ranks(*_channels(t), ["corpus"]).select("corpus", "chunk_id").distinct()


@register("top_fused_k", _FUSED + " QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY rrf DESC, chunk_id DESC) <= 5")
def top_fused_k(t: Tables) -> DataFrame:
    return _ranked(ranked_hits(t["v_rows"], QUERY, t["v_vectors"], query_vector(t), None, SETTINGS, COLUMNS))


_HYBRID = f"""
    WITH {sql_bm25(_ALL)}, {SQL_VEC.format(_ALL_VEC)}, {sql_ranks()},
    hits AS (SELECT * FROM fused ORDER BY rrf DESC, chunk_id DESC LIMIT 5)
    SELECT {_HIT_COLUMNS}, CAST(bm25_rank AS INT) AS bm25_rank, CAST(vec_rank AS INT) AS vec_rank,
           round(rrf, 5) AS rrf_score, corpus
    FROM hits JOIN @v_doc_chunks c USING (chunk_id)
    JOIN (SELECT document_id, title FROM @v_documents) d ON d.document_id = c.document_id"""


def _search(t: Tables, source: Index, vectors, vector, chunk_filter=None, settings=SETTINGS) -> DataFrame:
    return hybrid_search(
        source, t["v_doc_chunks"], t["v_documents"], QUERY, vectors, vector, chunk_filter, settings, COLUMNS
    )


@register("sr_hybrid_rrf", _HYBRID)
def sr_hybrid_rrf(t: Tables) -> DataFrame:
    return _search(t, stored_index(t, "all", _one(t["v_rows"])), _one(t["v_vectors"]), query_vector(t))


@register("jn_hydrate_hits", _HYBRID)
def jn_hydrate_hits(t: Tables) -> DataFrame:
    hits = ranked_hits(
        stored_index(t, "all", _one(t["v_rows"])), QUERY, _one(t["v_vectors"]), query_vector(t), None, SETTINGS, COLUMNS
    )
    return hydrate_best(hits.drop("_rrf"), t["v_doc_chunks"], t["v_documents"])


@register("sr_bm25_only", f"""
    WITH {sql_bm25(_ALL)},
    bt AS (SELECT * FROM scored ORDER BY score, chunk_id LIMIT 20),
    br AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS bm25_rank FROM bt WHERE score <= -0.3)
    SELECT chunk_id, CAST(bm25_rank AS INT) AS bm25_rank, round(1.0 / (60 + bm25_rank), 5) AS rrf_score
    FROM br ORDER BY 1.0 / (60 + br.bm25_rank) DESC LIMIT 5""")
def sr_bm25_only(t: Tables) -> DataFrame:
    hits = ranked_hits(stored_index(t, "all", _one(t["v_rows"])), QUERY, settings=SETTINGS, columns=COLUMNS)
    return hits.select("chunk_id", "bm25_rank", "rrf_score")


@register("sr_hybrid_filtered", f"""
    WITH {sql_bm25(_ALL)}, {SQL_VEC.format(_ALL_VEC)},
    ok AS (SELECT chunk_id FROM @v_doc_chunks WHERE section_title = 'en'),
    bt AS (SELECT * FROM scored WHERE chunk_id IN (SELECT chunk_id FROM ok) ORDER BY score, chunk_id LIMIT 20),
    br AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS bm25_rank FROM bt WHERE score <= -0.3),
    vt AS (SELECT * FROM dist WHERE chunk_id IN (SELECT chunk_id FROM ok) ORDER BY score, chunk_id LIMIT 20),
    vr AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS vec_rank FROM vt WHERE score <= {VEC_LIMIT}),
    fused AS (SELECT chunk_id, bm25_rank, vec_rank,
              coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0) AS rrf
              FROM br FULL JOIN vr USING (chunk_id))
    SELECT chunk_id, CAST(bm25_rank AS INT) AS bm25_rank, CAST(vec_rank AS INT) AS vec_rank, round(rrf, 5) AS rrf_score
    FROM fused ORDER BY rrf DESC, chunk_id DESC LIMIT 5""")
def sr_hybrid_filtered(t: Tables) -> DataFrame:
    keep = t["v_doc_chunks"].where("section_title = 'en'")
    hits = ranked_hits(
        _one(t["v_rows"]), QUERY, _one(t["v_vectors"]), query_vector(t), keep, SETTINGS, COLUMNS
    )
    return hits.select("chunk_id", "bm25_rank", "vec_rank", "rrf_score")


_MULTI = f"""
    WITH {sql_bm25()}, {SQL_VEC.format('@v_vectors')}, {sql_ranks()},
    per AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY rrf DESC, chunk_id DESC) <= 5),
    hits AS (SELECT * FROM per ORDER BY round(rrf, 5) DESC, corpus, rrf DESC, chunk_id DESC LIMIT 5)"""


@register("sr_multi_corpus", _MULTI + f"""
    SELECT {_HIT_COLUMNS}, CAST(bm25_rank AS INT) AS bm25_rank, CAST(vec_rank AS INT) AS vec_rank,
           round(rrf, 5) AS rrf_score, corpus
    FROM hits JOIN @v_doc_chunks c USING (chunk_id)
    JOIN (SELECT document_id, title FROM @v_documents) d ON d.document_id = c.document_id""")
def sr_multi_corpus(t: Tables) -> DataFrame:
    return _search(t, stored_index(t, "corpora", t["v_rows"]), t["v_vectors"], query_vector(t))


@register("sr_context", _MULTI + """
    SELECT string_agg('[Doc: ' || d.title || ' | Page: 1 | Section: ' || c.section_title || ' | Type: '
           || c.pedagogical_type || ']' || chr(10) || c.content_markdown, chr(10) || chr(10)
           ORDER BY round(rrf, 5) DESC, hits.corpus, hits.chunk_id) AS context,
           CAST(count(*) AS INT) AS sources, count(*) = 0 AS no_context
    FROM hits JOIN @v_doc_chunks c USING (chunk_id)
    JOIN (SELECT document_id, title FROM @v_documents) d ON d.document_id = c.document_id""")
def sr_context(t: Tables) -> DataFrame:
    return rag_context(_search(t, stored_index(t, "corpora", t["v_rows"]), t["v_vectors"], query_vector(t)))


@register("set_index_rows", """
    WITH titles AS (SELECT document_id, title FROM @b_documents),
    r AS (SELECT c.corpus, 'c' || CAST(chunk_id AS STRING) AS row_id, chunk_id, CAST(NULL AS STRING) AS artifact_id,
                 c.document_id, page_number, title, section_title, pedagogical_type, section_title AS search_content
          FROM @b_chunks c LEFT JOIN titles USING (document_id)
          UNION ALL
          SELECT a.corpus, 'a' || CAST(artifact_id AS STRING), a.chunk_id, CAST(artifact_id AS STRING), a.document_id,
                 a.page_number, title, caption, c.pedagogical_type,
                 coalesce(searchable_text, '') || ' ' || coalesce(raw_data, '')
          FROM @b_artifacts a LEFT JOIN @b_chunks c ON c.chunk_id = a.chunk_id
          LEFT JOIN titles t ON t.document_id = a.document_id)
    SELECT * FROM r""")
def set_index_rows(t: Tables) -> DataFrame:
    chunks = t["b_chunks"].withColumn("content_markdown", F.col("section_title"))
    return index_rows(chunks, t["b_artifacts"], t["b_documents"])


@register("jn_fts_chunk", """
    SELECT pedagogical_type, count(*) AS n FROM
    (SELECT chunk_id FROM @b_chunks UNION ALL SELECT chunk_id FROM @b_artifacts WHERE chunk_id IS NOT NULL) r
    JOIN @b_chunks c USING (chunk_id) GROUP BY pedagogical_type""")
def jn_fts_chunk(t: Tables) -> DataFrame:
    chunks = t["b_chunks"].withColumn("content_markdown", F.col("section_title"))
    rows = index_rows(chunks, t["b_artifacts"], t["b_documents"]).where("chunk_id is not null")
    typed = rows.select("chunk_id").join(t["b_chunks"].select("chunk_id", "pedagogical_type"), "chunk_id")
    return typed.groupBy("pedagogical_type").agg(F.count("*").alias("n"))


@register("fn_tokenize", f"""
    WITH w AS (SELECT unnest({TOKENS.format('text')}) AS term FROM @documents)
    SELECT term, count(*) AS n FROM w GROUP BY term""")
def fn_tokenize(t: Tables) -> DataFrame:
    return (
        t["documents"].select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    )


@register("fn_fts_query", f"""
    WITH w AS (SELECT conv_id * 1000 + turn AS query_id, unnest({TOKENS.format('text')}) AS term
               FROM @conversations)
    SELECT query_id, count(DISTINCT term) AS terms FROM w GROUP BY query_id""")
def fn_fts_query(t: Tables) -> DataFrame:
    """Turns read as queries: distinct OR-ed terms of each."""
    asked = t["conversations"].select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    terms = F.array_distinct(tokens(F.replace(F.col("text"), F.lit('"'), F.lit(""))))
    return asked.select("query_id", F.size(terms).cast("long").alias("terms")).where("terms > 0")
