"""Text, lint, LaTeX and artifact functions, each as a job over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.catalog.tables import Tables, register
from foliospark.functions import anchoring, artifacts as art, latex, lint, tables as tab, text as tx
from foliospark.functions.chunking import enforce_max, pack_units, split_units
from foliospark.functions.classify import effective_type, qualify
from foliospark.plans.chunk_corpus import chunk_pages, embed, formula_artifacts, lint_pages_table, repair


def T() -> F.Column:
    return F.col("text")


def B() -> F.Column:
    return F.col("content_markdown")


# Patterns made of words of the test corpus (its prose holds none of the
# real markers); RE2 and Java read them alike.
WORD_PATTERNS = [
    ("solution_only", "ndat"),
    ("exercise_unsolved", "([0-9]{1,3})"),
    ("proof_demonstration", "(?:^|\\n)Que "),
    ("course_theory", " esat"),
]


@register("fn_strip_harakat", "SELECT doc_id, md5(text) AS text_md5 FROM @documents")
def fn_strip_harakat(t: Tables) -> DataFrame:
    """Vowel marks and lengthening strokes put into every text and taken out again."""
    marked = F.regexp_replace(T(), "([aeo])", "$1\u064e\u0640\u0651")
    return t["documents"].select("doc_id", F.md5(tx.strip_harakat(marked)).alias("text_md5"))


_QUALIFY = """
    WITH m AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, 'ndat') THEN 0
                 WHEN regexp_matches(text, '[0-9]{1,3}') THEN 1
                 WHEN regexp_matches(text, '(?:^|\\n)Que ') THEN 2 WHEN regexp_matches(text, ' esat') THEN 3 END AS n
               FROM @documents)"""


@register("fn_qualify_type", _QUALIFY + """
    SELECT doc_id, CASE n WHEN 0 THEN 'solution_only' WHEN 1 THEN 'exercise_unsolved'
           WHEN 2 THEN 'proof_demonstration' WHEN 3 THEN 'course_theory' END AS pedagogical_type FROM m""")
def fn_qualify_type(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", qualify(T(), WORD_PATTERNS)["pedagogical_type"].alias("pedagogical_type"))


@register("fn_qualify_index", _QUALIFY + """
    SELECT doc_id, CASE WHEN n = 1 THEN CAST(regexp_extract(text, '([0-9]{1,3})', 1) AS INT) END AS pedagogical_index
    FROM m""")
def fn_qualify_index(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", qualify(T(), WORD_PATTERNS)["pedagogical_index"].alias("pedagogical_index"))


# (heading put before a text, type, index) by the default table; the number is the document's own.
_HEADINGS = [
    ("## Exercice n° ", "exercise_unsolved", True), ("تمرين رقم ", "exercise_unsolved", True),
    ("Correction de l'exercice n° ", "solution_only", True), ("Corrigé ", "solution_only", True),
    ("Devoir ", "evaluation_exam", False), ("Démonstration ", "proof_demonstration", False),
    ("Travaux pratiques ", "practical_work", False), ("# Théorème ", "course_theory", False), ("برهان ", "proof_demonstration", False),
]


def _headed(sql: bool) -> str:
    """Number of each document as digits, in Arabic-Indic ones for every other document."""
    number = "CAST(1 + doc_id % 98 AS STRING)"
    digits = "CASE WHEN doc_id % 2 = 0 THEN translate({0}, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE {0} END".format(number)
    cases = " ".join("WHEN {} THEN '{}'".format(n, h.replace("'", "''" if sql else "\\'")) for n, (h, _, _) in enumerate(_HEADINGS))
    return f"CASE doc_id % {len(_HEADINGS)} {cases} END || {digits} || chr(10) || chr(10) || lower(text)"


@register("fn_qualify_default", f"""
    SELECT doc_id, CASE doc_id % {len(_HEADINGS)} {' '.join(f"WHEN {n} THEN '{k}'" for n, (_, k, _) in enumerate(_HEADINGS))} END
           AS pedagogical_type,
           CASE WHEN doc_id % {len(_HEADINGS)} IN ({', '.join(str(n) for n, h in enumerate(_HEADINGS) if h[2])})
           THEN CAST(1 + doc_id % 98 AS INT) END AS pedagogical_index FROM @documents""")
def fn_qualify_default(t: Tables) -> DataFrame:
    """The default table over every text behind a real heading, numbers in both kinds of digits."""
    found = t["documents"].select("doc_id", qualify(F.expr(_headed(False))).alias("q"))
    return found.select("doc_id", "q.pedagogical_type", "q.pedagogical_index")


@register("fn_effective_type", """
    WITH h AS (SELECT chunk_id, CASE WHEN pedagogical_type = 'solution_only' THEN 'solution_only' END AS declared,
                 left(trim(regexp_replace(regexp_replace(content_markdown, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'),
                      '[#>*_`~-]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)), 40) AS head FROM @v_chunks),
    g AS (SELECT *, CASE WHEN head LIKE '%que%' OR head LIKE '%und%' THEN 'evaluation_exam'
                         WHEN head LIKE '%the%' THEN 'solution_only'
                         WHEN head LIKE '%en%' THEN 'exercise_unsolved' END AS guess FROM h)
    SELECT chunk_id, coalesce(declared, guess) AS type,
           CAST(declared IS NULL AND guess IS NOT NULL AS INT) AS inferred FROM g""")
def fn_effective_type(t: Tables) -> DataFrame:
    declared = F.when(F.col("pedagogical_type") == "solution_only", F.col("pedagogical_type"))
    found = effective_type(declared, B(), (["que", "und"], ["the"], ["en"]))
    return t["v_chunks"].select("chunk_id", found.alias("e")).select(
        "chunk_id", "e.type", F.col("e.inferred").cast("int").alias("inferred")
    )


@register("fn_token_len", """
    SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS INT) AS token_count FROM @documents""")
def fn_token_len(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", tx.token_len(T()).alias("token_count"))


@register("fn_split_units", """
    WITH u AS (SELECT chunk_id, unnest(regexp_split_to_array(content_markdown, '\\n\\n+')) AS unit FROM @v_chunks)
    SELECT chunk_id, count(*) AS units, sum(length(unit))::BIGINT AS chars FROM u WHERE trim(unit) <> '' GROUP BY chunk_id""")
def fn_split_units(t: Tables) -> DataFrame:
    units = t["v_chunks"].select("chunk_id", F.explode(split_units(B())).alias("unit"))
    return units.groupBy("chunk_id").agg(F.count("*").alias("units"), F.sum(F.length("unit")).alias("chars"))


@register("fn_enforce_max")
def fn_enforce_max(t: Tables) -> DataFrame:
    """Sizes of the re-split units of every document (greedy folds have no SQL
    twin; the tests compare them with brute force)."""
    units = t["documents"].select("doc_id", F.posexplode(enforce_max(split_units(T()), 512)).alias("n", "unit"))
    return units.select("doc_id", "n", tx.token_len(F.col("unit")).alias("tokens"))


@register("win_chunk_pack")
def win_chunk_pack(t: Tables) -> DataFrame:
    """Chunks of every document's units, each with the overlap of the one before (greedy, see the tests)."""
    units = enforce_max(split_units(T()), 512)
    packed = t["documents"].select("doc_id", F.posexplode(pack_units(units, 512)).alias("n", "chunk"))
    return packed.select("doc_id", "n", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


# A field with a JSON list, a comma list, a lone name, or nothing.
_MEDIA = """CASE c_custkey % 4 WHEN 0 THEN '["p' || {0} || '.png", "", "q.png"]' WHEN 1 THEN 'p' || {0} || '.png,, q.png'
    WHEN 2 THEN 'p' || {0} || '.png' END""".format("CAST(c_custkey AS STRING)")


@register("fn_media_list", """
    WITH m AS (SELECT c_custkey, c_custkey % 4 AS k, 'p' || CAST(c_custkey AS STRING) || '.png' AS p FROM @customer)
    SELECT c_custkey AS evaluation_id, kind, n AS label, item FROM m, (VALUES ('corrige'), ('sujet')) AS kinds(kind),
      (SELECT 1 AS n UNION ALL SELECT 3) AS places, LATERAL (SELECT CASE n WHEN 1 THEN p ELSE 'q.png' END AS item)
    WHERE k < 3 AND (n = 1 OR k < 2)""")
def fn_media_list(t: Tables) -> DataFrame:
    """Subject and answer images of evaluations, a row each with its place in the list."""
    rows = t["customer"].select(F.col("c_custkey").alias("evaluation_id"), F.expr(_MEDIA).alias("sujet"), F.expr(_MEDIA).alias("corrige"))
    return tab.media_rows(rows, "evaluation_id", {"sujet": "sujet", "corrige": "corrige"})


@register("job_chunk_corpus")
def job_chunk_corpus(t: Tables) -> DataFrame:
    pages = t["documents"].select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), T().alias("content_markdown")
    )
    return chunk_pages(pages, WORD_PATTERNS)


@register("fn_section_title", """
    SELECT chunk_id, nullif(trim(regexp_extract(content_markdown, '(?m)^#{1,3}\\s+(.+)$', 1)), '')
           AS section_title FROM @v_chunks""")
def fn_section_title(t: Tables) -> DataFrame:
    return t["v_chunks"].select("chunk_id", tx.section_title(B()).alias("section_title"))


@register("fn_headings", """
    WITH h AS (SELECT chunk_id, unnest(regexp_extract_all(content_markdown, '(?m)^(#{2,3})\\s+(.{3,})$', 2)) AS raw
               FROM @v_chunks)
    SELECT chunk_id, 1 AS level, trim(regexp_replace(trim(raw), '\\s+', ' ', 'g'), '*# ') AS title FROM h
    WHERE trim(raw, '*# ') <> ''""")
def fn_headings(t: Tables) -> DataFrame:
    found = t["v_chunks"].select("chunk_id", F.explode(tx.headings(B())).alias("h"))
    return found.select("chunk_id", "h.level", "h.title")


@register("fn_formula_extract", """
    WITH m AS (SELECT doc_id, regexp_extract_all(text, '\\$\\$(.+?)\\$\\$|\\$([^$\\n]{2,200})\\$', 1, 's') AS d,
                      regexp_extract_all(text, '\\$\\$(.+?)\\$\\$|\\$([^$\\n]{2,200})\\$', 2, 's') AS i FROM @documents),
    u AS (SELECT doc_id, unnest(range(1, len(d) + 1)) AS n, unnest(d) AS d, unnest(i) AS i FROM m),
    f AS (SELECT doc_id, n, trim(CASE WHEN d <> '' THEN d ELSE i END, ' ' || chr(9) || chr(10) || chr(13)) AS latex,
                 d <> '' AS display FROM u)
    SELECT doc_id AS document_id, 'md_f' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS STRING) AS block_id_ref,
           CASE WHEN display THEN '$$' || latex || '$$' ELSE '$' || latex || '$' END AS raw_data
    FROM f WHERE length(latex) >= 2""")
def fn_formula_extract(t: Tables) -> DataFrame:
    pages = t["documents"].select(F.col("doc_id").alias("document_id"), T().alias("content_markdown"))
    return formula_artifacts(pages).select("document_id", "block_id_ref", "raw_data")


_LATIN = "A-Za-zÀ-ɏ"


@register("fn_unreadable", f"""
    WITH w AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS x,
                      regexp_extract_all(text, '[{_LATIN}]+') AS tok FROM @documents),
    c AS (SELECT doc_id, x, len(regexp_extract_all(x, '\\p{{L}}')) AS letters,
                 len(list_filter(regexp_extract_all(x, '\\p{{L}}'), lambda l: l BETWEEN chr(1536) AND chr(1791))) AS arabic,
                 len(tok) AS total, len(list_filter(tok, lambda k: length(k) <= 3)) AS short,
                 len(list_filter(tok, lambda k: length(k) >= 4 AND NOT regexp_matches(k, '[aeiouyAEIOUY]'))) AS dry
          FROM w)
    SELECT doc_id, CAST(CASE WHEN length(x) < 20 THEN TRUE WHEN letters = 0 THEN TRUE
           WHEN arabic >= letters * 0.3 THEN FALSE WHEN total < 6 THEN FALSE
           ELSE short > total * 0.55 OR (total > short AND dry > (total - short) * 0.4) END AS INT) AS unreadable FROM c""")
def fn_unreadable(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", tx.unreadable(T()).cast("int").alias("unreadable"))


_RATIO = "((x1 - x0) * (y1 - y0)) / (2480.0 * 3508.0)"


def boxed(df: DataFrame) -> DataFrame:
    """Artifacts with their corners as one struct."""
    return df.withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


@register("fn_area_ratio", f"""
    SELECT artifact_id, round(least(1.0, {_RATIO}), 3) AS area_ratio FROM @b_artifacts""")
def fn_area_ratio(t: Tables) -> DataFrame:
    ratio = art.area_ratio(F.col("bbox"), F.lit(2480), F.lit(3508))
    return boxed(t["b_artifacts"]).select("artifact_id", ratio.alias("area_ratio"))


@register("fn_lint_latex", """
    WITH c AS (SELECT doc_id, length(text) - length(replace(text, '{', '')) AS a,
                      length(text) - length(replace(text, '}', '')) AS b,
                      length(replace(text, '$$', '')) - length(replace(replace(text, '$$', ''), '$', '')) AS d
               FROM @documents)
    SELECT doc_id, CAST(a <> b AS INT) + CAST(d % 2 = 1 AS INT) AS errors FROM c""")
def fn_lint_latex(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.size(lint.lint_latex(T())).alias("errors"))


@register("fn_lint_table", """
    WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')), ' ' || chr(9)) AS line FROM @documents),
    r AS (SELECT doc_id, trim(line, '|') AS inner_line FROM l WHERE line LIKE '|%'),
    w AS (SELECT doc_id, count(*) AS n, count(DISTINCT length(inner_line) - length(replace(inner_line, '|', ''))) AS k
          FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n >= 2 AND k > 1, FALSE) AS INT) AS warnings FROM @documents LEFT JOIN w USING (doc_id)""")
def fn_lint_table(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.size(lint.lint_table(T())).alias("warnings"))


@register("fn_lint_unicode", """
    SELECT lang, count(*) AS docs, count(*) FILTER (WHERE length(text) > 0 AND
           (length(text) - length(replace(text, chr(65533), ''))) * 1.0 / length(text) > 0.05) AS noisy
    FROM @documents GROUP BY lang""")
def fn_lint_unicode(t: Tables) -> DataFrame:
    noisy = F.size(lint.lint_unicode(T())) > 0
    return t["documents"].groupBy("lang").agg(
        F.count("*").alias("docs"), F.count(F.when(noisy, 1)).alias("noisy")
    )


@register("fn_lint_svg")
def fn_lint_svg(t: Tables) -> DataFrame:
    """Well-formedness of every page source (an XML parser has no SQL twin)."""
    return t["pages"].select("page_id", lint.svg_error(F.col("html")).isNull().alias("well_formed"))


def _lint_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    chunks = t["documents"].select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"),
        T().alias("content_markdown"),
    )
    formulas = t["documents"].select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("f").alias("block_id_ref"),
        F.lit("latex_formula").alias("artifact_type"), T().alias("raw_data"), (F.col("lang") == "de").alias("needs_vlm"),
        T().alias("searchable_text"),
    )
    return chunks, formulas


_LINT = """
    WITH d AS (SELECT doc_id, lang, text, length(text) - length(replace(text, '{', '')) AS a,
                      length(text) - length(replace(text, '}', '')) AS b,
                      length(replace(text, '$$', '')) - length(replace(replace(text, '$$', ''), '$', '')) AS dollars,
                      (length(text) - length(replace(text, chr(65533), ''))) * 1.0 / greatest(1, length(text)) AS bad
               FROM @documents),
    l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')), ' ' || chr(9)) AS line FROM @documents),
    r AS (SELECT doc_id, trim(line, '|') AS x FROM l WHERE line LIKE '|%'),
    w AS (SELECT doc_id, count(*) AS n, count(DISTINCT length(x) - length(replace(x, '|', ''))) AS k FROM r GROUP BY doc_id),
    e AS (SELECT doc_id, 'UNBALANCED_LATEX' AS error_type, 'ERROR' AS severity FROM d WHERE a <> b
          UNION ALL SELECT doc_id, 'UNBALANCED_LATEX', 'ERROR' FROM d WHERE dollars % 2 = 1
          UNION ALL SELECT doc_id, 'UNICODE_NOISE', 'ERROR' FROM d WHERE bad > 0.05
          UNION ALL SELECT doc_id, 'UNICODE_NOISE', 'ERROR' FROM d WHERE bad > 0.05
          UNION ALL SELECT doc_id, 'NEEDS_VLM', 'ERROR' FROM d WHERE lang = 'de'
          UNION ALL SELECT doc_id, 'INVALID_TABLE_DIMENSIONS', 'WARNING' FROM w WHERE n >= 2 AND k > 1)"""


@register("job_lint", _LINT + """
    SELECT doc_id AS document_id, error_type, severity, count(*) AS n FROM e GROUP BY ALL""")
def job_lint(t: Tables) -> DataFrame:
    linted = lint_pages_table(*_lint_inputs(t))
    return linted.select("document_id", F.explode("errors").alias("e")).groupBy(
        "document_id", "e.error_type", "e.severity"
    ).agg(F.count("*").alias("n"))


@register("job_repair", """
    WITH d AS (SELECT doc_id, lang, text,
                      (length(text) - length(replace(text, '{', ''))) <> (length(text) - length(replace(text, '}', '')))
                      OR (length(replace(text, '$$', '')) - length(replace(replace(text, '$$', ''), '$', ''))) % 2 = 1
                      OR (length(text) - length(replace(text, chr(65533), ''))) * 1.0 / greatest(1, length(text)) > 0.05
                      OR lang = 'de' AS broken FROM @documents)
    SELECT doc_id AS document_id, CASE WHEN NOT broken THEN 'valid' WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'repaired' END
           AS repair_state,
           length(CASE WHEN broken AND length(text) % 3 > 0 THEN replace(text, '$', '') ELSE text END) AS chars
    FROM d""")
def job_repair(t: Tables) -> DataFrame:
    def drop_dollars(source: str) -> str | None:
        if len(source) % 3 == 0:
            raise ValueError("no answer")
        return source.replace("$", "")

    fixed = repair(_lint_inputs(t)[1], drop_dollars)
    return fixed.select("document_id", "repair_state", F.length("raw_data").cast("long").alias("chars"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@register("job_embed", f"""
    WITH l AS (SELECT chunk_id, 'passage: ' || coalesce(content_markdown, '') AS x, unnest(range(26)) AS n FROM @v_chunks)
    SELECT chunk_id, CAST(n AS INT) AS dim,
           CAST(length(x) - length(replace(x, substr('{_LETTERS}', CAST(n + 1 AS INT), 1), '')) AS DOUBLE) AS value FROM l""")
def job_embed(t: Tables) -> DataFrame:
    """Embeds every whole turn with a stand-in model, one row per component."""
    vectors = embed(t["v_chunks"].select("chunk_id", "content_markdown"), letter_encoder)
    return vectors.select("chunk_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


def letter_encoder():
    """Stand-in model: counts of the letters a to z."""
    import numpy as np

    def encode(texts: list[str]):
        return np.array([[x.count(letter) for letter in _LETTERS] for x in texts], dtype=np.float32)

    return encode


# ── LaTeX and math text ────────────────────────────────────────────────────

_FIX = "regexp_replace({}, '(^|[^\\\\A-Za-z])({})([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\\\\\2\\3', 'g')"
_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _fix_sql(inner: str, words: str) -> str:
    return _FIX.format(_FIX.format(inner, words), words)


@register("fn_sanitize_latex", f"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text, {_WS}),
                 '^(?:\\s*(?:\\$\\$|\\$|\\\\\\[|\\\\\\()\\s*)+', ''),
                 '(?:\\s*(?:\\$\\$|\\$|\\\\\\]|\\\\\\)))+\\s*$', '') AS x FROM @documents)
    SELECT doc_id, trim(regexp_replace({_fix_sql('x', '|'.join(latex.SANITIZE_COMMANDS))}, '\\\\+\\s*$', ''), {_WS})
           AS cleaned FROM a""")
def fn_sanitize_latex(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", latex.sanitize_latex(T()).alias("cleaned"))


@register("fn_repair_latex", f"""
    SELECT doc_id, {_fix_sql(f'trim(text, {_WS})', '|'.join(latex.REPAIR_WORDS))} AS repaired FROM @documents""")
def fn_repair_latex(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", latex.repair_latex(T()).alias("repaired"))


@register("fn_clean_math", f"""
    SELECT doc_id, trim(replace(replace(replace(text, '،', ','), '؛', ';'), '$', ''), {_WS}) AS cleaned
    FROM @documents""")
def fn_clean_math(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", latex.clean_math(T()).alias("cleaned"))


@register("fn_self_heal", """
    SELECT doc_id, regexp_replace(text, '_{5,}', ' $\\\\dots$ ', 'g') AS healed FROM @documents""")
def fn_self_heal(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", latex.self_heal(T()).alias("healed"))


@register("fn_protect_math")
def fn_protect_math(t: Tables) -> DataFrame:
    """Math blocks moved out of every text (RE2 lacks the look-ahead)."""
    found = t["documents"].select("doc_id", latex.protect_math(T()).alias("p"))
    return found.select("doc_id", F.size("p.blocks").alias("blocks"), F.length("p.text").alias("chars"))


# ── anchors ────────────────────────────────────────────────────────────────

_MARK = "'![fig](asset://artifacts/' || CAST(chunk_id AS STRING) || ')'"


@register("fn_split_anchors", f"""
    WITH a AS (SELECT chunk_id, content_markdown AS body, section_title AS tail FROM @v_chunks)
    SELECT chunk_id, 0 AS pos, 'markdown' AS kind, CAST(NULL AS STRING) AS id, CAST(length(body) AS INT) AS chars FROM a
    UNION ALL SELECT chunk_id, 1, 'artifact', CAST(chunk_id AS STRING), NULL FROM a
    UNION ALL SELECT chunk_id, 2, 'markdown', NULL, CAST(length(tail) AS INT) FROM a WHERE tail <> ''""")
def fn_split_anchors(t: Tables) -> DataFrame:
    joined = F.concat(B(), F.expr(_MARK), F.coalesce("section_title", F.lit("")))
    parts = t["v_chunks"].select("chunk_id", F.posexplode(tx.split_anchors(joined)).alias("pos", "s"))
    return parts.select("chunk_id", "pos", "s.kind", "s.id", F.length("s.text").alias("chars"))


def _anchor() -> F.Column:
    return F.struct(
        F.col("chunk_id").cast("string").alias("id"), F.lit("fig").alias("caption"),
        (F.col("page_number") * 400).cast("double").alias("y0"), F.lit(0.0).alias("x0"),
    )


@register("fn_anchor_markers", f"""
    SELECT chunk_id, content_markdown || chr(10) || {_MARK} || chr(10) || '' || chr(10) AS anchored FROM @v_chunks""")
def fn_anchor_markers(t: Tables) -> DataFrame:
    marked = F.concat(B(), F.lit("\n [[FIGURE:1]]\n[[FIGURE:2]] \n"))
    got = anchoring.anchor_markers(marked, F.array(_anchor()))
    return t["v_chunks"].select("chunk_id", got["text"].alias("anchored"))


_BREAK = "strpos(content_markdown, chr(10) || chr(10))"


@register("fn_anchor_nearest", f"""
    SELECT chunk_id, CASE WHEN {_BREAK} > 0
           THEN left(content_markdown, {_BREAK} - 1) || chr(10) || chr(10) || {_MARK} || chr(10) || chr(10)
                || substring(content_markdown, {_BREAK})
           ELSE content_markdown || chr(10) || chr(10) || {_MARK} || chr(10) || chr(10) END AS anchored FROM @v_chunks""")
def fn_anchor_nearest(t: Tables) -> DataFrame:
    got = anchoring.anchor_nearest(B(), F.array(_anchor()), F.lit(3508))
    return t["v_chunks"].select("chunk_id", got.alias("anchored"))


@register("fn_anchor_safe", f"""
    SELECT chunk_id, CASE WHEN {_BREAK} > 0
           THEN left(content_markdown, {_BREAK} - 1) || chr(10) || chr(10) || {_MARK} || substring(content_markdown, {_BREAK})
           ELSE content_markdown || chr(10) || chr(10) || {_MARK} END AS anchored FROM @v_chunks""")
def fn_anchor_safe(t: Tables) -> DataFrame:
    return t["v_chunks"].select("chunk_id", anchoring.anchor_safe(B(), _anchor(), F.lit(3508)).alias("anchored"))


# ── artifact answers, built from the events table in both dialects ─────────

_K = "CAST(event_id % 150 AS STRING)"
_POINTS = f"""'{{"min": 0, "max": 100, "step": "' || CASE WHEN event_id % 5 = 0 THEN '0' ELSE '2.5' END || '", "points": ['
    || '{{"label": "A", "value": ' || {_K} || '}}, {{"label": "B", "value": true}}, {{"label": "", "value": 3}}], '
    || '"highlight_segments": [[8, 3], [2, ' || {_K} || ']]}}'"""
_GRID = f"""'{{"rows": ' || CAST(event_id % 25 AS STRING) || ', "cols": 4, "cells": [{{"count": ' || {_K}
    || ', "color": " Green "}}, {{"count": 1, "color": "pink"}}]}}'"""


@register("fn_valid_number_line", """
    WITH k AS (SELECT event_id, event_id % 5 > 0 AND event_id % 150 <= 100 AS ok, event_id % 150 AS v FROM @events)
    SELECT event_id, CASE WHEN ok THEN CAST(v AS DOUBLE) END AS point,
           CASE WHEN ok AND v >= 2 THEN 1 WHEN ok THEN 0 END AS segments FROM k""")
def fn_valid_number_line(t: Tables) -> DataFrame:
    made = t["events"].select("event_id", art.valid_number_line(F.try_parse_json(F.expr(_POINTS))).alias("j"))
    shape = "struct<points:array<struct<label:string,value:double>>,highlight_segments:array<array<double>>>"
    back = made.select("event_id", F.from_json("j", shape).alias("o"))
    ok = F.col("o").isNotNull()
    return back.select(
        "event_id", F.get("o.points", F.lit(0))["value"].alias("point"),
        F.when(ok, F.coalesce(F.when(F.col("o.highlight_segments").isNotNull(), F.size("o.highlight_segments")), F.lit(0)))
        .alias("segments"),
    )


@register("fn_valid_decimal_grid", """
    WITH k AS (SELECT event_id, event_id % 25 AS r, event_id % 150 AS c FROM @events)
    SELECT event_id, CASE WHEN r BETWEEN 1 AND 20 AND c <= r * 4 THEN '[{"count":' || CAST(c AS STRING) || ',"color":"green"}]' END
           AS cells FROM k""")
def fn_valid_decimal_grid(t: Tables) -> DataFrame:
    made = art.valid_decimal_grid(F.try_parse_json(F.expr(_GRID)))
    return t["events"].select("event_id", F.get_json_object(made, "$.cells").alias("cells"))


@register("fn_valid_plotly", """
    SELECT event_id, CAST(event_id % 3 = 0 AS INT) AS valid FROM @events""")
def fn_valid_plotly(t: Tables) -> DataFrame:
    answer = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"data": [' || props || ']}' WHEN 1 THEN '{"data": []}' ELSE props END""")
    return t["events"].select(
        "event_id", art.valid_plotly(F.try_parse_json(answer)).isNotNull().cast("int").alias("valid")
    )


@register("fn_valid_svg", """
    SELECT page_id, CAST(regexp_matches(html, '<svg\\b[^>]*>.*</svg>', 'is')
           AND strlen(html) < 204800 AS INT) AS valid FROM @pages""")
def fn_valid_svg(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", art.valid_svg(F.col("html")).cast("int").alias("valid"))


@register("fn_as_number", """
    SELECT event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS number
    FROM @events""")
def fn_as_number(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 4 == 1, "true").when(F.col("event_id") % 4 == 2, F.concat(F.lit('" '), k, F.lit(' "'))).otherwise(k)
    return t["events"].select("event_id", art.number_of(F.try_parse_json(text)).alias("number"))


_ANSWER = """'Here: {"type": "' || CASE event_id % 5 WHEN 0 THEN 'geometry' WHEN 1 THEN 'code' WHEN 2 THEN 'matrix'
    WHEN 3 THEN 'table' ELSE 'photo' END || '", "semantic": "' || CASE WHEN event_id % 2 = 0 THEN 'Illustration' ELSE 'x' END
    || '", "caption_ar": "' || event_type || '", "svg": "<svg>x</svg>", "code": "k=1", "latex": "$k$", "markdown": "' ||
    CASE WHEN event_id % 7 = 0 THEN '' ELSE '|a|' END || '"} and more }'"""
_TYPES = """CASE event_id % 5 WHEN 0 THEN 'geometry_vector' WHEN 1 THEN 'code_snippet' WHEN 2 THEN 'matrix'
    WHEN 3 THEN CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'data_table' END END"""
_RAW = """CASE event_id % 5 WHEN 0 THEN '<svg>x</svg>' WHEN 1 THEN 'k=1' WHEN 2 THEN '$$k$$'
    WHEN 3 THEN CASE WHEN event_id % 7 = 0 THEN NULL ELSE '|a|' END END"""


def _mapped(t: Tables) -> DataFrame:
    found = t["events"].withColumn("j", art.first_json(F.expr(_ANSWER)))
    return found.select("event_id", art.map_answer(F.col("j")).alias("a")).select("event_id", "a.*")


@register("fn_first_json", """
    SELECT event_type, count(*) AS n FROM @events GROUP BY event_type""")
def fn_first_json(t: Tables) -> DataFrame:
    found = t["events"].withColumn("j", art.first_json(F.expr(_ANSWER)))
    return found.groupBy(F.get_json_object("j", "$.caption_ar").alias("event_type")).agg(F.count("*").alias("n"))


@register("fn_map_artifact", f"""
    SELECT event_id, {_TYPES} AS artifact_type, {_RAW} AS raw_data, event_type AS caption,
           CASE WHEN {_TYPES} IS NULL THEN event_type ELSE event_type || ' ' || {_RAW} END AS searchable_text,
           CASE WHEN event_id % 2 = 0 THEN 'illustration' END AS semantic FROM @events""")
def fn_map_artifact(t: Tables) -> DataFrame:
    return _mapped(t).drop("render_config_json")


@register("fn_semantic", """
    SELECT CASE WHEN event_id % 2 = 0 THEN 'illustration' END AS semantic, count(*) AS n FROM @events GROUP BY 1""")
def fn_semantic(t: Tables) -> DataFrame:
    return _mapped(t).groupBy("semantic").agg(F.count("*").alias("n"))


@register("fn_render_family", """
    SELECT artifact_id, CASE WHEN artifact_id % 2 = 0 THEN 'dense_illustration'
           WHEN artifact_type = 'geometry_vector' THEN 'geometry_vector' WHEN artifact_type = 'latex_formula' THEN 'matrix'
           WHEN artifact_type = 'data_table' THEN 'data_table' ELSE 'dense_illustration' END AS family FROM @b_artifacts""")
def fn_render_family(t: Tables) -> DataFrame:
    renderer = F.when(F.col("artifact_id") % 2 == 0, F.get_json_object("render_config_json", "$.renderer"))
    return t["b_artifacts"].select("artifact_id", art.render_family(renderer, F.col("artifact_type")).alias("family"))


@register("fn_competencies", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || chr(10) || event_type WHEN 1 THEN 'b' || chr(10) || event_type
           ELSE event_type END AS text FROM @events""")
def fn_competencies(t: Tables) -> DataFrame:
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN '["a", "' || event_type || '"]'
        WHEN 1 THEN '{"x": 1, "items": ["b", "' || event_type || '"]}' ELSE ' ' || event_type END""")
    return t["events"].select("event_id", tx.competencies(raw).alias("text"))


_TABLE = """'| key | value |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || event_type || ' | ' || CAST(event_id AS STRING)
    || '٫5 |' || chr(10) || '| short |' || chr(10) || 'no pipe'"""


@register("fn_md_table", """
    SELECT event_id AS artifact_id, 0 AS row_no, 0 AS col_no, 'key' AS header, event_type AS cell FROM @events
    UNION ALL SELECT event_id, 0, 1, 'value', CAST(event_id AS STRING) || '٫5' FROM @events
    UNION ALL SELECT event_id, 1, 0, 'key', 'short' FROM @events
    UNION ALL SELECT event_id, 1, 1, 'value', '' FROM @events""")
def fn_md_table(t: Tables) -> DataFrame:
    tables = t["events"].select(F.col("event_id").alias("artifact_id"), F.expr(_TABLE).alias("raw_data"))
    return tab.table_cells(tables).drop("number")


@register("top_table_sort", """
    WITH c AS (SELECT event_id, event_type, CAST(event_id AS STRING) || '.5' AS cell FROM @events)
    SELECT event_id AS artifact_id, CAST(cell AS DOUBLE) AS number,
           row_number() OVER (PARTITION BY event_type ORDER BY CAST(cell AS DOUBLE), event_id) AS position FROM c""")
def top_table_sort(t: Tables) -> DataFrame:
    """Numeric position of each value cell among the cells of its kind."""
    from foliospark.operators.scans import position_by

    tables = t["events"].select(F.col("event_id").alias("artifact_id"), F.expr(_TABLE).alias("raw_data"))
    cells = tab.table_cells(tables)
    keys = cells.where("row_no = 0 and col_no = 0").select("artifact_id", F.col("cell").alias("kind"))
    values = cells.where("row_no = 0 and col_no = 1").select("artifact_id", "number").join(keys, "artifact_id")
    ranked = position_by(values, ["kind"], [F.col("number"), F.col("artifact_id")], "position")
    return ranked.select("artifact_id", "number", "position")


@register("fn_context_block", """
    SELECT chunk_id, '[Doc: doc | Page: ' || CAST(page_number AS STRING) || ' | Section: ' || coalesce(section_title, '-')
           || ' | Type: ' || pedagogical_type || ']' || chr(10) || content_markdown AS block FROM @v_chunks""")
def fn_context_block(t: Tables) -> DataFrame:
    block = tx.context_block(F.lit("doc"), F.col("page_number"), F.col("section_title"), F.col("pedagogical_type"), B())
    return t["v_chunks"].select("chunk_id", block.alias("block"))


@register("fn_block_type", """
    SELECT CASE WHEN artifact_type = 'data_table' THEN 'table' WHEN artifact_type = 'latex_formula' THEN 'formula'
           ELSE 'text' END AS block_type, count(*) AS n FROM @b_artifacts GROUP BY 1""")
def fn_block_type(t: Tables) -> DataFrame:
    return t["b_artifacts"].groupBy(tx.block_type(F.upper("artifact_type")).alias("block_type")).agg(F.count("*").alias("n"))


@register("fn_page_from_name", """
    SELECT page_id, CASE WHEN page_id > 0 AND page_id % 3 < 2 THEN CAST(page_id AS INT) END AS page_number FROM @pages""")
def fn_page_from_name(t: Tables) -> DataFrame:
    name = F.expr("""CASE page_id % 3 WHEN 0 THEN 'scan/page_0' || page_id || '.JPG' WHEN 1 THEN 'Page_' || page_id || '.webp'
        ELSE 'page_' || page_id || '.gif' END""")
    return t["pages"].select("page_id", tx.page_from_name(name).alias("page_number"))
