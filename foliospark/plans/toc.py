"""Tables of contents: headings to entries, parents, page ends, chunk links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from foliospark.functions.text import headings
from foliospark.operators.joins import chunk_toc
from foliospark.operators.scans import row_number_by, running_count, running_last
from foliospark.session import checkpointed

LEVELS = (1, 2, 3)


def heading_rows(chunks: DataFrame) -> DataFrame:
    """Chunks that hold headings, with their ordered ``hs`` array."""
    found = chunks.where(F.col("content_markdown").contains("#")).select(
        "document_id", "page_number", "chunk_index", headings(F.col("content_markdown")).alias("hs")
    )
    return found.where(F.size("hs") > 0)


def fresh_starts(rows: DataFrame) -> DataFrame:
    """Cut documents where the memory of the fold below is known to be empty.

    A chunk whose only heading is a level-one title that differs from the one
    its predecessor (also a lone level-one title) left behind is accepted
    whatever came before, and clears level two.  A run may start there, so a
    large document spreads over many runs.
    """
    place = ["page_number", "chunk_index"]
    block = F.floor(F.col("page_number") / 64)
    first = F.get("hs", F.lit(0))
    lone = (F.size("hs") == 1) & (first["level"] == 1)
    before = running_last(
        rows, ["document_id"], place, block,
        {"_prev": F.struct(lone.alias("lone"), first["title"].alias("title"))}, inclusive=False,
    )
    cut = F.coalesce(lone & F.col("_prev.lone") & (first["title"] != F.col("_prev.title")), F.lit(False))
    return running_count(before, ["document_id"], place, block, cut, "_run").drop("_prev")


def toc_entries(rows: DataFrame) -> DataFrame:
    """First accepted heading of each chunk: a heading equal to the last title
    of its level is skipped, a new level-one title resets level two.

    The memory runs in document order.  Runs that need no memory of what came
    before stream side by side, row by row, with two titles of state.
    """

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, {}
        for batch in batches:
            out = []
            for doc, run, page, idx, hs in zip(
                batch["document_id"], batch["_run"], batch["page_number"], batch["chunk_index"], batch["hs"]
            ):
                if (doc, run) != current:
                    current, last = (doc, run), {}
                for h in hs:
                    level, title = h["level"], h["title"]
                    if title == last.get(level):
                        continue
                    last[level] = title
                    if level == 1:
                        last.pop(2, None)
                    out.append((doc, page, idx, level, title))
                    break
            yield pd.DataFrame(out, columns=["document_id", "page_number", "chunk_index", "level", "title"])

    kind = rows.schema["document_id"].dataType.simpleString()
    return (
        fresh_starts(rows)
        .repartition("document_id", "_run")
        .sortWithinPartitions("document_id", "_run", "page_number", "chunk_index")
        .mapInPandas(
            accept, f"document_id {kind}, page_number int, chunk_index int, level int, title string"
        )
    )


def number_entries(entries: DataFrame) -> DataFrame:
    """Document order as ``ord`` and a stable id."""
    ranked = row_number_by(
        entries, ["document_id"], [F.col("page_number"), F.col("chunk_index")],
        F.floor(F.col("page_number") / 64), "ord",
    )
    return ranked.withColumn(
        "toc_id", F.sha2(F.concat_ws(":", F.lit("toc"), F.col("document_id").cast("string"), F.col("ord").cast("string")), 256)
    )


def toc_parents(entries: DataFrame) -> DataFrame:
    """Parent of a level-two entry: the most recent level-one entry."""
    known = running_last(
        entries, ["document_id"], ["ord"], F.floor(F.col("ord") / 4096),
        {"_l1": F.when(F.col("level") == 1, F.col("toc_id"))},
    )
    return known.withColumn("parent_id", F.when(F.col("level") == 2, F.col("_l1"))).drop("_l1")


def _next_starts(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """For each start page of a document, the next later page that starts an
    entry of at most each level.

    Entries collapse to distinct pages first, and pages are scanned in blocks.
    """
    pages = entries.groupBy("document_id", F.col("page_start").alias("page")).agg(F.min("level").alias("lv"))
    return running_last(
        pages, ["document_id"], ["page"], -F.floor(F.col("page") / 256),
        {f"n{level}": F.when(F.col("lv") <= level, F.col("page")) for level in LEVELS},
        inclusive=False, descending=True, tasks=tasks,
    )


def _by_level(prefix: str):
    out = None
    for level in LEVELS:
        out = (F if out is None else out).when(F.col("level") == level, F.col(f"{prefix}{level}"))
    return out


def toc_page_ends(entries: DataFrame, documents: DataFrame, tasks: int | None = None) -> DataFrame:
    """End page of entries sorted by page: one before the next entry of the
    same or a higher level that starts later, else the end of the document;
    never before the start nor past the document.  ``tasks`` deals the rows out to that many tasks at each step."""
    totals = documents.select("document_id", "total_pages")
    dealt = lambda df, *keys: df if tasks is None else df.repartition(tasks, *keys)
    starts = _next_starts(entries, tasks).select(
        "document_id", F.col("page").alias("page_start"), *[f"n{level}" for level in LEVELS]
    )
    page = ["document_id", "page_start"]
    placed = dealt(entries, *page).join(dealt(starts, *page), page)
    joined = dealt(placed, "document_id").join(totals, "document_id", "left")
    total = F.coalesce("total_pages", "page_start")
    end = F.coalesce(_by_level("n") - 1, total)
    return joined.select(
        *entries.columns, F.greatest(F.col("page_start"), F.least(end, total)).cast("int").alias("page_end")
    )


def native_page_ends(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """End page of outline entries, whose pages may go back: the next entry
    *in outline order* of the same or a higher level with a later page ends it.

    Read from the end of the outline, the candidates of each level form a
    stack of ever larger pages; that stack is the whole state.
    """
    totals = documents.select("document_id", "total_pages")
    joined = entries.join(totals, "document_id", "left").withColumn("_neg", -F.col("ord"))
    names = entries.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, stacks = None, {}
        for batch in batches:
            ends = []
            for doc, level, page, total in zip(
                batch["document_id"], batch["level"], batch["page_start"], batch["total_pages"]
            ):
                if doc != document:
                    document, stacks = doc, {lv: [] for lv in LEVELS}
                stack = stacks[level]
                while stack and stack[-1] <= page:
                    stack.pop()
                limit = page if pd.isna(total) else int(total)
                end = stack[-1] - 1 if stack else limit
                ends.append(max(page, min(end, limit)))
                for lv in LEVELS:
                    if level <= lv:
                        own = stacks[lv]
                        while own and own[-1] <= page:
                            own.pop()
                        own.append(page)
            yield batch[names].assign(page_end=ends)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", page_end int"
    return (
        joined.repartition("document_id").sortWithinPartitions("document_id", "_neg").mapInPandas(scan, schema)
    )


def reliable_page_ends(toc: DataFrame) -> DataFrame:
    """Stored end where it is coherent with the next boundary (level at most
    mine, start not before mine, in outline order), recomputed elsewhere.

    For entries sorted by (page_start, ord) the next boundary is the nearest
    following one; the last start page of the document bounds everything.
    """
    ceiling = toc.groupBy("document_id").agg(F.max("page_start").alias("_max"))
    df = running_last(
        toc, ["document_id"], ["page_start", "ord"], -F.floor(F.col("page_start") / 256),
        {f"n{level}": F.when(F.col("level") <= level, F.col("page_start")) for level in LEVELS},
        inclusive=False, descending=True,
    )
    joined = df.join(ceiling, "document_id")
    nxt = _by_level("n")
    limit = F.when(nxt.isNotNull(), F.least(nxt - 1, F.col("_max"))).otherwise(F.col("_max"))
    kept = F.col("page_end").between(F.col("page_start"), limit)
    return joined.select(
        *[c for c in toc.columns if c != "page_end"],
        F.when(kept, F.col("page_end")).otherwise(F.greatest(F.col("page_start"), limit)).cast("int").alias("page_end"),
    )


def toc_of_headings(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Derived contents from the rows of ``heading_rows``; no text is read."""
    entries = checkpointed(number_entries(checkpointed(toc_entries(found))))
    placed = toc_parents(entries.withColumnRenamed("page_number", "page_start").drop("chunk_index"))
    return toc_page_ends(placed, documents)


def build_toc(chunks: DataFrame, documents: DataFrame, native: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Derived contents of every document and the chunks tied to them; a full
    rebuild that never touches documents with a native outline."""
    if native is not None:
        outlined = native.select("document_id").distinct()
        derived_from = chunks.join(outlined, "document_id", "left_anti")
    else:
        derived_from = chunks
    # Entries are a sliver of the text they come from and are read many times.
    toc = toc_of_headings(checkpointed(heading_rows(derived_from)), documents)
    return toc, chunk_toc(derived_from, toc)


def course_units(toc: DataFrame, links: DataFrame, documents: DataFrame, indexes: DataFrame | None = None) -> DataFrame:
    """Chapters with a reliable page range, lesson number, program and number
    of exercises; a document without chapters becomes one unit itself."""
    ends = reliable_page_ends(toc).where("level = 1")
    numbered = row_number_by(
        ends, ["document_id"], [F.col("page_start"), F.col("ord")], F.floor(F.col("page_start") / 64), "_rank"
    )
    if indexes is not None:
        numbered = numbered.join(indexes.select("toc_id", "lesson_index"), "toc_id", "left")
    else:
        numbered = numbered.withColumn("lesson_index", F.lit(None).cast("long"))
    program = links.where("link_type = 'course_program'").groupBy(F.col("from_id").alias("unit_id")).agg(
        F.min_by("to_id", "link_id").alias("program_id")
    )
    count = links.where("link_type = 'course_exercise'").groupBy(F.col("from_id").alias("unit_id")).agg(
        F.count("*").alias("exercises_count")
    )
    chapters = (
        numbered.withColumn("unit_id", F.col("toc_id").cast("string"))
        .join(program, "unit_id", "left").join(count, "unit_id", "left").select(
            "document_id", "unit_id", "title", "page_start", "page_end",
            F.coalesce("lesson_index", "_rank").alias("lesson_number"), F.col("program_id").cast("string").alias("program_id"),
            F.coalesce("exercises_count", F.lit(0)).alias("exercises_count"),
        )
    )
    bare = documents.join(ends.select("document_id").distinct(), "document_id", "left_anti").select(
        "document_id", F.concat(F.lit("doc_"), F.col("document_id").cast("string")).alias("unit_id"), "title",
        F.lit(1).cast("int").alias("page_start"), F.greatest(F.lit(1), F.coalesce("total_pages", F.lit(1))).cast("int").alias("page_end"),
        F.lit(1).cast("long").alias("lesson_number"), F.lit(None).cast("string").alias("program_id"),
        F.lit(0).cast("long").alias("exercises_count"),
    )
    return chapters.unionByName(bare)
