"""Text columns: folding, tokens, headings, formulas, anchors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: vowel marks, superscript alef and tatweel.
HARAKAT = "".join(map(chr, range(0x064B, 0x0653))) + "\u0670\u0640"
# Fixed value: characters that separate index tokens.
TOKEN_GAP = r"[^\p{L}\p{N}\p{Co}]+"
WHITESPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"
ANCHOR = r"!\[([^\]]*)\]\(asset://artifacts/([^)\s]+)\)"
FORMULA = r"(?s)\$\$(.+?)\$\$|\$([^$\n]{2,200})\$"


def _accent_rule() -> tuple[str, str]:
    """Every lower-case Latin letter that decomposes to ASCII plus marks."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and "a" <= parts[0] <= "z" and all(unicodedata.combining(m) for m in parts[1:]):
            source.append(letter)
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_rule()
COMBINING = "".join(map(chr, range(0x0300, 0x0332)))


def fold_pair(arabic_fold: bool = True) -> tuple[str, str]:
    """(from, to) for ``translate``; characters past the end of *to* are dropped."""
    return ACCENTED + COMBINING + (HARAKAT if arabic_fold else ""), PLAIN


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once for each row however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def occurrences(c: Column, needle: str) -> Column:
    """Non-overlapping count of a literal, without a regex."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def strip_harakat(c: Column) -> Column:
    return F.regexp_replace(c, "[\u064B-\u0652\u0670\u0640]", "")


def fold(c: Column, arabic_fold: bool = True) -> Column:
    """Lower case without diacritics; pure ASCII text skips the character map."""
    source, target = fold_pair(arabic_fold)
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, source, target))


def tokens(c: Column, arabic_fold: bool = True) -> Column:
    return F.filter(F.split(fold(c, arabic_fold), TOKEN_GAP), lambda t: t != "")


def token_line(c: Column, arabic_fold: bool = True) -> Column:
    """Tokens written as ``' a  b  c '``: each keeps a space of its own on both
    sides, so a literal count of ``' a '`` is the exact term frequency.  A text
    without tokens gives blanks only."""
    folded = fold(F.coalesce(c, F.lit("")), arabic_fold)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(folded, TOKEN_GAP, "  ")), F.lit(" "))


def line_length(line: Column) -> Column:
    """Number of tokens of a token line."""
    return F.when(F.length(line) == 2, 0).otherwise(occurrences(line, "  ") + 1)


def phrase_count(line: Column, phrase: list[str]) -> Column:
    """Occurrences of consecutive tokens in a token line."""
    if len(phrase) == 1:
        return occurrences(line, f" {phrase[0]} ")
    return F.regexp_count(line, F.lit("(?= " + "  ".join(phrase) + " )"))


def fold_py(text: str, arabic_fold: bool = True) -> str:
    """Driver-side twin of :func:`fold`, for query strings only."""
    source, target = fold_pair(arabic_fold)
    table = {ord(s): (target[i] if i < len(target) else None) for i, s in enumerate(source)}
    return text.lower().translate(table)


def query_phrases(query: str, arabic_fold: bool = True) -> list[list[str]]:
    """User text to the OR-ed phrases of the index query: white-space terms,
    quotes removed, each term cut to its index tokens."""
    import regex

    phrases = []
    for term in query.split():
        parts = [p for p in regex.split(TOKEN_GAP, fold_py(term.replace('"', ""), arabic_fold)) if p]
        if parts and parts not in phrases:
            phrases.append(parts)
    return phrases


def token_len(c: Column) -> Column:
    """Estimated model tokens: four characters each, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def section_title(c: Column, max_chars: int | None = None) -> Column:
    """First heading of level one to three, cut to ``max_chars`` when given."""
    found = strip(F.regexp_extract(c, r"(?m)^#{1,3}\s+(.+)$", 1))
    found = found if max_chars is None else F.substring(found, 1, max_chars)
    return F.when(found != "", found)


def headings(c: Column, max_chars: int | None = None) -> Column:
    """Ordered ``array<struct<level,title>>`` of level-two and -three headings; lines of more than
    ``max_chars``, when given, are no headings."""
    pattern = r"(?m)^(#{2,3})\s+(.{3,%s})$" % ("" if max_chars is None else max_chars)
    marks = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(
        marks,
        names,
        lambda m, n: F.struct(
            F.when(F.length(m) == 2, 1).otherwise(2).alias("level"),
            F.btrim(F.regexp_replace(strip(n), r"(?U)\s+", " "), F.lit("*# ")).alias("title"),
        ),
    )
    return F.filter(pairs, lambda h: h["title"] != "")


def formulas(c: Column) -> Column:
    """``array<struct<n,latex,display>>``; ``n`` counts every match, short ones
    (fewer than two characters) are then dropped."""
    display = F.regexp_extract_all(c, F.lit(FORMULA), F.lit(1))
    inline = F.regexp_extract_all(c, F.lit(FORMULA), F.lit(2))
    both = F.zip_with(display, inline, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    ranked = F.transform(
        both,
        lambda m, k: F.struct(
            (k + 1).alias("n"),
            strip(F.when(m["d"] != "", m["d"]).otherwise(m["i"])).alias("latex"),
            (m["d"] != "").alias("display"),
        ),
    )
    return F.filter(ranked, lambda m: F.length(m["latex"]) >= 2)


def formula_raw(latex: Column, display: Column) -> Column:
    fence = F.when(display, "$$").otherwise("$")
    return F.concat(fence, latex, fence)


_LATIN = r"A-Za-z\u00C0-\u024F"
# Latin letters of the token class that are none of the plain vowels.
_NO_VOWEL = r"[A-Za-z\u00C0-\u024F&&[^aeiouyAEIOUY]]"


def unreadable(c: Column) -> Column:
    """Quality gate: blank, letterless, or Latin soup with too many short or
    vowelless tokens; substantial Arabic passes."""
    t = strip(c)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    # Greedy runs need no look-around to be counted whole.
    total, long = count(f"[{_LATIN}]+"), count(f"[{_LATIN}]{{4,}}")
    short = total - long
    vowelless = count(f"(?<![{_LATIN}]){_NO_VOWEL}{{4,}}+(?![{_LATIN}])")
    # Letters are counted one by one only where there is Arabic at all.
    arabic = count(r"[\u0600-\u06FF&&\p{L}]") >= count(r"\p{L}") * 0.3
    return (
        F.when(F.length(t) < 20, True)
        .when(~t.rlike(r"\p{L}"), True)
        .when(t.rlike(r"[\u0600-\u06FF]") & arabic, False)
        .when(total < 6, False)
        .otherwise((short > total * 0.55) | ((long > 0) & (vowelless > long * 0.4)))
    )


def split_anchors(c: Column) -> Column:
    """Text to ordered ``array<struct<kind,text,id,caption>>`` segments."""
    captions = F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(1))
    ids = F.regexp_extract_all(c, F.lit(ANCHOR), F.lit(2))
    null = F.lit(None).cast("string")

    def segment(kind, text, ident, caption):
        return F.struct(
            F.lit(kind).alias("kind"), text.alias("text"), ident.alias("id"), caption.alias("caption")
        )

    def around(part: Column, k: Column) -> Column:
        text = F.array(segment("markdown", part, null, null))
        anchor = F.array(segment("artifact", null, F.get(ids, k), F.get(captions, k)))
        none = F.slice(text, 1, 0)
        return F.concat(
            F.when(part != "", text).otherwise(none), F.when(k < F.size(ids), anchor).otherwise(none)
        )

    return F.flatten(F.transform(F.split(c, ANCHOR), around))


def contains_all_tokens(hay: Column, query: str) -> Column:
    """Every white-space token of the query occurs in the folded text."""
    folded = fold(hay)
    check = F.lit(True)
    for token in fold_py(query).split():
        check = check & folded.contains(token)
    return check


def contains_ci(fields: list[Column], query: str) -> Column:
    return F.lower(F.concat_ws(" ", *fields)).contains(query.lower())


def context_block(title: Column, page: Column, section: Column, kind: Column, body: Column) -> Column:
    dash = lambda c: F.when(c.isNull() | (c == ""), "-").otherwise(c)
    return F.format_string(
        "[Doc: %s | Page: %s | Section: %s | Type: %s]\n%s",
        title, page.cast("string"), dash(section), dash(kind), body,
    )


def block_type(layout_class: Column) -> Column:
    low = F.lower(layout_class)
    return (
        F.when(low.contains("table"), "table")
        .when(low.contains("equation") | low.contains("formula"), "formula")
        .when(low.contains("figure") | low.contains("image"), "image")
        .otherwise("text")
    )


def page_from_name(name: Column) -> Column:
    """Page number of ``page_012.jpg``; null when absent or not positive."""
    page = F.regexp_extract(name, r"(?i)page_(\d+)\.(?:jpg|jpeg|png|webp)$", 1).try_cast("int")
    return F.when(page > 0, page)


def competencies(raw: Column) -> Column:
    """JSON list, JSON object holding a list, or plain text, as one text with
    a line per entry."""
    text = strip(raw)
    value = F.try_parse_json(text)
    as_list = lambda path: F.try_variant_get(value, path, "array<string>")
    listed = F.coalesce(
        as_list("$"), as_list("$.ressources"), as_list("$.competencies"), as_list("$.items"), as_list("$.values")
    )
    entries = F.try_variant_get(value, "$", "map<string,string>")
    return (
        F.when(text.isNull() | (text == ""), "")
        .when(~F.substring(text, 1, 1).isin("[", "{"), text)
        .when(listed.isNotNull(), F.array_join(listed, "\n"))
        .when(entries.isNotNull(), F.array_join(F.map_values(entries), "\n"))
        .otherwise(text)
    )
