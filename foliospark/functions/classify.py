"""Pedagogical type of a chunk.  The pattern table is data: pass your own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliospark.functions.text import strip, strip_harakat

# Arabic ordinal words.
ORDINALS = {
    "الأول": 1, "الاول": 1, "الثاني": 2, "الثالث": 3, "الرابع": 4, "الخامس": 5,
    "السادس": 6, "السابع": 7, "الثامن": 8, "التاسع": 9, "العاشر": 10,
}
_ORD = "|".join(ORDINALS)
_HEAD = r"(?:^|\n)\s*[#>*\-|\s]*"
_NUMBER_SIGN = r"(?:n?[°ºo]\s*)?"

# A text without any character of this block cannot match an Arabic pattern.
ARABIC = "[\u0600-\u06FF]"

# Ordered patterns, the first that matches decides.  Group 1,
# where present, holds the index (digits or an ordinal word).  A third entry
# is a cheap test that any match implies.
PATTERNS: list[tuple[str, ...]] = [
    ("solution_only", r"(?iU)" + _HEAD + r"(?:Solution|Corrigé|Corrige|Correction)\b\s*(?:de\s+l['’]exercice\s*)?" + _NUMBER_SIGN + r"(\d{1,3})?"),
    ("solution_only", r"(?U)(?:الحل|التصحيح|حل|تصحيح)\s+(?:ال)?(?:تمرين|تمارين|فرض|اختبار|مسألة|نشاط)\s+(" + _ORD + r")\b", ARABIC),
    ("solution_only", r"(?U)(?:الحل|التصحيح|حل|تصحيح)\s*(?:ال)?(?:تمرين|تمارين|فرض|اختبار|مسألة|نشاط)?\s*(?:رقم\s*)?(\d{1,3})?", ARABIC),
    ("solution_only", r"(?U)(?:الحلول|التصحيحات|حلول\s+التمارين|تصحيح\s+التمارين)", ARABIC),
    ("evaluation_exam", r"(?iU)" + _HEAD + r"(?:Devoir|Composition|Examen|Contrôle|Controle|BEM|BAC)\b"),
    ("evaluation_exam", r"(?U)" + _HEAD + r"(?:ال)?(?:فرض|اختبار|امتحان|تقويم|الوضعية\s+الإدماجية|إدماج)\b", ARABIC),
    ("exercise_unsolved", r"(?iU)" + _HEAD + r"(?:Exercice|Exercise|Problem|Activité|Activite)\s*" + _NUMBER_SIGN + r"(\d{1,3})"),
    ("exercise_unsolved", r"(?U)(?:ال)?(?:تمرين|تمارين|مسألة|نشاط|أنشطة|وضعية)\s+(" + _ORD + r")\b", ARABIC),
    ("exercise_unsolved", r"(?U)(?:ال)?(?:تمرين|تمارين|مسألة|نشاط|أنشطة|وضعية)\s*(?:رقم\s*)?(\d{1,3})", ARABIC),
    ("exercise_unsolved", r"(?U)(?:^|\n|\||#|\s)(?:ال)?(?:تمرين|تمارين|أنشطة|نشاط|وضعية|أتدرب|أتمرن|أطبق|أوظف|أنجز)\b", ARABIC),
    ("proof_demonstration", r"(?iU)" + _HEAD + r"(?:Démonstration|Demonstration|Preuve|Proof)\b"),
    ("proof_demonstration", r"(?U)(?:برهان|إثبات|أبرهن)", ARABIC),
    ("practical_work", r"(?iU)" + _HEAD + r"(?:TP|Travaux\s+pratiques|Manipulation)\b"),
    ("practical_work", r"(?U)(?:عمل\s*تطبيقي|أنشطة\s*تطبيقية)", ARABIC),
    ("course_theory", r"(?iU)" + _HEAD + r"(?:Définition|Definition|Théorème|Theoreme|Propriété|Propriete|Règle|Regle|Cours|Leçon|Lecon)\b"),
    ("course_theory", r"(?U)(?:تعريف|مبرهنة|خاصية|قاعدة|الدرس|أتعلم|أكتشف|أتذكر|أستحضر|أتحقق|مكتسباتي)", ARABIC),
]

# Opening words that suggest a type where none is declared.
EXERCISE_MARKERS = ["تمرين", "تمارين", "التمرين", "نشاط", "أنشطة", "النشاط", "تطبيق"]
SOLUTION_MARKERS = ["الحل", "الحلول", "التصحيح", "حل التمرين", "الإجابة النموذجية", "عناصر الإجابة"]
EXAM_MARKERS = ["الفرض", "الاختبار", "الامتحان", "التقويم", "المراقبة المستمرة", "الوضعية الإدماجية"]


def _has_group(pattern: str) -> bool:
    import regex

    return regex.compile(regex.sub(r"^\(\?[iU]+\)", "", pattern)).groups > 0


def pattern_no(text: Column, patterns: list[tuple[str, ...]], hints: dict[str, Column]) -> Column:
    """Position of the first matching pattern; the text must be cleaned."""
    branches = None
    for n, (_, pattern, *hint) in enumerate(patterns):
        test = text.rlike(pattern)
        if hint:
            test = hints[hint[0]] & test
        branches = (F if branches is None else branches).when(test, F.lit(n))
    return branches


# Arabic-Indic and eastern Arabic-Indic digits.
DIGITS = "".join(chr(base + n) for base in (0x660, 0x6F0) for n in range(10))


def qualify(c: Column, patterns: list[tuple[str, ...]] = PATTERNS) -> Column:
    """``struct<pedagogical_type,pedagogical_index>``, nulls where nothing matches.

    Cleaning, hints and the winning pattern are found once per row; the
    winner's group is then read once.
    """
    hints = sorted({hint for _, _, *rest in patterns for hint in rest})

    def find(row: Column) -> Column:
        flags = {h: row[f"h{i}"] for i, h in enumerate(hints)}
        return F.struct(row["t"].alias("t"), pattern_no(row["t"], patterns, flags).alias("n"))

    def decide(row: Column) -> Column:
        kind = word = None
        for n, (name, pattern, *_) in enumerate(patterns):
            hit = row["n"] == n
            kind = (F if kind is None else kind).when(hit, F.lit(name))
            if _has_group(pattern):
                word = (F if word is None else word).when(hit, F.regexp_extract(row["t"], pattern, 1))
        word = F.lit(None).cast("string") if word is None else word
        ordinal = F.coalesce(
            *[F.when(word == w, i) for w, i in ORDINALS.items()], F.translate(word, DIGITS, "0123456789" * 2).try_cast("int"))
        return F.struct(kind.alias("pedagogical_type"), ordinal.alias("pedagogical_index"))

    cleaned = F.array(strip_harakat(F.coalesce(c, F.lit(""))))
    flagged = F.transform(
        cleaned, lambda t: F.struct(t.alias("t"), *[t.rlike(h).alias(f"h{i}") for i, h in enumerate(hints)])
    )
    return F.get(F.transform(F.transform(flagged, find), decide), F.lit(0))


def strict_patterns() -> list[tuple[str, ...]]:
    """The table with word boundaries around the bare Arabic solution words."""
    out = []
    for kind, pattern, *hint in PATTERNS:
        if kind == "solution_only" and pattern.startswith("(?U)(?:الحل"):
            pattern = pattern.replace("(?U)(?:الحل", r"(?U)(?<!\p{L})(?:الحل", 1)
            if pattern.endswith(r"(\d{1,3})?"):
                pattern += r"(?!\p{L})"
        out.append((kind, pattern, *hint))
    return out


def effective_type(
    declared: Column, text: Column,
    markers: tuple[list[str], list[str], list[str]] = (EXAM_MARKERS, SOLUTION_MARKERS, EXERCISE_MARKERS),
) -> Column:
    """``struct<type,inferred>``: the declared type, else a marker among the
    first 40 characters once images and leading markup are blanked."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " ")
    head = F.substring(strip(F.regexp_replace(cleaned, r"[#>*_`~-]+", " ")), 1, 40)

    exam, solution, exercise = (head.rlike("|".join(words)) for words in markers)
    guess = (
        F.when(exam, "evaluation_exam").when(solution, "solution_only").when(exercise, "exercise_unsolved")
    )
    given = declared.isNotNull() & (declared != "")
    return F.struct(
        F.when(given, declared).otherwise(guess).alias("type"),
        (~given & guess.isNotNull()).alias("inferred"),
    )
