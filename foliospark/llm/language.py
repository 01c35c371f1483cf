"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Labelled documents the classifier is fitted on, at most in expectation and never over twice this.
SAMPLE = 2000
FEATURES = 4096
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
# Bytes of text scored at once; a text is never cut.
SLICE = 1 << 20
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in it; number signs such as a raised two are none."""
    return any(map(str.isalpha, text))


def ngram_slots(data: np.ndarray, order: int) -> np.ndarray:
    """Feature slot of the n-gram that starts at each byte but the last ``order - 1``."""
    count = len(data) - order + 1
    mixed = np.full(count, order * 374761393 & 0xFFFFFFFF, dtype=np.uint32)
    for n in range(order):
        mixed = (mixed ^ data[n:n + count]) * FACTORS[n]
        mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(FEATURES - 1)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes of all texts, each between blanks and closed by zeros, with starts and sizes."""
    coded = [b" " + t.lower().encode() + b" " for t in texts]
    pad = bytes(max(ORDERS))
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    starts = np.cumsum(np.r_[0, sizes[:-1] + len(pad)]) if len(coded) else np.zeros(0, np.int64)
    return np.frombuffer(pad.join(coded) + pad, dtype=np.uint8).astype(np.uint32), starts, sizes


def frequencies(texts: list[str]) -> np.ndarray:
    """N-gram frequencies of each text, every order weighing the same."""
    data, starts, sizes = joined(texts)
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for order in ORDERS:
        slots = ngram_slots(data, order)
        for row, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            out[row] += np.bincount(slots[start:start + size], minlength=FEATURES) / size
    return out


def decision_values(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``frequencies(texts) @ weights + bias`` without making the features."""
    out = np.zeros((len(texts), weights.shape[1]))
    data, starts, sizes = joined(texts)
    edges = np.column_stack([starts, starts + sizes]).ravel()
    for order in ORDERS:
        slots = ngram_slots(data, order)
        sums = np.add.reduceat(weights[slots], np.minimum(edges, len(slots) - 1), axis=0, dtype=np.float64)[::2]
        out += sums / sizes[:, None]
    return out + bias


def linear_svm(x: np.ndarray, y: np.ndarray, steps: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM; ``y`` is -1 or 1, classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        loss = np.maximum(0, 1 - y * (x @ w[:-1].astype(np.float32) + w[-1]))
        slope = (-2 * share * y * loss).astype(np.float32)
        grad = np.r_[slope @ x + decay * w[:-1], slope.sum()]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-12)
    return w[:-1], float(w[-1])


def families(profiles: dict[str, np.ndarray], count: int | None = None) -> list[list[str]]:
    """Languages grouped by average similarity of their n-gram profiles, into about the root of their number."""
    groups = [[name] for name in sorted(profiles)]
    count = count or max(1, round(len(groups) ** 0.5))
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in profiles.items()}
    while len(groups) > count:
        close = lambda ab: np.mean([unit[i] @ unit[j] for i in groups[ab[0]] for j in groups[ab[1]]])
        a, b = max(combinations(range(len(groups)), 2), key=close)
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


@dataclass
class Model:
    """Families, and one column of weights per SVM: each family against the rest, then each pair within a family."""

    groups: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        values = decision_values(texts, self.weights, self.bias)
        chance = 1 / (1 + np.exp(-2 * np.clip(values, -30, 30)))
        family = values[:, :len(self.groups)].argmax(axis=1)
        names, scores = [], np.zeros(len(texts))
        for row, group in enumerate(family):
            best = self.groups[group][0]
            score = chance[row, group] if len(self.groups) > 1 else 1.0
            if len(self.groups[group]) > 1:
                wins = dict.fromkeys(self.groups[group], 0.0)
                surest = dict.fromkeys(self.groups[group], 1.0)
                for column, (a, b) in enumerate(self.pairs, len(self.groups)):
                    if a in wins:
                        p = chance[row, column]
                        wins[a if p >= 0.5 else b] += 1 + abs(p - 0.5) / len(self.pairs)
                        surest[a], surest[b] = min(surest[a], p), min(surest[b], 1 - p)
                best = max(wins, key=wins.get)
                score *= surest[best]
            names.append(best)
            scores[row] = score
        return names, scores


def fit(labels: np.ndarray, x: np.ndarray) -> Model:
    """Train all machines; scales ``x`` in place."""
    names = sorted(set(labels))
    groups = families({n: x[labels == n].mean(axis=0) for n in names})
    # By columns, so that no copy of the whole table is made.
    scale = np.concatenate([x[:, at:at + 256].std(axis=0) for at in range(0, x.shape[1], 256)]) + np.float32(1e-4)
    x /= scale
    scaled = x
    columns = []
    for group in groups:
        columns.append(linear_svm(scaled, np.where(np.isin(labels, group), 1, -1)) if len(groups) > 1
                       else (np.zeros(FEATURES), 0.0))
    pairs = [pair for group in groups for pair in combinations(group, 2)]
    for a, b in pairs:
        own = np.isin(labels, (a, b))
        columns.append(linear_svm(scaled[own], np.where(labels[own] == a, 1, -1)))
    weights = np.column_stack([w / scale for w, _ in columns]).astype(np.float32)
    return Model(groups, pairs, weights, np.array([b for _, b in columns]))


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
          ) -> Model | None:
    """Fit on a bounded sample of the labelled documents that are not held out; None where there is none.

    Languages share ``sample`` evenly and rows are taken by a hash of the id, so a hot
    language neither crowds out the others nor moves through one task.  Each gives its
    whole text and a short piece of it.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), is_held_out(id_col).alias("held")).where(
        "NOT held AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = sample / len(counts)
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000_007))
    taken = F.coalesce(*[F.when(F.col("lang") == k, draw < int(min(1.0, share / n) * 1_000_000_007) + 1) for k, n in counts.items()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                langs, texts = (c.to_pylist() for c in whole.slice(at, 64).columns)
                pairs = [(n, t) for n, t in zip(langs, texts, strict=True) if has_letter(t)]
                middles = [(n, t[len(t) // 3:][:120]) for n, t in pairs]
                pairs += [(n, t) for n, t in middles if has_letter(t)]
                if pairs:
                    found = frequencies([t for _, t in pairs])
                    full = [np.flatnonzero(r) for r in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n for n, _ in pairs]), pa.array([f.astype(np.uint16).tobytes() for f in full], pa.binary()),
                         pa.array([r[f].tobytes() for r, f in zip(found, full)], pa.binary())], ["lang", "slots", "x"])

    drawn = rows.where(taken).select("lang", "text").mapInArrow(features, "lang string, slots binary, x binary")
    found = drawn.limit(4 * sample).toArrow()
    if not found.num_rows:
        return None
    labels = np.array(found.column("lang").to_pylist())
    x = np.zeros((len(labels), FEATURES), dtype=np.float32)
    for row, (slots, value) in enumerate(zip(found.column("slots"), found.column("x"), strict=True)):
        x[row, np.frombuffer(slots.as_buffer(), dtype=np.uint16)] = np.frombuffer(value.as_buffer(), dtype=np.float32)
    del found, slots, value
    pa.default_memory_pool().release_unused()
    return fit(labels, x)


def predict_batch(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 where there is no letter or no model."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    ask = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    at = 0
    while at < len(ask):
        to, size = at, 0
        while to < len(ask) and (to == at or size + len(texts[ask[to]]) <= SLICE):
            size += len(texts[ask[to]])
            to += 1
        found, sure = model.predict([texts[i] for i in ask[at:to]])
        for i, name, score in zip(ask[at:to], found, sure, strict=True):
            names[i], scores[i] = name, score
        at = to
    return names, scores


def tag_language(docs: DataFrame, model: Model | None, text_col: str = "text", lang_pred: str = "lang_pred",
                 score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the prediction under two further names, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text
    where nothing could be learned.  Repeated rows get the same answer; no rows give
    no rows.  The step is narrow.  Columns of ``docs`` with the two names are replaced.
    """
    rest = docs.drop(lang_pred, score)
    place = rest.columns.index(text_col)
    names = [*rest.columns, lang_pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sure = predict_batch(model, [t or "" for t in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure)], names)

    return rest.mapInArrow(run, StructType([*rest.schema, StructField(lang_pred, StringType()), StructField(score, DoubleType())]))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; see ``tag_language``.  Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return tag_language(rows, model).select(F.col("id").alias(id_col), "lang_pred", "score")
