"""Quality of documents by co-training two views.

One classifier sees the text only (its characters, words, lines and repetition), the other
only what is known about the page (source, language, recorded length). Over some rounds
each labels the documents without labels that it is surest about, as training data for the
other. Both are calibrated on labelled documents that neither was trained on, and a
logistic combination of the calibrated views, fitted on the same, scores all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.shared import stored, whole_text

#: Labelled documents used for fitting, at most (lowest hashed ids), and the part of them
#: that is kept for calibration.
MAX_LABELLED, CALIBRATION_PART = 20_000, 4
#: Rounds of exchange; how sure a view must be; pseudo-labels of each class that it may
#: hand over in a round, and what one counts beside a label.
ROUNDS, CONFIDENCE, HANDED, PSEUDO_WEIGHT = 3, 0.97, 1_000, 0.3
BINS = 10
SOURCES, LANGS = 128, 32

CONTENT = (
    "log_words", "word_length", "long_words", "letters", "digits", "upper", "spaces", "stops", "symbols",
    "other_bytes", "distinct_words", "commonest_word", "distinct_pairs", "log_lines", "line_words",
    "distinct_lines", "ended_lines", "entropy", "short_words", "symbol_words", "upper_words",
)


def _class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(chars)] = True
    return mask


_LETTERS = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGITS, _UPPER = _class(bytes(range(48, 58))), _class(bytes(range(65, 91)))
_SPACES, _STOPS = _class(b" \t\r\n\x0b\x0c"), _class(b".,;:!?'\"()-")
_SYMBOLS = _class(bytes(range(33, 127))) & ~_LETTERS & ~_DIGITS & ~_STOPS


def content(text: str) -> list[float]:
    """The numbers of ``CONTENT`` for a whole text; zeros for one without words."""
    words = text.split()
    if not words:
        return [0.0] * len(CONTENT)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    share = counts / counts.sum()
    seen = share[share > 0]
    lines = [line for line in text.split("\n") if line.strip()]
    n = len(words)
    common = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [
        math.log1p(n), float(lengths.mean()), float((lengths > 15).mean()), share[_LETTERS].sum(), share[_DIGITS].sum(),
        share[_UPPER].sum(), share[_SPACES].sum(), share[_STOPS].sum(), share[_SYMBOLS].sum(), share[128:].sum(),
        len(common) / n, max(common.values()) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(line.rstrip()[-1] in ".!?:;\"" for line in lines) / max(1, len(lines)),
        float(-(seen * np.log2(seen)).sum()), float((lengths < 3).mean()),
        sum(not (w[-1].isalnum() or w[-1] in ".,;:!?'\")") for w in common.elements()) / n,
        sum(c for w, c in common.items() if w.isupper() and len(w) > 1) / n,
    ]


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """Hashed source, hashed language, and a step of the recorded length; -1 for unknown."""
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    return [
        -1.0 if source is None else float(zlib.crc32(source.encode()) % SOURCES),
        -1.0 if lang is None else float(zlib.crc32(lang.encode()) % LANGS),
        float(int(2 * math.log2(1 + n_chars))) if known else -1.0,
    ]


def views(text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """Content numbers, then metadata numbers, as one array."""

    def compute(texts: pd.Series, sources: pd.Series, langs: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([
            content(t) + metadata(s, g, n) for t, s, g, n in zip(texts, sources, langs, lengths, strict=True)
        ])

    made = F.pandas_udf(compute, T.ArrayType(T.FloatType()))
    return made(text, source, lang, n_chars)


class View:
    """A logistic model over one-hot steps of a view's numbers."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.weights = edges, np.zeros(sum(len(e) + 1 for e in edges) + 1)

    @classmethod
    def over(cls, x: np.ndarray, exact: bool) -> View:
        """Steps between quantiles of each number, or between all its values if ``exact``."""
        edges = []
        for column in x.T:
            points = np.unique(column) if exact else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
            # A value of its own, such as a share of exactly 0 or 1, is a step of its own.
            edges.append(np.unique(np.concatenate([points, np.nextafter(points, np.inf)])) if exact else points)
        return cls(edges)

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for column, edge in zip(x.T, self.edges, strict=True):
            parts.append(np.eye(len(edge) + 1)[np.searchsorted(edge, column, side="right")])
        return np.column_stack([*parts, np.ones(len(x))])

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> None:
        self.weights = logistic(self.design(x), y, w, ridge)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted ridge logistic regression by damped Newton steps; the last column is the intercept."""
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (w * (p - y)) + penalty * weights
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return weights


class Model:
    """Both views, their calibrations and their combination."""

    def __init__(self, text: View, page: View):
        self.text, self.page = text, page
        self.calibration = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
        self.combination = np.array([0.5, 0.5, 0.0])

    def calibrated(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of the two views."""
        k = len(CONTENT)
        raw = (self.text.logit(numbers[:, :k]), self.page.logit(numbers[:, k:]))
        return tuple(c[0] * r + c[1] for c, r in zip(self.calibration, raw, strict=True))

    def calibrate(self, numbers: np.ndarray, y: np.ndarray) -> None:
        if len(np.unique(y)) < 2:
            return
        k, one = len(CONTENT), np.ones(len(y))
        for i, raw in enumerate((self.text.logit(numbers[:, :k]), self.page.logit(numbers[:, k:]))):
            self.calibration[i] = logistic(np.column_stack([raw, one]), y, one, 0.1)
        both = np.column_stack([*self.calibrated(numbers), one])
        self.combination = logistic(both, y, one, 0.1)

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        """Columns: probability by the text, by the page, and of both together."""
        a, b = self.calibrated(numbers)
        c = np.column_stack([a, b, np.ones(len(a))]) @ self.combination
        return 1 / (1 + np.exp(-np.clip(np.column_stack([a, b, c]), -30, 30)))


def scored_by(model: Model | float, numbers: Column) -> Column:
    """A struct of ``content_score``, ``metadata_score`` and ``score`` for an array of numbers."""
    if not isinstance(model, Model):
        one = F.lit(float(model))
        return F.struct(one.alias("content_score"), one.alias("metadata_score"), one.alias("score"))

    def compute(rows: pd.Series) -> pd.DataFrame:
        found = model.scores(np.stack(rows.to_numpy()).astype(float)) if len(rows) else np.empty((0, 3))
        return pd.DataFrame(found, columns=["content_score", "metadata_score", "score"])

    return F.pandas_udf(compute, "content_score double, metadata_score double, score double")(numbers)


def numbers_of(docs: DataFrame) -> Column:
    return views(
        whole_text(), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double")
    )


def trained(slim: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model | float:
    """A model from ``slim (doc_id, numbers)``; a number where labels are absent or all alike."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "doc_id is not null and quality in (0, 1)"
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    sample = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "numbers", "quality").toArrow().to_pandas()
    if sample["quality"].nunique() < 2:
        return float(sample["quality"].mean()) if len(sample) else 1.0
    sample = sample.sort_values("doc_id", kind="stable")
    x = np.stack(sample["numbers"].to_numpy()).astype(float)
    y = sample["quality"].to_numpy(dtype=float)
    apart = np.array([zlib.crc32(b"apart%d" % i) % CALIBRATION_PART == 0 for i in sample["doc_id"]])
    if len(np.unique(y[apart])) < 2 or len(np.unique(y[~apart])) < 2:
        apart[:] = False
    k = len(CONTENT)
    model = Model(View.over(x[:, :k], exact=False), View.over(x[:, k:], exact=True))
    training = [(x[~apart], y[~apart], np.ones((~apart).sum())) for _ in range(2)]
    pool = slim.join(known, "doc_id", "left_anti").select("doc_id", "numbers")
    for step in range(rounds + 1):
        model.text.fit(training[0][0][:, :k], training[0][1], training[0][2])
        model.page.fit(training[1][0][:, k:], training[1][1], training[1][2])
        model.calibrate(x[apart] if apart.any() else x, y[apart] if apart.any() else y)
        if step == rounds:
            break
        # All documents without labels are scored; the surest come to the driver, a fixed number.
        marked = pool.withColumn("__s", scored_by(model, F.col("numbers")))
        for view, column in enumerate(("content_score", "metadata_score")):
            given = []
            p = F.col(f"__s.{column}")
            for label, order in ((1, F.desc("p")), (0, F.asc("p"))):
                sure = p >= CONFIDENCE if label else p <= 1 - CONFIDENCE
                top = marked.where(sure).select("doc_id", "numbers", p.alias("p")).orderBy(
                    order, F.xxhash64("doc_id", F.lit(step)), "doc_id"
                ).limit(HANDED)
                rows = top.toArrow().to_pandas()
                if len(rows):
                    numbers = np.stack(rows["numbers"].to_numpy()).astype(float)
                    given.append((numbers, np.full(len(rows), float(label)), np.full(len(rows), PSEUDO_WEIGHT)))
            other = 1 - view
            training[other] = tuple(np.concatenate(parts) for parts in zip(training[other], *given, strict=True))
    return model


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, keep`` for every row of ``docs``.

    ``score`` is the probability of good quality; ``keep`` is 1 from 0.5. Learns from
    ``labels (doc_id, quality)``; null labels and those of unknown documents are ignored.
    If labels are missing every score is 1 (nothing is known against a document); if all
    are alike, it is their value. Null texts are empty, null sources, languages and lengths
    are values of their own. Repeated rows are scored alike, other columns are ignored, an
    empty table gives no rows. Each text is read once, into ``len(CONTENT) + 3`` numbers.
    """
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), numbers_of(docs).alias("numbers")))
    model = trained(slim, labels, max_labelled)
    return slim.withColumn("__s", scored_by(model, F.col("numbers"))).select(
        "doc_id", "__s.content_score", "__s.metadata_score", "__s.score",
        (F.col("__s.score") >= 0.5).cast("int").alias("keep"),
    )


def kept(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, in all their columns, that the classifier keeps.

    Texts are measured twice, for training and for the decision: writing all rows beside
    their numbers would save a quarter of the time and cost the whole input in disk.
    """
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), numbers_of(docs).alias("numbers")))
    model = trained(slim, labels, max_labelled)
    return docs.where(scored_by(model, numbers_of(docs))["score"] >= 0.5)
