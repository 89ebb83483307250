"""Document quality learnt from preference pairs (Bradley-Terry)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col
from capital_access.llm.common import bounded_sample, fresh_names

#: Characters beyond this code point count as one character, a letter.
_LAST_CODE = 0x3400

FEATURES = (
    "log_words", "log_chars", "upper_share", "capital_word_share", "symbol_share", "exclaim_share", "digit_share", "bar_share",
    "odd_ending_share", "distinct_share", "top_word_share", "distinct_pair_share", "repeated_line_share", "mean_word", "word_spread",
    "single_char_share", "words_per_sentence", "lower_start_share",
)


def text_features(text: str | None) -> np.ndarray:
    """Shape and repetition of a whole text; all zero for one without words."""
    out = np.zeros(len(FEATURES))
    words = (text or "").split()
    if not words:
        return out
    n, chars = len(words), len(text)
    counts = Counter(words)
    lengths, times = np.array([len(w) for w in counts]), np.fromiter(counts.values(), "i8", len(counts))
    mean_word = lengths @ times / n
    codes = np.bincount(np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), _LAST_CODE))
    by_char = {chr(k): int(codes[k]) for k in np.flatnonzero(codes)}
    letters = sum(c for ch, c in by_char.items() if ch.isalpha()) or 1
    lines = [line for line in text.split("\n") if line.strip()]
    sentences = sum(by_char.get(ch, 0) for ch in ".!?") or 1
    out[:] = (
        np.log1p(n), np.log1p(chars),
        sum(c for ch, c in by_char.items() if ch.isupper()) / letters,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        sum(c for ch, c in by_char.items() if not ch.isalnum() and not ch.isspace() and ch not in ".,;:!?'\"-|") / chars,
        by_char.get("!", 0) / chars,
        sum(c for ch, c in by_char.items() if ch.isdigit()) / chars,
        counts["|"] / n,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,") / n,
        len(counts) / n, max(counts.values()) / n,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        1 - len(set(lines)) / len(lines),
        mean_word, ((lengths - mean_word) ** 2 @ times / n) ** 0.5, times[lengths == 1].sum() / n,
        min(n / sentences, 100.0),
        sum(c for w, c in counts.items() if w[0].islower()) / n,
    )
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and their products with the text length, so that a linear score can bend."""
    return np.hstack([x, x ** 2, x[:, 2:] * x[:, :1]])


@dataclass(frozen=True)
class PairwiseModel:
    """A linear score on standardised features, and the score quantile below which documents are rejected."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores: a difference is the log-odds of being preferred."""
        return np.clip((_expand(x) - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, with ``threshold`` at the quantile."""
        logit = self.slope * (self.latent(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit_pairs(x: np.ndarray, preferred: np.ndarray, threshold: float = 0.3, partners: int = 8, ridge: float = 1e-3,
              rejected_share: float | None = None) -> PairwiseModel:
    """Fit by Newton steps on the logistic loss of feature differences.

    Every row of the rarer class meets ``partners`` rows of the other, dealt out
    in turn after a seeded shuffle. The cut is the quantile of the scores at
    ``rejected_share`` (the share of rejected rows unless given). With one class
    only there are no pairs: every document then scores 0.5.
    """
    z = _expand(x)
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros(z.shape[1]), np.ones(z.shape[1]), np.zeros(z.shape[1]), np.log(threshold / (1 - threshold)), 1.0, threshold)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale < 1e-12] = 1.0
    z = np.clip((z - mean) / scale, -8, 8)
    shuffled = np.random.default_rng(42)
    good, bad = shuffled.permutation(good), shuffled.permutation(bad)
    most = partners * min(len(good), len(bad))
    turn = np.arange(most)
    d = z[good[turn % len(good)]] - z[bad[(turn + turn // np.lcm(len(good), len(bad))) % len(bad)]]
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ w)).mean() + ridge / 2 * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        step = np.linalg.solve(d.T * (p * (1 - p)) @ d / len(d) + ridge * np.eye(len(w)), d.T @ p / len(d) - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, (~preferred).mean() if rejected_share is None else rejected_share))
    return PairwiseModel(mean, scale, w, cut, 1.0, threshold)


def held_out(id_col: str, folds: int = 5) -> Column:
    """True for the ids (as text) whose CRC-32 is a multiple of ``folds``; missing without an id."""
    return F.crc32(as_col(id_col).cast("string")) % folds == 0


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = 20_000, threshold: float = 0.3, texts_per_id: int = 4,
) -> PairwiseModel:
    """Learn from labelled ids outside the held-out fold, at most ``max_labelled`` of them.

    Which ones depends on a hash of the id only. An id with several labels
    counts by their mean (a tie is no label). An id with several texts counts by
    at most ``texts_per_id`` of them: texts are dealt by their hash to as many
    places, and the least hash of a place stays, so an id on a third of all rows
    weighs no more than that. The features of these texts come to the driver, at
    most ``8 * len(FEATURES) * max_labelled * texts_per_id`` bytes; the list of
    ids is bounded alike, and is the one table that is broadcast. A text of any
    length is one row of features.
    """
    chosen = bounded_sample(
        labels.where(as_col(id_col).isNotNull() & as_col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(as_col(id_col).alias("label_id")).agg(F.avg(as_col(label_col)).alias("label")).where("label != 0.5"),
        max_labelled, "label_id")
    featured = F.pandas_udf(lambda texts: texts.map(lambda t: text_features(t).tolist()), "array<double>")
    rows = (
        docs.select(as_col(id_col).alias("label_id"), as_col(text_col).alias("text"))
        .join(F.broadcast(chosen), "label_id").select("label_id", "label", F.xxhash64("text").alias("hash"), featured("text").alias("x"))
        .groupBy("label_id", "label", F.pmod("hash", F.lit(texts_per_id)).alias("place"))
        .agg(F.min(F.struct("hash", "x"))["x"].alias("x")).select("label_id", "label", "x").toPandas())
    rows["x"] = rows["x"].map(tuple)
    rows = rows.sort_values(["label_id", "x"])  # the same order whichever task ended first
    x = np.array(rows["x"].tolist(), "f8").reshape(len(rows), len(FEATURES))
    return fit_pairs(x, rows["label"].to_numpy("f8") > 0.5, threshold)


def quality_score(text_col: str, model: PairwiseModel) -> Column:
    """Score of each whole text, empty and missing ones included."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return scored(as_col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                    max_labelled: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Only the text is scored: equal texts score alike, whatever their id, and
    missing and empty texts score like any other. No column but id and text is
    read. Without labels of both kinds every score is 0.5.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_labelled, threshold)
    return (
        docs.select(as_col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), quality_score(text_col, model).alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_preferred(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   max_labelled: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_labelled, threshold)
    score, = fresh_names(docs, "score")
    return docs.withColumn(score, quality_score(text_col, model)).where(F.col(score) >= threshold).drop(score)
