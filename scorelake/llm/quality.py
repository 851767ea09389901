"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and covariance, shrunk towards the diagonal of the pooled
covariance. A document's score comes from the difference of the two log densities, for which the
inverse Cholesky factor of each covariance is computed once and kept. Statistics of all labelled
training documents are summed by Spark; the driver sees one row of moments for each class.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, text_or_empty

FEATURES = ["words", "word_length", "uppercase", "digits", "marks", "symbols", "pipes", "bangs", "distinct", "repeats", "line_length", "non_ascii"]

_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LOWER = (_CODE >= 97) & (_CODE <= 122)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_SPACE = (_CODE == 32) | ((_CODE >= 9) & (_CODE <= 13))
_MARK = np.isin(_CODE, [ord(c) for c in ".,;:'\"-()?"])
_ASCII = _CODE < 128
_SYMBOL = _ASCII & (_CODE > 32) & (_CODE < 127) & ~(_UPPER | _LOWER | _DIGIT | _MARK)


#: Labelled rows, of some 16 bytes, that are sent to all tasks; more are joined by id.
FEW_LABELS = 500_000

#: Counts that stand behind every statistic, so that a few words don't look extreme.
_PRIOR = 20


def _share(part: float, whole: float) -> float:
    """A share as its log-odds, drawn towards 3 % by the prior counts."""
    return float(np.log((part + 0.03 * _PRIOR) / (max(whole - part, 0) + 0.97 * _PRIOR)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    count = np.bincount(data, minlength=256)
    words = (text or "").split()
    n = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    letters, seen = count[_UPPER].sum() + count[_LOWER].sum(), len(data) - count[_SPACE].sum()
    return [
        float(np.log1p(n)),
        float(np.log((seen + 5 * _PRIOR) / (n + _PRIOR))),
        _share(count[_UPPER].sum(), letters),
        _share(count[_DIGIT].sum(), seen),
        _share(count[_MARK].sum(), seen),
        _share(count[_SYMBOL].sum(), seen),
        _share(count[ord("|")], n),
        _share(count[ord("!")], seen),
        float(np.log((distinct + _PRIOR) / (n + _PRIOR))),
        _share(max(n - 1 - pairs, 0), max(n - 1, 0)),
        float(np.log((n + _PRIOR) / (1 + count[10]))),
        _share(count[~_ASCII].sum(), seen),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


@dataclass(frozen=True)
class Discriminant:
    """For classes 0 and 1: mean, inverse of the covariance's Cholesky factor, log prior less half the log determinant."""

    means: tuple[np.ndarray, np.ndarray]
    whitening: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]
    scale: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included, for each row."""
        logs = []
        for mean, whiten, offset in zip(self.means, self.whitening, self.offsets, strict=True):
            z = (x - mean) @ whiten.T
            logs.append(offset - 0.5 * (z * z).sum(axis=1))
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rising with the margin, without saturating; 0.5 at margin 0."""
        m = self.margin(x) / self.scale
        return 0.5 + 0.5 * m / (1 + np.abs(m))


def fit(features: DataFrame, shrinkage: float = 0.1) -> Discriminant | None:
    """features: x array<double>, label 0 or 1. None if a class has fewer than two rows.

    shrinkage: the weight of the pooled covariance's diagonal in each class covariance.
    """
    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    pairs = list(combinations_with_replacement(range(d), 2))
    moments = features.filter("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(x[i]).alias(f"m{i}") for i in range(d)), *(F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs))
    rows = {r["label"]: r for r in moments.collect() if r["n"] >= 2}
    if set(rows) != {0, 1}:
        return None
    means, covariances, counts = [], [], []
    for k in (0, 1):
        r, c = rows[k], np.zeros((d, d))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        means.append(np.array([r[f"m{i}"] for i in range(d)]))
        covariances.append(c)
        counts.append(r["n"])
    pooled = np.diag(sum(n * np.diag(c) for n, c in zip(counts, covariances, strict=True)) / sum(counts) + 1e-3)
    factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled) for c in covariances]
    offsets = [float(np.log(n / sum(counts)) - np.log(np.diag(f)).sum()) for n, f in zip(counts, factors, strict=True)]
    whitening = [np.linalg.inv(f) for f in factors]
    return Discriminant((means[0], means[1]), (whitening[0], whitening[1]), (offsets[0], offsets[1]), float(d))


def held_out(id_: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def labelled_statistics(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """(id and statistics of all documents, on shared files; x and label of those to learn from)."""
    features = materialize(df.select(df[id_col].alias("id"), statistics_of(text_or_empty(df, text_col)).alias("x")), "quality-statistics")
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter(~held_out(F.col("id")))
    if known.count() <= FEW_LABELS:
        known = F.broadcast(known)
    return features, features.join(known, "id").select("x", "label")


def score_with(model: Discriminant | None, x: Column) -> Column:
    """The score of a column of statistics; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(xs.tolist()).reshape(-1, len(FEATURES))))

    return score(x)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.1) -> DataFrame:
    """One row for each document: id, held_out, score, predicted.

    Only texts are scored; ids choose the rows to learn from and nothing else. A null or empty text
    is scored like any other. Rows with a null id are scored, not learned from, and not held out; so are
    labels other than 0 and 1. Repeated rows are repeated in the result and count as often when learned
    from. If a class has fewer than two labelled rows, all scores are 0.5. Other columns are not looked at.
    """
    features, train = labelled_statistics(df, labels, id_col, text_col, label_col)
    model = fit(train, shrinkage)
    scored = features.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), score_with(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.1) -> DataFrame:
    """The rows of df, with all their columns, that the classifier predicts to be good."""
    _, train = labelled_statistics(df, labels, id_col, text_col, label_col)
    score = score_with(fit(train, shrinkage), statistics_of(text_or_empty(df, text_col)))
    return df.filter(score >= 0.5)
