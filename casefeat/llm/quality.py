"""Quality classifier: regularised quadratic discriminant over statistics.

Each class is a Gaussian over transformed document statistics, its covariance
shrunk towards a common scale. A document's score is the logistic of the
difference of the two log densities (Mahalanobis distances by the inverses of
Cholesky factors that are computed once) plus the log of the class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "symbols", "pipes", "digits", "marks",
    "distinct_words", "same_neighbour", "top_word", "short_words", "sentence_length", "same_lines",
)
N = len(STATISTICS)
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)
MARKS = np.frombuffer(b"!?", np.uint8)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text; shares enter as square
    roots, lengths as logarithms. A null text counts as empty, and a text
    without words has zeros."""
    out = np.zeros(N)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = seen[65:91].sum(), seen[97:123].sum() + seen[0xC0:].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    folded = raw.lower().split()
    kinds: dict[bytes, int] = {}
    for word in folded:
        kinds[word] = kinds.get(word, 0) + 1
    same = sum(map(bytes.__eq__, folded[1:], folded))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = lengths.sum()
    out[:] = (
        np.log1p(n),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        np.sqrt(upper / max(upper + lower, 1)),
        np.sqrt(seen[SYMBOLS].sum() / chars),
        np.sqrt(seen[124] / chars),
        np.sqrt(seen[48:58].sum() / chars),
        np.sqrt(seen[MARKS].sum() / chars),
        np.log(len(kinds)) / np.log(n) if n > 1 else 1.0,
        np.sqrt(same / n),
        np.sqrt(max(kinds.values()) / n),
        np.sqrt((lengths <= 3).mean()),
        np.log1p(n / (1 + seen[46])),
        np.sqrt(1 - len(set(lines)) / len(lines)),
    )
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log constants of both classes."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.inverse[c].T
            density.append(self.constant[c] - 0.5 * (z * z).sum(1))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows a model never learns from: crc32 of the id as text is a multiple
    of 5. A null id is not held out (and has no label either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def moments(docs: DataFrame, labels: DataFrame, label: str) -> np.ndarray:
    """Per class: count, sums and sums of products over **all** labelled rows
    that are not held out; summed in Spark, so the driver gets a table whose
    size depends on the number of statistics only."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("c"))
    ids = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    thin = ids.select("doc_id", _statistics_of("text").alias("x"))
    rows = thin.join(known, F.col("doc_id") == F.col("__id")).select("c", "x")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + N + N * N))
        for batch in batches:
            for c, part in batch.groupby("c"):
                x = np.stack(part["x"].to_list())
                total[c] += np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    sums = rows.mapInPandas(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(2 * (1 + N + N * N))
    for row in sums.collect():
        out[row["k"]] = row["v"]
    return out.reshape(2, -1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", own: float = 0.8, floor: float = 0.05) -> Model:
    """Train on all labelled rows outside the held-out fold.

    A class covariance is ``own`` parts its own and the rest the pooled one;
    ``floor`` times the pooled variance of each statistic is added to its
    diagonal. With no labelled row of one class, scores are the smoothed
    share of the other: densities are equal then.
    """
    sums = moments(docs, labels, label)
    count = sums[:, 0]
    share = np.log((count + 1) / (count.sum() + 2))
    if (count < 1).any():
        return Model(np.zeros((2, N)), np.stack([np.eye(N)] * 2), share)
    mean = sums[:, 1 : N + 1] / count[:, None]
    scatter = sums[:, N + 1 :].reshape(2, N, N) - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / count.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    inverse, constant = [], []
    for c in (0, 1):
        cov = own * scatter[c] / count[c] + (1 - own) * pooled + floor * scale
        chol = np.linalg.cholesky((cov + cov.T) / 2)
        inverse.append(np.linalg.inv(chol))
        constant.append(share[c] - np.log(np.diag(chol)).sum())
    return Model(mean, np.stack(inverse), np.array(constant))


def score_of(model: Model):
    """A function of the text column: the score of the whole text, 0 to 1,
    higher where label 1 is likelier. Null and empty texts have the score of
    zero statistics, equal texts equal scores; nothing but the text is read."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return of


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the score; a column of that name is replaced."""
    return docs.withColumn(name, score_of(model)("text"))
