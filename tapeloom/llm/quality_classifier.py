"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACE, let, words_of, written
from tapeloom.llm.quality_rules import SYMBOLS, _count, dup_lines

FEATURES = ("words", "word_length", "symbols", "bangs", "upper", "distinct", "lines", "dup_lines", "stops", "digits", "other_marks")


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and x: the transformed statistics (FEATURES) of every whole text of `docs` (doc_id, text).

    Counts enter as logarithms and rates as log(1 + 10 rate), which brings them near the normal
    distributions that the discriminant takes them for. Null texts count as empty ones.
    """
    t = F.coalesce("text", F.lit(""))
    words = let(words_of(t), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("distinct")))
    rows = docs.select(
        F.col("doc_id").cast("long"), words.alias("w"), _count(t, SYMBOLS).alias("symbols"), _count(t, "!").alias("bangs"), _count(t, "[A-Z]").alias("upper"), _count(t, "[A-Za-z]").alias("letters"),
        F.size(F.split(F.btrim(t, F.lit(SPACE)), "\n")).alias("lines"), dup_lines(t).alias("dups"), _count(t, "[.,;:?]").alias("stops"), _count(t, "[0-9]").alias("digits"), _count(t, r"[@~^_=+/\\(){}\[\]-]").alias("marks"),
    )
    n = F.greatest(F.col("w")["n"], F.lit(1.0))
    rate = lambda c, of: F.log1p(10.0 * F.col(c) / of)
    x = [
        F.log1p(F.col("w")["n"]), F.log1p(F.col("w")["chars"] / n), rate("symbols", n), rate("bangs", n), rate("upper", F.greatest("letters", F.lit(1))),
        F.log1p(F.col("w")["distinct"].cast("double")), F.log1p(F.col("lines").cast("double")), rate("dups", F.greatest("lines", F.lit(1))), rate("stops", n), rate("digits", n), rate("marks", n),
    ]
    return rows.select("doc_id", F.array(*x).alias("x"))


@dataclass
class Discriminant:
    """For each class (0, 1): log prior plus log determinant term, mean, and the inverse of the covariance's Cholesky factor."""

    centre: np.ndarray
    scale: np.ndarray
    offset: list[float]
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    spread: float = 3.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 over class 0: half the difference of the squared Mahalanobis distances, and constants."""
        z = (x - self.centre) / self.scale
        density = [o - 0.5 * np.square((z - m) @ w.T).sum(axis=1) for o, m, w in zip(self.offset, self.mean, self.whiten, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, ascending with the log odds; `spread` keeps far documents apart."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.spread, -36, 36)))


def fit(features: DataFrame, labels: DataFrame, shrink: float = 0.1) -> Discriminant:
    """Fits on all rows of `features` (doc_id, x) with a label (doc_id, label 0 or 1).

    Only each class's count, sums and sums of products reach the driver, added up on the cluster. Covariances
    shrink by `shrink` towards half the pooled one and half its diagonal, so that a statistic that never
    varies in a class stays usable.
    """
    d = len(FEATURES) + 1

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, d, d))
        for b in batches:
            x, y = np.stack(b["x"].to_numpy()), b["label"].to_numpy()
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    rows = features.join(labels.where("label in (0, 1)").select("doc_id", "label"), "doc_id").select("x", "label")
    cells = rows.mapInPandas(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # 2 d^2 rows
    total = np.zeros(2 * d * d)
    for r in cells:
        total[r["cell"]] = r["value"]
    total = total.reshape(2, d, d) + 1e-9 * np.eye(d)
    count = total[:, 0, 0]
    means = total[:, 0, 1:] / count[:, None]
    cov = np.stack([total[c, 1:, 1:] / count[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    share = count / count.sum()
    pooled = np.einsum("c,cij->ij", share, cov)
    centre, scale = share @ means, np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    cov, pooled, means = cov / np.outer(scale, scale), pooled / np.outer(scale, scale), (means - centre) / scale
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d - 1)
    whiten, offset = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * cov[c] + shrink * target)
        whiten.append(np.linalg.inv(factor))
        offset.append(float(np.log(share[c]) - np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, offset, list(means), whiten)


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row of `features`."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return features.select("doc_id", score("x").alias("score"))


def classify_quality(docs: DataFrame, labels: DataFrame, learn_from, shrink: float = 0.1) -> DataFrame:
    """Scores every row of `docs` (doc_id long, text) after learning `labels` (doc_id, quality) where `learn_from(doc_id)`.

    doc_id, score, predicted (1 from 0.7). Null and empty texts get the score of a text without words; labels that are
    null, other than 0 or 1, or of no document are left out; a class without a label has next to no weight;
    repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    features = written(document_features(docs))
    truth = labels.select(F.col("doc_id").cast("long"), F.col("quality").alias("label")).where(learn_from(F.col("doc_id")))
    out = scored(features, fit(features, truth, shrink))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = classify_quality(docs, labels, lambda i: ~held_out(i))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
