"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(theta_j - s) with ordered thresholds theta and one score s = sum of hashed-text weights, shared by all
grades. A document's score sums the weights of its distinct words, of the marks that end its words, and of a few bins of
its shape (share of distinct words, of capitals, of letters, and its length).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
PER_GRADE = 4000
MIN_DOCUMENTS = 5
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…–—«»„“”‘’¡¿"


def features(text: str | None, buckets: int = BUCKETS) -> list[int]:
    """Distinct hash buckets of a text."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    bare = {w.lower().strip(MARKS) for w in distinct}
    ends = {w[len(w.rstrip(MARKS)):] for w in distinct}
    n = len(words)
    letters = sum(map(len, words))
    sample = "".join(words)
    shape = (f"#len {n.bit_length()}", f"#distinct {min(n, 1 << 10).bit_length()} {round(10 * len(distinct) / n) if n else -1}",
             f"#upper {round(20 * sum(map(str.isupper, sample)) / letters) if letters else -1}",
             f"#alpha {round(20 * sum(map(str.isalpha, sample)) / letters) if letters else -1}")
    named = [*bare, *("#end " + e for e in ends), *shape]
    return list({zlib.crc32(f.encode("utf-8", "replace")) % buckets for f in named})


@dataclass
class QualityModel:
    """Weights of the buckets in use and the thresholds between grades 0..len(thresholds)."""
    weights: dict[int, float]
    thresholds: list[float]
    buckets: int = BUCKETS

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return float(sum(get(b, 0.0) for b in features(text, self.buckets)))

    def at_least(self, scores: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= given grade)."""
        return np.ones_like(scores) if grade <= 0 else 1 / (1 + np.exp(self.thresholds[grade - 1] - scores))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return sum(self.at_least(scores, g) for g in range(1, len(self.thresholds) + 1))


def _fit(lists: Sequence[Sequence[int]], grade: np.ndarray, weight: np.ndarray, n_grades: int, min_documents: int = MIN_DOCUMENTS,
         ridge: float = 2e-4, steps: int = 150, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, thresholds) of the cumulative-link model by full-batch Adam; rare buckets are left out."""
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((b for x in lists for b in x), np.int64, int(sizes.sum()))
    used, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts >= min_documents
    new = np.cumsum(keep) - 1
    row, ok = np.repeat(np.arange(len(lists)), sizes), keep[inverse]
    row, col, used = row[ok], new[inverse[ok]], used[keep]
    weight = weight / weight.sum()
    share = np.array([weight[grade < g].sum() for g in range(1, n_grades)]).clip(1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    # theta_1 and the logarithms of the steps up, so the order of thresholds always holds
    p = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v, k = np.zeros_like(p), np.zeros_like(p), len(used)
    for i in range(1, steps + 1):
        s = np.bincount(row, weights=p[col], minlength=len(lists))
        gaps = np.exp(p[k + 1:])
        theta = p[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(-(edges[grade + 1] - s))), 1 / (1 + np.exp(-(edges[grade] - s)))
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g = np.zeros_like(p)
        g[:k] = np.bincount(col, weights=(weight * (d_hi - d_lo))[row], minlength=k) + ridge * p[:k]
        at = np.zeros(n_grades + 1)
        np.add.at(at, grade + 1, -weight * d_hi)
        np.add.at(at, grade, weight * d_lo)
        inner = at[1:n_grades]
        g[k] = inner.sum()
        g[k + 1:] = gaps * np.cumsum(inner[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return used, p[:k], p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1:]))])


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, per_grade: int = PER_GRADE, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS) -> QualityModel | None:
    """Fit on at most `per_grade` rated documents of each grade, those with the smallest hash of their id.

    ratings is (doc_id, grade 0..n_grades-1); null or other grades are passed over, an id rated twice counts twice. Rows of a grade
    weigh as many as the grade has ratings. None where the rated documents show fewer than two grades.
    """
    rated = ratings.select(F.col("doc_id").alias("_rated"), F.col("grade").cast("int").alias("grade")).filter(f"_rated is not null and grade between 0 and {n_grades - 1}")
    known = docs.select(F.col(f"`{id_col}`").alias("_rated"))
    rated = rated.join(known, "_rated", "left_semi")
    totals = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    order = F.xxhash64("_rated")
    parts = [rated.filter(F.col("grade") == g).orderBy(order, "_rated").limit(per_grade) for g in totals]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # at most per_grade * n_grades rows
    sample = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_rated")).select("grade", "_text", F.lit(0).alias("_all"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        grade = pdf["grade"].to_numpy(np.int64)
        drawn = np.bincount(grade, minlength=n_grades)
        weight = np.array([totals.get(g, 0) / max(drawn[g], 1) for g in range(n_grades)])[grade]
        used, w, theta = _fit([features(t, buckets) for t in pdf["_text"]], grade, weight, n_grades)
        return pd.DataFrame({"bucket": np.concatenate([used, -1 - np.arange(len(theta))]), "value": np.concatenate([w, theta])})

    # the sample is bounded, and so are the weights
    rows = sample.groupBy("_all").applyInPandas(train, "bucket long, value double").collect()
    theta = sorted(((r["bucket"], r["value"]) for r in rows if r["bucket"] < 0), reverse=True)
    return QualityModel({r["bucket"]: r["value"] for r in rows if r["bucket"] >= 0 and abs(r["value"]) > 1e-6}, [v for _, v in theta], buckets)


def scored(docs: DataFrame, model: QualityModel | None, grade: int, text_col: str = "text", name: str = "_quality") -> DataFrame:
    """docs with a struct column: expected grade and tail probability P(grade >= given one); both null without a model.

    Null text is scored as empty. Each row is scored by itself, so repeated rows, null ids and other columns stay as they are; `name` must be
    a new one.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column {name}")
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        s = np.array([m.score(t) for t in texts], float)
        return pd.DataFrame({"expected_grade": m.expected(s), "tail_probability": m.at_least(s, grade)})

    return docs.withColumn(name, score(F.col(f"`{text_col}`").cast("string")))


def selected(name: str = "_quality", threshold: float = 0.5):
    """Condition for documents that are kept: a tail probability of the threshold or more, or no model."""
    return F.coalesce(F.col(name)["tail_probability"] >= threshold, F.lit(True))


def graded(labels: DataFrame) -> DataFrame:
    """Grades from two 0/1 labels: 0 poor, 1 good but toxic, 2 good and clean; null labels give no grade."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
