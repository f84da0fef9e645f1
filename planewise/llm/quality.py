"""Quality classifier: regularised quadratic discriminant analysis.

Each class has a mean and a covariance over transformed document statistics; the covariances are
shrunk towards their pooled matrix and then towards its scaled identity.  A score is the difference of the two
log densities (Mahalanobis distances by the cached inverses of the Cholesky factors, and the
log determinants), calibrated to a probability by a logistic fit of two parameters.

Fitted on at most ``most_rows`` labelled documents (a documented bound; chosen by hash of the id).
Contract: null text is empty text and gets a score like any other; without labels of both classes
every score is the share of label 1 (0.5 without any label); a null id is learned and scored like any other; repeated rows
are scored each for itself; texts are read whole, however long; extra columns are ignored (``keep_good`` passes them on); an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import fold
from planewise.llm.docstats import NAMES, kept_rows, scored, training_rows

MOST_ROWS = 20_000
THRESHOLD = 0.3
_LINEAR = np.isin(NAMES, ["log_words", "log_line_words", "word_length"])


def transform(x: np.ndarray) -> np.ndarray:
    """Shares by the square root of the arcsine kind, which evens out their variance; logs as they are; word length by its log."""
    out = np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    out[:, _LINEAR] = x[:, _LINEAR]
    k = NAMES.index("word_length")
    out[:, k] = np.log1p(x[:, k])
    return out


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # of class 0 and 1
    factors: np.ndarray  # inverses of the lower Cholesky factors
    logdets: np.ndarray
    slope: float
    shift: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        z = (transform(x) - self.centre) / self.scale
        dens = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.shift, -50, 50)))


@dataclass
class Constant:
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for P(y = 1) = s(a d + b) with a small ridge."""
    a = np.stack([d, np.ones_like(d)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, y: np.ndarray, pool: float = 0.1, ridge: float = 0.05) -> Discriminant | Constant:
    """``pool`` and ``ridge`` are the weights of the pooled covariance and of its scaled identity."""
    y = (y > 0).astype(float)
    if len(y) < 4 or min(y.sum(), (1 - y).sum()) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    t = transform(x)
    centre, scale = t.mean(axis=0), t.std(axis=0) + 1e-6
    z = (t - centre) / scale
    d = z.shape[1]
    parts = [z[y == k] for k in (0, 1)]
    covs = [np.cov(p, rowvar=False, bias=True).reshape(d, d) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(z)
    flat = np.eye(d) * np.trace(pooled) / d
    means, factors, logdets = [], [], []
    for p, c in zip(parts, covs, strict=True):
        chol = np.linalg.cholesky((1 - pool - ridge) * c + pool * pooled + ridge * flat + 1e-9 * np.eye(d))
        means.append(p.mean(axis=0))
        factors.append(np.linalg.solve(chol, np.eye(d)))
        logdets.append(2 * np.log(np.diag(chol)).sum())
    model = Discriminant(centre, scale, np.array(means), np.array(factors), np.array(logdets), 1.0, 0.0)
    model.slope, model.shift = _logistic(np.arcsinh(model.difference(x)), y)
    model.slope = max(model.slope, 0.0)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS):
    return fit(*training_rows(docs, labels, label, most_rows))


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = scored(docs, id_col, text_col, "doc_id long, score double", lambda counts, x: [pa.array(model.score(x))])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold."""
    return kept_rows(docs, text_col, lambda counts, x: model.score(x) >= threshold)
