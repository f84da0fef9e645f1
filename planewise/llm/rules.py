"""Quality rules: gradient-boosted trees over document statistics, with fixed base rules before them.

Trees of bounded depth are grown on histograms, one Newton step of the logistic loss each.  Chosen
inputs have monotonic effects: a split that breaks the sign is not taken, and the middle of a
split's two values bounds what lies below it.  The trees are flattened into node arrays
(feature, threshold, children, value) and scored level by level for all rows and trees at once.

Fitted on at most ``most_rows`` labelled documents (a documented bound).  Contract: null text has no
words and fails the base rules; without labels of both classes the trees are a constant; a null id is learned and judged like any
other; repeated rows are judged each for itself; texts are read whole, however long; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planewise.llm.docstats import BASE, NAMES, scored, training_rows

MOST_ROWS = 20_000
#: Kept are documents whose chance of label 1 is at least this.
KEEP = 0.3
#: More of these never makes a document better.
FALLING = ["symbol_share", "exclaim_share", "odd_share", "doubled_share", "repeat_share", "dup_line_share", "bare_share", "top_share"]
MIN_WORDS, REPEAT_PERCENT = 20, 30


@dataclass
class Trees:
    feature: np.ndarray  # (trees, nodes); -1 at leaves
    threshold: np.ndarray
    left: np.ndarray  # the right child is the next node
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, l, v in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                right = x[rows, np.maximum(f[at], 0)] > t[at]
                at = np.where(inner, l[at] + right, at)
            out += v[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _best(hist: np.ndarray, signs: np.ndarray, lo: float, hi: float, ridge: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node; ``hist`` is (features, bins, 2) of gradient and hessian."""
    cum = hist.cumsum(axis=1)
    total = cum[:1, -1:, :]
    left, right = cum[:, :-1], total - cum[:, :-1]
    value = lambda p: np.clip(-p[..., 0] / (p[..., 1] + ridge), lo, hi)
    gain_of = lambda p, v: -(p[..., 0] * v + 0.5 * (p[..., 1] + ridge) * v * v)
    vl, vr = value(left), value(right)
    gain = gain_of(left, vl) + gain_of(right, vr) - gain_of(total, value(total))
    bad = (left[..., 1] < least) | (right[..., 1] < least) | (signs[:, None] * (vr - vl) < 0)
    gain[bad] = -np.inf
    k = int(np.argmax(gain))
    f, b = divmod(k, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else None


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0, falling: list[str] = FALLING) -> Trees:
    y = (y > 0).astype(float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    size = 2 ** (depth + 1) - 1
    shape = (trees if 0 < y.sum() < len(y) else 0, size)
    model = Trees(np.full(shape, -1), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape), float(np.log(share / (1 - share))), depth)
    if not shape[0]:
        return model
    signs = np.where(np.isin(NAMES, falling), -1, 0)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)  # x > cuts[b] is code > b
    flat = code + np.arange(d) * bins
    margin = np.full(n, model.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes = [(0, np.arange(n), -np.inf, np.inf, 0)]
        used = 1
        while nodes:
            at, rows, lo, hi, level = nodes.pop()
            value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + ridge), lo, hi))
            model.value[t, at] = rate * value
            if level == depth:
                margin[rows] += rate * value
                continue
            keys = flat[rows].ravel()
            hist = np.stack([np.bincount(keys, np.repeat(w[rows], d), d * bins).reshape(d, bins) for w in (grad, hess)], axis=2)
            best = _best(hist, signs, lo, hi, ridge, least)
            if best is None:
                margin[rows] += rate * value
                continue
            _, f, b = best
            right = code[rows, f] > b
            model.feature[t, at], model.threshold[t, at], model.left[t, at] = f, cuts[f][min(b, len(cuts[f]) - 1)], used
            a, z = rows[~right], rows[right]
            both = [float(np.clip(-grad[r].sum() / (hess[r].sum() + ridge), lo, hi)) for r in (a, z)]
            mid = sum(both) / 2
            bounds = [(lo, hi), (lo, hi)] if not signs[f] else [(mid, hi), (lo, mid)]
            nodes += [(used, a, *bounds[0], level + 1), (used + 1, z, *bounds[1], level + 1)]
            used += 2
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Trees:
    return fit(*training_rows(docs, labels, label, most_rows))


RULED = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"


def apply_rules(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The five counts, the base verdict and the trees' of every row."""

    def kernel(counts: np.ndarray, x: np.ndarray) -> list[pa.Array]:
        words, repeated = counts[:, 0], counts[:, BASE.index("n_repeat_words")]
        failed = (words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * words)
        score = model.score(x)
        return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (score >= keep)), pa.array(score)]

    return scored(docs, id_col, text_col, RULED, kernel)
