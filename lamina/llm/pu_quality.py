"""Quality classifier from positive and unlabelled texts.

Trusted positives and plain web texts are all it learns from: the share of good
texts among the web texts (the class prior) is estimated, and the non-negative
unbiased risk of du Plessis, Niu, Kiryo and Sugiyama is minimised, in which the
web texts less the positives among them stand for the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Most texts of the training sample: trusted positives, unlabelled.
POSITIVES, UNLABELLED = 4000, 12000
#: Bins of each feature; rounds, step and weight decay of the minimiser.
BINS, ROUNDS, STEP, DECAY = 10, 400, 0.05, 1e-3
#: Rounds and weight decay of the second part, with the sigmoid loss.
FINE_ROUNDS, FINE_DECAY = 300, 1e-4

_UPPER, _DIGIT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"
FEATURES = ("words", "word_length", "distinct", "pairs", "upper", "digits", "symbols", "shouts", "exclaims", "stops", "commas", "bars", "runs", "lines", "same_lines", "packed", "line_words", "last_stop")


def features(text: str | None) -> list[float]:
    """Ratios that hold at any length, of the whole text; all zero if empty."""
    data = text.encode("utf-8", "replace") if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda chars: size - len(data.translate(None, chars))
    return [
        math.log(n), (size - n) / n, len(set(words)) / n**0.9, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        count(_UPPER) / size, count(_DIGIT) / size, count(_SYMBOL) / n, data.count(b"!!") / n, data.count(b"!") / n, data.count(b".") / n, data.count(b",") / n,
        data.count(b"|") / n, sum(data.count(bytes([c]) * 3) for c in _SYMBOL) / n, math.log(len(lines)), 1 - len(set(lines)) / len(lines),
        len(_packer().compress(data)) / size, math.log(n / len(lines)), float(data.rstrip()[-1:] == b"."),
    ]


_PACKER: list = []


def _packer() -> zstandard.ZstdCompressor:
    if not _PACKER:
        _PACKER.append(zstandard.ZstdCompressor(level=1))
    return _PACKER[0]


@dataclass
class Model:
    """Bin edges by feature and a weight per bin."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.weights[-1])
        width = self.edges.shape[1] + 1
        for j in range(self.edges.shape[0]):
            out += self.weights[j * width + np.searchsorted(self.edges[j], x[:, j], side="right")]
        return out


def _one_hot(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    width = edges.shape[1] + 1
    out = np.zeros((len(x), edges.shape[0] * width + 1), np.float32)
    for j in range(edges.shape[0]):
        out[np.arange(len(x)), j * width + np.searchsorted(edges[j], x[:, j], side="right")] = 1
    out[:, -1] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, rounds: int, decay: float, slope) -> np.ndarray:
    """Adam on the non-negative risk prior * E_p[l(g)] + max(0, E_u[l(-g)] -
    prior * E_p[l(-g)]); where the bracket is negative its gradient is followed
    upward instead. ``slope``: of g, the loss l(-g), its slope in g, and that of l(g)."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        (lp, up_p, down_p), (lu, up_u, _) = slope(p @ w), slope(u @ w)
        of_negative = u.T @ up_u / np.float32(len(u)) - np.float32(prior) * (p.T @ up_p) / np.float32(len(p))
        of_positive = np.float32(prior) * (p.T @ down_p) / np.float32(len(p))
        grad = (of_positive + of_negative if lu.mean() >= prior * lp.mean() else -of_negative) + np.float32(decay) * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = (w - STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return w


def _logistic(g: np.ndarray):
    return np.logaddexp(0, g), _sigmoid(g), -_sigmoid(-g)


def _zero_one(g: np.ndarray):
    s = _sigmoid(g)
    return s, s * (1 - s), -s * (1 - s)


def minimise(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of least risk: with the logistic loss first, which is convex for
    the positives, then from there with the sigmoid loss, which is bounded and so
    takes no harm from the positives among the unlabelled."""
    w = _descend(p, u, prior, np.zeros(p.shape[1], np.float32), rounds, DECAY, _logistic)
    return _descend(p, u, prior, w, FINE_ROUNDS, FINE_DECAY, _zero_one)


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives in u (best bin estimation): one half trains a
    classifier of p against u; on the other, take the top scores at which u has
    the fewest texts for each of p, with allowance for chance."""
    half = lambda x, k: x[k::2]
    w = _descend(half(p, 0), half(u, 0), 0.5, np.zeros(p.shape[1], np.float32), 150, DECAY, _logistic)
    zp, zu = np.sort(half(p, 1) @ w)[::-1], np.sort(half(u, 1) @ w)[::-1]
    if not len(zp) or not len(zu):
        return 0.5
    allowance = math.sqrt(math.log(4 / confidence) / 2 / len(zp)) + math.sqrt(math.log(4 / confidence) / 2 / len(zu))
    best = (math.inf, 1.0)
    for cut in zp[max(0, len(zp) // 20) :: max(1, len(zp) // 200)]:
        qp, qu = np.mean(zp >= cut), np.mean(zu >= cut)
        best = min(best, ((qu + allowance) / qp, qu / qp))
    return float(min(0.99, max(0.01, best[1])))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """p, u: feature rows. Without positives or without unlabelled texts nothing can be learnt: score 0.5."""
    if not len(p) or not len(u):
        return Model(np.zeros((len(FEATURES), BINS - 1)), np.zeros(len(FEATURES) * BINS + 1, np.float32), 0.5)
    edges = np.quantile(np.concatenate([p, u]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    edges[:, -1] = np.quantile(np.concatenate([p, u]), 0.97, axis=0)
    hp, hu = _one_hot(edges, p), _one_hot(edges, u)
    prior = estimate_prior(hp, hu)
    return Model(edges, minimise(hp, hu, prior), prior)


def _lowest(rows: DataFrame, most: int, what: Column) -> DataFrame:
    """``what`` of the ``most`` rows with the lowest hashes ``h``, equal ones once. A limit on
    the hash, by the number of different ones, leaves few more; ``what`` is computed of
    these, in parallel, before they are sorted."""
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    near = rows.filter(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 1.5 * most / max(1, n)) * (1 << 30))).select("h", what.alias("x"))
    return near.dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(most).select("x")


def sample(docs: DataFrame, positives: DataFrame, *, text: str = "text", key: str = "doc_id", most_p: int = POSITIVES, most_u: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of at most most_p texts whose key is in ``positives`` and most_u of
    all texts: those lowest by a hash of key and text, equal rows once.

    So neither repeated keys nor null ones change the bound or empty the sample; a
    null key is no positive's. Texts become features where they lie; the driver gets these alone."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("row")).alias("h"))
    named = positives.select(F.col(key).alias("p")).filter("p IS NOT NULL").withColumn("h", F.xxhash64(F.col("p").cast("string"), F.lit("p")))
    trusted = rows.join(F.broadcast(_lowest(named, most_p, F.col("p"))), F.col("k") == F.col("x"), "left_semi")  # most_p ids
    pick = lambda own, most: np.array([r[0] for r in _lowest(own, most, vector(F.col("t"))).collect()], float).reshape(-1, len(FEATURES))
    return pick(trusted, most_p), pick(rows, most_u)


def vector(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch], dtype=object)

    return run(text)


def score(model: Model, text: Column) -> Column:
    """Probability of good quality, of whole texts. Null and empty texts have a
    score like any other (all features zero)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t) for t in batch], float).reshape(-1, len(FEATURES))
            yield pd.Series(_sigmoid(model.logits(x)))

    return run(text)


def classify(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with its score (replacing a column of that name). Rows are
    independent; repeated rows, null ids and an empty table need no care."""
    return docs.withColumn(into, score(model, F.col(text)))
