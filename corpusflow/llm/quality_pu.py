"""Operator 3: quality classifier by positive-unlabelled learning.

Method: a logistic model over binned text figures minimises the non-negative unbiased
risk  pi * R+(1) + max(0, Ru(0) - pi * R+(0))  from trusted positives (labels of 1) and
unlabelled web text; labels of 0 are never used.  The class prior pi is estimated first: a
plain model of trusted against unlabelled ranks texts, and pi is the least ratio of the
unlabelled share to the trusted share above a threshold, as unlabelled text holds at least
pi times the trusted share in any region.

Figures are measured once for all rows and written to the shared folder (a few numbers a
row).  The fit is on the driver, from at most ``max_rows`` trusted and ``max_rows``
unlabelled rows chosen by a hash, of FIGURES numbers each.  Scores read the text only.

Edge cases: null text is scored as empty; without a trusted row every score is 0.5; labels
of other documents, null labels and repeated labels change nothing; repeated rows get the same
score each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, fold, map_rows, stored
from .quality_rules import ASCII, PUNCTUATION, SHAPE, SYMBOLS, UPPER, duplicate_lines, repeated_words

FIGURES = (
    "words", "word_chars", "stutter", "symbols", "upper", "dup_lines", "repeats", "exclaims",
    "alpha", "distinct", "digits", "line_words", "ends", "commas",
)
BINS = 12


def figures(text: str) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    m = max(n, 1)
    plain = raw.translate(SHAPE, PUNCTUATION)
    beyond = raw.translate(None, ASCII).decode("utf-8", "ignore")
    upper = len(raw) - len(raw.translate(None, UPPER)) + sum(map(str.isupper, beyond))
    dup, lines = duplicate_lines(text)
    return (
        np.log1p(n),
        sum(map(len, words)) / m,
        sum(map(eq, words, words[1:])) / m,
        sum(text.count(c) for c in SYMBOLS) / m,
        upper / max(plain.count(b"a"), 1),
        dup / max(lines, 1),
        repeated_words(words) / m,
        text.count("!") / m,
        sum(map(bytes.isalpha, plain.split())) / m,
        len(set(words)) / m,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / m,
        n / max(lines, 1),
        text.count(".") / m,
        text.count(",") / m,
    )


@dataclass
class Additive:
    """A weight for each bin of each figure: a logistic model over one-hot bins."""

    edges: np.ndarray  # (figures, bins - 1)
    weights: np.ndarray  # (figures, bins)
    bias: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margin(self, codes: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(codes.shape[1]), codes].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.codes(x)), -50, 50)))


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Quantile edges, denser in the tails, where unusual texts are."""
    return np.quantile(x, [0.01, 0.03, 0.06, 0.12, 0.3, 0.5, 0.7, 0.88, 0.94, 0.97, 0.99], axis=0).T


def descend(model: Additive, groups: list[np.ndarray], gradient, rounds: int, rate: float = 0.1, decay: float = 1e-3) -> Additive:
    """Adam over the bin weights.  ``gradient`` turns the margins of the groups into their derivatives."""
    k, bins = model.weights.shape
    flat = [c + np.arange(k) * bins for c in groups]
    theta = np.append(model.weights.ravel(), model.bias)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        slope = decay * theta
        slope[-1] = 0
        for f, d in zip(flat, gradient([theta[f].sum(1) + theta[-1] for f in flat])):
            slope[:-1] += np.bincount(f.ravel(), np.repeat(d, k), minlength=k * bins)
            slope[-1] += d.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Additive(model.edges, theta[:-1].reshape(k, bins), float(theta[-1]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def estimate_prior(trusted: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """Least ratio of the unlabelled to the trusted share above a threshold, over thresholds that
    keep at least ``least`` of the trusted rows."""
    cuts = np.quantile(trusted, np.linspace(0.0, 1 - least, 71))
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    p = 1 - np.searchsorted(np.sort(trusted), cuts, side="left") / len(trusted)
    return float(np.clip(np.min(u / np.maximum(p, 1e-9)), 0.05, 0.99))


def fit(trusted: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> tuple[Additive, float]:
    empty = Additive(np.zeros((len(FIGURES), BINS - 1)), np.zeros((len(FIGURES), BINS)), 0.0)
    if not len(trusted) or not len(unlabelled):
        return empty, 0.5
    empty.edges = bin_edges(np.concatenate([trusted, unlabelled]))
    p, u = empty.codes(trusted), empty.codes(unlabelled)
    plain = descend(empty, [p, u], lambda z: [-sigmoid(-z[0]) / len(p) / 2, sigmoid(z[1]) / len(u) / 2], rounds // 2)
    prior = estimate_prior(plain.margin(p), plain.margin(u))

    def gradient(z):
        """Of the non-negative risk; where the estimated negative risk is below 0, it is raised instead."""
        negative = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        up_p, up_u = sigmoid(z[0]) / len(p), sigmoid(z[1]) / len(u)
        if negative < 0:
            return [prior * up_p, -up_u]
        return [-prior * sigmoid(-z[0]) / len(p) - prior * up_p, up_u]

    return descend(empty, [p, u], gradient, rounds), prior


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: Column | None = None,
    modulus: int = 5,
    held: int = 0,
    threshold: float = 0.3,
    max_rows: int = 40_000,
) -> DataFrame:
    """Score of every row of ``df``, learned from rows outside the held-out fold whose ``labels`` row is 1."""
    measures = [f"_{f}" for f in FIGURES]
    schema = fields(", ".join(f"{m} float" for m in measures))

    def start():
        def kernel(texts):
            rows = [figures(t or "") for t in texts]
            return dict(zip(measures, zip(*rows))) if rows else {m: [] for m in measures}

        return kernel

    table = stored(map_rows(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), start, schema, ["_text"], ["_id"]))
    train = table.filter(fold(F.col("_id"), modulus) != held)
    good = labels.filter((F.col("quality") if label is None else label) == 1).select(F.col(id_col).alias("_id")).distinct()

    def sample(rows: DataFrame) -> np.ndarray:
        n = rows.count()
        draw = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = rows.filter(draw < max_rows / max(n, 1)).select(*measures).limit(2 * max_rows)
        return picked.toPandas().to_numpy(np.float64)

    model, _ = fit(sample(train.join(good, "_id", "left_semi")), sample(train))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start_score():
        own = shared.value

        def kernel(*columns):
            return {"score": own.score(np.array(columns, np.float64).T).tolist() if columns[0] else []}

        return kernel

    made = map_rows(table, start_score, fields("score double"), measures, ["_id"])
    return made.select(
        F.col("_id").alias(id_col),
        (fold(F.col("_id"), modulus) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
