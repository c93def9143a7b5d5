"""Operator 10: mixing sources to target weights (DataFrame functions only).

Method: soft-membership mixing.  A naive Bayes classifier fitted on the labelled table gives
every document a posterior over the domains; projected gradient descent then fits
nonnegative rates r of the documents so that the expected tokens of each domain,
sum(r * tokens * posterior), match the targets in the least-squares sense

    minimise  1/2 * sum over domains of (share(r) - target)**2 / share(1),   r >= 0.

In the metric that weighs documents by their tokens the step of a document is
posterior . (share - target) / share(1); a step of 1 never overshoots, as the posteriors of
a document sum to 1.  Steps are accelerated by momentum.  A round is one aggregate of a few numbers a document: the driver
holds the residual of each domain, and a document's rate is replayed from the residuals so
far, so rounds write nothing and need no shuffle but that of a row for each task.

The classifier sees hashed distinct words and four figures of a text.  It is fitted on all labelled documents or,
if ``max_labelled`` is set, on about so many chosen by a hash, with word
counts by domain and bucket aggregated on the executors: domains * BUCKETS numbers.  Only
codes whose odds differ beyond chance are kept.

Edge cases: null or empty text has no tokens and the prior as posterior; labels without a
domain or a document count for nothing; a document labelled twice takes its least domain;
domains without any expected token are left out and the other targets scaled up; no labels:
every document keeps rate 1; repeated rows get the same rate each; a tie of two domains goes
to the one with more labels; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import let

BUCKETS = 1 << 16  # a power of two
BINS = 8
BROADCAST = 200_000  # labels that are sent to every executor; more are joined by a shuffle
CLIP = 4.0
MARKS = "[#*$%&|<>!]"
PUNCTUATION = ".,;:!?\"'()[]"


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def evidence(text: Column, words: Column) -> Column:
    """Codes of a text: a bucket for each distinct word without the punctuation at its ends, and behind BUCKETS a bin
    for each figure (share of marks, of capitals and of distinct words, and length)."""
    text = F.coalesce(text, F.lit(""))
    share_of = lambda which: F.regexp_count(text, F.lit(which)) / F.greatest(F.length(text), F.lit(1))
    log_bin = lambda x: F.floor(F.log2(1 + 200 * x))

    def codes(distinct: Column) -> Column:
        values = [
            log_bin(share_of(MARKS)),
            log_bin(share_of("[A-Z]")),
            F.floor(BINS * F.size(distinct) / F.greatest(F.size(words), F.lit(1))),
            F.floor(F.log2(F.lit(1) + F.size(words)) / 2),
        ]
        figures = [F.lit(BUCKETS + BINS * i) + F.least(F.lit(BINS - 1), v.cast("int")) for i, v in enumerate(values)]
        bucket = lambda x: F.xxhash64(F.btrim(x, F.lit(PUNCTUATION))).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        return F.concat(F.array_distinct(F.transform(distinct, bucket)), F.array(*figures))

    return let(F.array_distinct(words), codes)


def numbers(values: np.ndarray) -> Column:
    """The values as one array literal."""
    return F.from_json(F.lit(json.dumps([float(f"{v:.6g}") for v in values])), "array<double>")


@dataclass
class DomainModel:
    """Prior log odds of each domain against the first, and the log odds of every code (0 for those that tell nothing)."""

    domains: list[str]
    prior: list[float]
    odds: np.ndarray  # (domains but the first, codes)

    def posterior(self, text: Column, words: Column) -> Column:
        """array<double>, one for each domain, that sums to 1."""
        if len(self.domains) < 2:
            return F.array(*[F.lit(1.0) for _ in self.domains])
        telling = numbers(np.abs(self.odds).max(0) > 0)

        def scores(codes: Column) -> Column:
            total = lambda table: F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.get(table, c))
            return F.array(F.lit(0.0), *[F.lit(p) + total(numbers(o)) for p, o in zip(self.prior[1:], self.odds)])

        def soft(s: Column) -> Column:
            top = F.array_max(s)
            return let(F.transform(s, lambda x: F.exp(x - top)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

        return let(let(F.filter(evidence(text, words), lambda c: F.get(telling, c) > 0), scores), soft)


def fit_domains(
    df: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", max_labelled: int | None = 20_000
) -> DomainModel:
    known = labels.select(F.col(id_col).alias("_id"), domain.alias("_domain")).filter("_id is not null and _domain is not null")
    known = known.groupBy("_id").agg(F.min("_domain").alias("_domain"))
    sizes = {r["_domain"]: r["count"] for r in known.groupBy("_domain").count().collect()}  # a row for each domain
    domains = sorted(sizes, key=lambda d: (-sizes[d], d))
    if len(domains) < 2:
        return DomainModel(domains, [0.0] * len(domains), np.zeros((0, 0)))
    taken = sum(sizes.values())
    if max_labelled is not None:
        draw = F.pmod(F.xxhash64("_id", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        known, taken = known.filter(draw < max_labelled / taken).limit(2 * max_labelled), min(taken, 2 * max_labelled)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known) if taken <= BROADCAST else known, "_id")
    seen = docs.select("_domain", F.explode(let(words_of(F.col("_text")), lambda w: evidence(F.col("_text"), w))).alias("c")).groupBy("_domain", "c").count()
    size = BUCKETS + 4 * BINS
    counts = np.zeros((len(domains), size))
    for d, c, n in seen.collect():  # at most domains * size
        counts[domains.index(d), c] = n
    # Words are compared within all words of a domain, so that longer texts are no evidence; bins within their figure.
    total = np.empty_like(counts)
    total[:, :BUCKETS] = counts[:, :BUCKETS].sum(1, keepdims=True)
    for i in range(BUCKETS, size, BINS):
        total[:, i : i + BINS] = counts[:, i : i + BINS].sum(1, keepdims=True)
    pooled = counts.sum(0) / np.maximum(total.sum(0), 1)
    expected = total * pooled
    telling = np.abs(counts - expected) > 6 * np.sqrt(expected + 0.5)  # beyond chance, as there are many codes
    rate = (counts + 0.02 * expected + 1e-9) / (total * 1.02 + 1e-9)
    raw = np.where((telling | telling[0]) & (pooled > 0), np.clip(np.log(rate / rate[0]), -CLIP, CLIP), 0.0)
    codes = np.flatnonzero(np.abs(raw).max(0) > 0.3)
    odds = raw[1:, codes]
    prior = np.array([math.log((sizes[d] + 1) / (sizes[domains[0]] + 1)) for d in domains])
    # A telling word that is absent is evidence as well: its share goes into the prior and is taken off where it occurs.
    n = total[:, BUCKETS : BUCKETS + 1]  # documents of a domain, as each has one bin of a figure
    word = codes < BUCKETS
    there = (counts[:, codes[word]] + 0.5) / (n + 1)
    missing = np.log1p(-there) - np.log1p(-there[0])
    prior += missing.sum(1)
    odds[:, word] = np.clip(np.log(there / there[0]), -CLIP, CLIP)[1:] - missing[1:]
    table = np.zeros((len(domains) - 1, size))
    table[:, codes] = odds
    return DomainModel(domains, prior.tolist(), table)


def momentum(n: int) -> list[float]:
    """Weights of the previous move before each of ``n`` steps (accelerated projected gradient)."""
    out, t = [], 1.0
    for _ in range(n):
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        out.append((t - 1) / after if out else 0.0)
        t = after
    return out


def replay(posterior: Column, steps: list[list[float]], ahead: bool) -> Column:
    """A document's rate after the given steps (a number for each domain), each projected to r >= 0.

    ``ahead``: the point from which the next step starts, beyond the rate by the momentum."""
    weights = momentum(len(steps) + 1)
    if not steps:
        return F.lit(1.0)
    rows = ",".join(f"named_struct('b', {b:.12g}D, 'g', array({','.join(f'{x:.12g}D' for x in s)}))" for b, s in zip(weights, steps))
    dot = lambda g: F.aggregate(F.zip_with(posterior, g, lambda p, x: p * x), F.lit(0.0), lambda a, y: a + y)

    def step(state: Column, move: Column) -> Column:
        start = state["r"] + move["b"] * (state["r"] - state["q"])
        return F.struct(F.greatest(F.lit(0.0), start - dot(move["g"])).alias("r"), state["r"].alias("q"))

    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q"))
    end = (lambda s: s["r"] + F.lit(weights[-1]) * (s["r"] - s["q"])) if ahead else (lambda s: s["r"])
    return F.aggregate(F.expr(f"array({rows})"), start, step, end)


def shares(docs: DataFrame, rate: Column, size: int) -> tuple[int, list[float]]:
    """Tokens of ``docs`` (n_tokens, posterior), and the expected tokens of each domain at the given rates as shares of them."""
    weighed = docs.select((F.col("n_tokens") * rate).alias("t"), "n_tokens", "posterior")
    row = weighed.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("t") * F.get("posterior", F.lit(i))).alias(f"d{i}") for i in range(size)]).first()
    n = row["n"] or 0
    return n, [row[f"d{i}"] / n if n else 0.0 for i in range(size)]


def fit_rates(docs: DataFrame, targets: list[float], max_rounds: int = 40, tolerance: float = 1e-3) -> tuple[list[list[float]], float]:
    """Steps of accelerated projected gradient descent over ``docs`` (n_tokens, posterior), and the largest difference
    between a target and the share that the fitted rates give.

    Ends when every share is within ``tolerance`` of its target (of 0.01 at least), when the loss has not moved for five
    rounds (targets that no rates can meet), or after ``max_rounds``; what is left is the second result."""
    size = len(targets)
    steps: list[list[float]] = []
    loss: list[float] = []
    n, base = shares(docs, F.lit(1.0), size)
    if not n:
        return [], 0.0
    scale = sum(t for t, b in zip(targets, base) if b > 0) or 1.0
    targets = [t / scale if b > 0 else 0.0 for t, b in zip(targets, base)]
    share = base
    while True:
        residual = [s - t for s, t in zip(share, targets)]
        loss.append(sum(x * x / b for x, b in zip(residual, base) if b > 0))
        still = len(loss) > 5 and abs(loss[-6] - loss[-1]) <= tolerance * loss[-6]
        if still or all(abs(x) <= tolerance * max(t, 0.01) for x, t in zip(residual, targets)) or len(steps) >= max_rounds:
            break
        steps.append([x / b if b > 0 else 0.0 for x, b in zip(residual, base)])
        _, share = shares(docs, replay(F.col("posterior"), steps, ahead=True), size)
    _, share = shares(docs, replay(F.col("posterior"), steps, ahead=False), size)
    return steps, max(abs(s - t) for s, t in zip(share, targets))


def mix(
    df: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rounds: int = 40,
    keep: list[str] | None = None,
    max_labelled: int | None = 20_000,
) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) in ``_row``, with n_tokens (words), domain (the likeliest), posterior and
    rate of every row, and the residual of the fit, the same in every row.  All but the rate is computed once and written
    to the shared folder.

    ``targets``: share of the expected tokens for each domain; domains that are not named get none."""
    model = fit_domains(df, labels, domain, id_col, text_col, max_labelled)
    text = F.col(f"`{text_col}`")
    made = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), model.posterior(text, w).alias("posterior")))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("_row"), made.alias("_made"))
    whole = whole.select("_row", F.col("_made.n").alias("n_tokens"), F.col("_made.posterior").alias("posterior"))
    if not model.domains:
        return whole.select(
            "_row", "n_tokens", F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(0.0).alias("residual")
        )
    whole = stored(whole)
    steps, residual = fit_rates(whole, [targets.get(d, 0.0) for d in model.domains], max_rounds)
    names = F.array(*[F.lit(d) for d in model.domains])
    return whole.select(
        "_row",
        "n_tokens",
        F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")).alias("domain"),
        "posterior",
        replay(F.col("posterior"), steps, ahead=False).alias("rate"),
        F.lit(residual).alias("residual"),
    )


def label_domain() -> Column:
    """Domain of a row of ``labels``."""
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "plain")


TARGETS = {"plain": 0.97, "low": 0.02, "toxic": 0.01}
