"""Operator 5: quality rules as weak supervision.

Method: rules vote good, bad or abstain on each document.  Expectation-maximisation
over the counts of vote patterns estimates the share of good documents and how each
rule votes on good and on bad ones (its accuracy); the posterior probability of good
replaces the demand that all rules pass.

A pattern of R rules with three votes is one of 3**R, so the table of pattern counts
that reaches the driver is bounded by the number of rules (59,049 rows for ten),
whatever the corpus holds.  Features and votes are computed once and written to the
shared folder; the counts cover all documents that pass the base test, which alone
need a verdict.

Words are maximal runs without ASCII white space.  A document fails the base test with
fewer than MIN_WORDS words, or if over 30 % of its words lie in 8-word windows that
the text holds twice or more.

Edge cases: null or empty text has no words and fails the base test; a repeated row is
judged like the first; with no documents the model is the starting point and the result empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, map_rows, stored

MIN_WORDS = 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, 2, 0
MAX_FALSE = 0.02
ASCII = bytes(range(128))
UPPER = bytes(range(65, 91))
PUNCTUATION = b".,;:!?\"'()"
SHAPE = bytes(97 if b > 127 or chr(b).isalpha() else b if chr(b) in " \t\n\r\x0b\x0c" else 35 for b in range(256))
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"
)


@dataclass(frozen=True)
class Rule:
    """Votes bad beyond ``bad`` and good within ``good``, abstains between; ``above`` says which side is bad."""

    name: str
    good: float
    bad: float
    above: bool = True
    least_words: int = 1

    def vote(self, x: float, n_words: int) -> int:
        if n_words < self.least_words:
            return ABSTAIN
        if self.above:
            return BAD if x > self.bad else GOOD if x <= self.good else ABSTAIN
        return BAD if x < self.bad else GOOD if x >= self.good else ABSTAIN


RULES = (
    Rule("length", good=50, bad=20, above=False),
    Rule("mean_word_chars", good=9.0, bad=14.0),
    Rule("stutter", good=0.05, bad=0.2, least_words=5),
    Rule("symbols_per_word", good=0.02, bad=0.1),
    Rule("upper_share", good=0.15, bad=0.4, least_words=5),
    Rule("dup_line_share", good=0.05, bad=0.3),
    Rule("repeat_share", good=0.1, bad=0.3),
    Rule("exclamations_per_word", good=0.03, bad=0.15),
    Rule("alpha_words", good=0.85, bad=0.6, above=False),
    Rule("distinct_words", good=0.25, bad=0.12, above=False, least_words=50),
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(window):
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    if not len(same):
        return 0
    starts = np.union1d(order[same], order[same + 1])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, lines = duplicate_lines(text)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > 30 * n
    m = max(n, 1)
    plain = raw.translate(SHAPE, PUNCTUATION)  # letters become a, digits and symbols #
    beyond = raw.translate(None, ASCII).decode("utf-8", "ignore")
    letters = max(plain.count(b"a"), 1)
    upper = len(raw) - len(raw.translate(None, UPPER)) + sum(map(str.isupper, beyond))
    x = (
        n,
        chars / m,
        sum(map(eq, words, words[1:])) / m,
        symbols / m,
        upper / letters,
        dup / max(lines, 1),
        repeat / m,
        text.count("!") / m,
        sum(map(bytes.isalpha, plain.split())) / m,
        len(set(words)) / m,
    )
    pattern = 0
    for rule, value in zip(RULES, x):
        pattern = pattern * 3 + rule.vote(value, n)
    return n, chars, symbols, dup, repeat, failed, pattern


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    out = np.empty((len(patterns), n_rules), np.int64)
    rest = patterns.copy()
    for r in range(n_rules - 1, -1, -1):
        rest, out[:, r] = np.divmod(rest, 3)
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int = len(RULES), rounds: int = 200, tol: float = 1e-9):
    """Share of good documents and, for each class and rule, the chance of each vote.

    Starts from the number of bad votes (none, one, more); chances are smoothed by one vote of each kind.  A rule
    is held to vote bad on at most MAX_FALSE of the good documents: that ties the classes to
    what the rules mean, as rules that fire on different kinds of bad documents do not agree."""
    if not len(patterns):
        return 0.5, np.full((2, n_rules, 3), 1 / 3)
    v = votes_of(patterns, n_rules)
    one_hot = np.eye(3)[v]
    post = np.array([0.95, 0.5, 0.05])[np.minimum((v == BAD).sum(1), 2)]
    last = -np.inf
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        chance = np.einsum("cp,prv->crv", weight, one_hot) + 1
        chance /= chance.sum(2, keepdims=True)
        over = chance[1, :, BAD] > MAX_FALSE
        rest = chance[1][over][:, [ABSTAIN, GOOD]]
        chance[1, over, BAD] = MAX_FALSE
        for r, pair in zip(np.flatnonzero(over), rest):
            chance[1, r, [ABSTAIN, GOOD]] = pair * (1 - MAX_FALSE) / pair.sum()
        log = np.log(chance)
        score = np.log([1 - share, share])[:, None] + np.einsum("crv,prv->cp", log, one_hot)
        top = score.max(0)
        total = top + np.log(np.exp(score - top).sum(0))
        post = np.exp(score[1] - total)
        now = float((counts * total).sum())
        if abs(now - last) <= tol * abs(now):
            break
        last = now
    return share, chance


def posterior(patterns: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    one_hot = np.eye(3)[votes_of(patterns, chance.shape[1])]
    score = np.log([1 - share, share])[:, None] + np.einsum("crv,prv->cp", np.log(chance), one_hot)
    return 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Base figures, pattern, ``quality`` (posterior probability of good) and ``kept`` of every row."""

    def start():
        def kernel(texts):
            made = [measure(t or "") for t in texts]
            return dict(zip(names, zip(*made))) if made else {k: [] for k in names}

        return kernel

    schema = fields(SCHEMA)
    names = schema.names
    measured = stored(map_rows(df, start, schema, [text_col], [id_col]))
    rows = measured.filter(~F.col("base_failed")).groupBy("pattern").count().collect()  # at most 3 ** len(RULES)
    patterns = np.array([r["pattern"] for r in rows], np.int64)
    share, chance = fit(patterns, np.array([r["count"] for r in rows], np.float64))
    table = list(zip(patterns.tolist(), posterior(patterns, share, chance).tolist())) if len(patterns) else []
    model = df.sparkSession.createDataFrame(table, "pattern int, quality double")
    return measured.join(F.broadcast(model), "pattern", "left").select(
        id_col,
        *[f for f in names if f not in ("base_failed", "pattern")],
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= threshold)).alias("kept"),
        "pattern",
        "quality",
    )
