"""Operator 4: language identification.

Method: language-bitmask n-gram filters.  A Bloom filter whose slots hold one bit for each
language is asked for every byte n-gram of a text; the AND of an n-gram's slots names all
languages that contain it.  Popcounts per language, corrected for the filter's false
positives, decide.

Training: all labelled texts are counted on the executors; an n-gram belongs to a language if it makes
up at least ``least_share`` of its n-grams.  So at most 1 / least_share n-grams of a
language reach the driver, and the filter that is broadcast has a fixed number of slots.

Predictions read the text only.  Null text, or text without a letter, is ``und`` with score
0; so is every text if nothing could be learned.  The score is the corrected share of the
n-grams that the predicted language contains.  Ties go to the language met more often in
training.  Repeated rows get the same prediction each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, fold, giving_back, map_rows, packed

GRAM = 4
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNDETERMINED = "und"
LEAST_SCORE = 0.5
FLUSH = 4_000_000  # n-grams that a task holds
STEPS = 10_000  # of a score, for its quantiles


def grams(text: str, n: int = GRAM) -> np.ndarray:
    """Byte n-grams of the lower-cased text, white space as single blanks, one blank at both ends."""
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw.ljust(n), np.uint8)
    g = a[: len(a) - n + 1].astype(np.uint32)
    for j in range(1, n):
        g = (g << np.uint32(8)) | a[j : len(a) - n + 1 + j]
    return g


@dataclass
class BitmaskFilter:
    langs: list[str]
    slots: np.ndarray  # (number of slots, bytes of a mask)
    false_rate: np.ndarray

    @classmethod
    def build(cls, langs: list[str], learned: list[np.ndarray], bits: int = 20) -> BitmaskFilter:
        slots = np.zeros((1 << bits, (len(langs) + 7) // 8), np.uint8)
        for i, g in enumerate(learned):
            for at in cls.places(g, bits):
                slots[at, i // 8] |= np.uint8(1 << (i % 8))
        fill = np.array([((slots[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(langs))])
        return cls(langs, slots, fill ** len(SEEDS))

    @staticmethod
    def places(g: np.ndarray, bits: int) -> list[np.ndarray]:
        wide = g.astype(np.uint64) + np.uint64(1)
        return [((wide * np.uint64(s)) >> np.uint64(64 - bits)).astype(np.int64) for s in SEEDS]

    def shares(self, g: np.ndarray) -> np.ndarray:
        """Share of the n-grams in each language, corrected for false positives."""
        bits = int(self.slots.shape[0]).bit_length() - 1
        first, *rest = self.places(g, bits)
        mask = self.slots[first]
        for at in rest:
            mask = mask & self.slots[at]
        counts = []
        for column in mask.T:
            of_mask = np.bincount(column, minlength=256)
            counts += [int(of_mask[(np.arange(256) >> b) & 1 == 1].sum()) for b in range(8)]
        share = np.array(counts[: len(self.langs)]) / len(g)
        return np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        share = self.shares(grams(text))
        best = int(np.argmax(share))
        return self.langs[best], float(share[best])


def learn(
    df: DataFrame,
    train: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    least_share: float = 2e-5,
    bits: int = 20,
    most_langs: int = 1024,
) -> BitmaskFilter:
    """Filter from the rows of ``df`` for which ``train`` holds; of more than ``most_langs`` values of the
    language column (a dirty one) the most frequent are learned."""
    rows = df.filter(train).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not sizes:
        return BitmaskFilter([], np.zeros((1, 1), np.uint8), np.zeros(0))
    rows = rows.filter(F.col("lang").isin(*sizes))
    out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        by: dict[str, list] = {}
        size = 0

        def made():
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], schema=out)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
                size += len(by[lang][-1])
                if size >= FLUSH:
                    yield from made()
                    by, size = {}, 0
        yield from made()

    counts = rows.mapInArrow(giving_back(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * least_share).select("lang", "gram")
    table = kept.toPandas()  # at most 1 / least_share rows of each language
    counts.unpersist()
    langs = sorted(sizes, key=lambda k: (-sizes[k], k))
    return BitmaskFilter.build(langs, [table.gram[table.lang == k].to_numpy(np.uint32) for k in langs], bits)


def predict(
    df: DataFrame, model: BitmaskFilter, text_col: str | tuple[str, str] = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``keep`` columns plus the predicted language and its score, under ``names``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = fields(f"`{names[0]}` string, `{names[1]}` double")

    def start():
        own = shared.value

        def kernel(texts):
            made = [own.predict(t) for t in texts]
            return {names[0]: [x for x, _ in made], names[1]: [x for _, x in made]}

        return kernel

    return map_rows(df, start, schema, [text_col], keep if keep is not None else ["doc_id"])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all."""
    rest = fold(F.col(id_col), modulus)
    model = learn(df, rest != held, text_col, lang_col)
    made = predict(df, model, text_col, [id_col])
    return made.select(id_col, (rest == held).alias("held_out"), "lang_pred", "score")


def held_out_bound(df: DataFrame, held: Column, model: BitmaskFilter, text_col: str = "text", lang_col: str = "lang") -> float:
    """Six tenths of the least 1 % quantile, over the learned languages, of the scores of held-out texts told right, as far
    as there are any; else LEAST_SCORE.  All texts of 400 characters or more count; scores are cut to steps of 1 / STEPS."""
    rows = df.filter(held & (F.length(text_col) >= 400)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    if not model.langs:
        return LEAST_SCORE
    told = predict(rows, model, "text", ["lang"]).filter("lang = lang_pred")
    bins = told.groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).count()  # at most STEPS + 1 of each language
    of_lang = Window.partitionBy("lang")
    ranks = bins.select("lang", "step", F.sum("count").over(of_lang.orderBy("step")).alias("so_far"), F.sum("count").over(of_lang).alias("all"))
    least = ranks.filter(100 * F.col("so_far") >= F.col("all")).groupBy("lang").agg(F.min("step").alias("q")).collect()
    return 0.6 * min((r["q"] / STEPS for r in least), default=LEAST_SCORE / 0.6)


def drop_unknown(df: DataFrame, model: BitmaskFilter, text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``df``, all columns, whose language is recognised: not ``und`` and a score of ``least_score`` or more, less
    1 / sqrt(characters), two deviations of a share of that many, so short texts are judged more mildly."""
    made = predict(packed(df), model, ("_row", text_col), ["_row"], ("_lang", "_score"))
    least = F.lit(least_score) - 1 / F.sqrt(F.greatest(F.length(F.col(f"_row.`{text_col}`")), F.lit(1)))
    return made.filter((F.col("_lang") != UNDETERMINED) & (F.col("_score") >= least)).select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])
