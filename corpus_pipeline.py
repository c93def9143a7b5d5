"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again
as the next one's documents.

1. language_id drops documents whose language is not recognised.
2. near_duplicates keeps one document of each group.
3. decontamination drops documents that hold a benchmark passage.
4. secret_scan replaces secrets in the text (and sets ``n_chars`` anew); no document goes.
5. source_mixing adds tokens, likeliest domain and sampling rate of every document.

No SQL can express stages 1, 4 and 5, so there is no ORACLE_SQL; tests/llm/test_pipeline.py compares
every stage with a brute-force version.

Null texts and texts without letters have no language and go in stage 1, so later stages see none; an
empty table stays empty; columns beyond those of ``documents`` are carried along; the columns that
stage 5 adds get an underscore in front as long as their name is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, langid, mixing, neardup, secret_scan
from corpusflow.llm.common import discard, fold, read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 4) == 2
    model = langid.learn(docs, ~held)
    return langid.drop_unknown(docs, model, least_score=langid.held_out_bound(docs, held, model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = mixing.mix(docs, read_table(spark, sf_dir, "labels"), mixing.label_domain(), mixing.TARGETS, max_labelled=None)
    return made.select("_row.*", *[F.col(c).alias(unused(f"mix_{c}", docs.columns)) for c in ("n_tokens", "domain", "rate")])


def unused(name: str, taken: list[str]) -> str:
    while name.lower() in map(str.lower, taken):
        name = f"_{name}"
    return name


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("source_mixing", source_mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
