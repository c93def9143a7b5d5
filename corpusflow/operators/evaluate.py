"""Retrieval evaluation: does a hit of the first k match what a case expects?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact


ATOMIC = "atomic"


def haystack(*parts: Column, payloads: tuple[Column, ...] = ()) -> Column:
    """Lower-cased parts and JSON of the payloads, nulls and key names included."""
    as_json = [F.to_json(p, {"ignoreNullFields": "false"}) for p in payloads]
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts], *as_json))


def matched_keywords(hay: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda k: F.contains(hay, F.lower(k)))


def matches(hay: Column, keywords: Column, corpus: Column, chunk_type: Column, types: Column) -> Column:
    """A keyword is in the haystack and, for atomic chunks, the type is one of those expected, if any; case does not count."""
    hit = F.size(matched_keywords(hay, keywords)) > 0
    typed = (corpus == ATOMIC) & (F.size(F.coalesce(types, F.array().cast("array<string>"))) > 0)
    return hit & (~typed | F.coalesce(F.array_contains(F.transform(types, F.lower), F.lower(chunk_type)), F.lit(False)))


def ad_hoc_cases(queries: DataFrame) -> DataFrame:
    """Cases without expectations for ``queries`` (number, query): name, query, keywords, types."""
    none = F.array().cast("array<string>")
    return queries.select(F.concat(F.lit("custom-"), F.col("number")).alias("name"), "query", none.alias("keywords"), none.alias("types"))


def run_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, corpus, passed): any hit matches; a case without keywords passes.

    ``cases``: query, keywords, types; ``hits``: query, corpus, haystack, chunk_type."""
    corpora = hits.select("corpus").distinct()
    found = hits.join(cases, "query").select("query", "corpus", matches(F.col("haystack"), F.col("keywords"), F.col("corpus"), F.col("chunk_type"), F.col("types")).alias("m"))
    best = found.groupBy("query", "corpus").agg(F.bool_or("m").alias("m"))
    every = cases.select("query", "keywords", F.explode(F.array(*[F.lit(r["corpus"]) for r in corpora.collect()])).alias("corpus"))  # a row for each corpus
    return every.join(best, ["query", "corpus"], "left").select("query", "corpus", ((F.size("keywords") == 0) | F.coalesce("m", F.lit(False))).alias("passed"))


def pass_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("corpus").agg(F.count_if("passed").alias("passed"), F.count("*").alias("cases"))


def location(level: Column, doc_id: Column, page_no: Column, first: Column, last: Column) -> Column:
    """Document and page, or the pages of a semantic chunk."""
    pages = F.when(level == "semantic", F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise(page_no.cast("string"))
    return F.concat(doc_id.cast("string"), F.lit(" p"), pages)


def formatted(results: DataFrame, limit: int = 260) -> DataFrame:
    """Fused results (level, doc_id, page_no, page_start, page_end, text) for display: where they stand, and the text cut to ``limit``."""
    where = location(*[F.col(c) for c in ("level", "doc_id", "page_no", "page_start", "page_end")])
    return results.withColumn("location", where).withColumn("text", compact(F.col("text"), limit))
