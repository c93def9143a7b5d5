"""Evaluation queries: does BM25 find a document that holds the first words of the item asked for?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, keyword_tokens
from ..operators import evaluate, retrieval
from .retrieval import BM25, TOKENS, _asked, _docs
from .tables import table


TYPES = ("EN", "De")


def eval_pass_counts(spark: SparkSession, d: str) -> DataFrame:
    """The language stands for the type of a chunk; every other case expects two of them, which counts for atomic chunks only."""
    asked = _asked(spark, d)
    top = retrieval.ranked(retrieval.bm25(_docs(spark, d), asked).withColumn("score", F.round("score", 9)), 5)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.struct("source", F.lit(None).cast("string").alias("nothing")).alias("payload"))
    hits = top.join(docs, "id").select(
        "query", F.explode(F.array(F.lit("atomic"), F.lit("semantic"))).alias("corpus"), evaluate.haystack(F.col("lang"), F.col("text"), payloads=(F.col("payload"),)).alias("haystack"), F.col("lang").alias("chunk_type")
    )
    items = table(spark, d, "benchmark").filter("item_id % 20 = 0")
    types = F.when(F.col("item_id") % 40 == 0, F.array(*[F.lit(t) for t in TYPES])).otherwise(F.array().cast("array<string>"))
    cases = items.select(F.col("item_id").alias("query"), F.slice(keyword_tokens(F.col("text")), 1, 3).alias("keywords"), types.alias("types"))
    return evaluate.pass_counts(evaluate.run_cases(cases, hits))


def result_locations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, "semantic").otherwise("atomic").alias("level"), "doc_id", (F.col("doc_id") % 7).alias("page_no"), (F.col("doc_id") % 5).alias("page_start"), (F.col("doc_id") % 5 + 2).alias("page_end"), "text"
    )
    return evaluate.formatted(docs).select("doc_id", "location", "text")


def keyword_matches(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("The", "and", "zzz", "IN")])
    return table(spark, d, "documents").select("doc_id", F.array_join(evaluate.matched_keywords(evaluate.haystack(F.col("lang"), F.col("text")), words), "|").alias("found"))


QUERIES = {"eval_pass_counts": eval_pass_counts, "result_locations": result_locations, "keyword_matches": keyword_matches}
ORACLE_SQL = {
    "eval_pass_counts": f"""WITH {BM25}, top AS (SELECT query, id FROM bm WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5),
c AS (SELECT item_id AS query, ({TOKENS})[1:3] AS keywords, item_id % 40 = 0 AS typed FROM benchmark WHERE item_id % 20 = 0),
m AS (SELECT query, len(list_filter(keywords, lambda k: contains(lower(concat_ws(' ', coalesce(lang, ''), coalesce(text, ''), '{{"source":' || coalesce('"' || source || '"', 'null') || ',"nothing":null}}')), k))) > 0 AS hit,
      NOT typed OR lower(lang) IN ({", ".join(f"'{t.lower()}'" for t in TYPES)}) AS fits FROM top JOIN documents ON doc_id = id JOIN c USING (query)),
a AS (SELECT query, bool_or(hit AND coalesce(fits, false)) AS atomic, bool_or(hit) AS semantic FROM m GROUP BY query),
e AS (SELECT keywords, 'atomic' AS corpus, atomic AS ok FROM c LEFT JOIN a USING (query) UNION ALL SELECT keywords, 'semantic', semantic FROM c LEFT JOIN a USING (query))
SELECT corpus, count(*) FILTER (len(keywords) = 0 OR coalesce(ok, false)) AS passed, count(*) AS cases FROM e GROUP BY corpus""",
    "result_locations": f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || ' p' || doc_id % 5 || '-' || (doc_id % 5 + 2) ELSE doc_id || ' p' || doc_id % 7 END AS location,
  trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, location, CASE WHEN length(t) > 260 THEN t[1:257] || '...' ELSE t END AS text FROM f""",
    "keyword_matches": """SELECT doc_id, array_to_string(list_filter(['The', 'and', 'zzz', 'IN'], lambda k: contains(lower(coalesce(lang, '') || ' ' || coalesce(text, '')), lower(k))), '|') AS found FROM documents""",
}
