"""Queries from the overlay to semantic chunks.

The enrichment records are made from the blocks by a fixed rule, as no model can be asked here; the
vectors of ``embeddings`` stand for chunks: the label is the document, the vector id the place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions.text import NOT_WS, word_count
from ..operators import chunks as op
from ..operators import semantic
from ..storage import stored
from .blocks import BLOCKS, blocks
from .blocks import ORACLE_SQL as BLOCK_SQL
from .tables import table


#: Texts of hosts; whether they are noise is in the second place.
HOSTS = (
    ("a plain text of more than six words stands here", False), ("b c d e f g", True), ("xkcdq wrtzp I am a bit aaah brrr", True), ("ÀÀ ÀÀ ÀÀ ÀÀ ÀÀ ÀÀ", True),
    ("short one", False), ("it is 5.0 of 7 (or less), isn't it?", False), ("", True),
)
HOST_TEXTS = [t for t, _ in HOSTS]


def _merged(spark: SparkSession, d: str) -> DataFrame:
    made = blocks(spark, d)
    turn = F.col("doc_id") + F.col("page_no") + F.col("reading_order")
    quality = F.when(turn % 4 == 0, "good").when(turn % 4 == 1, "poor").when(turn % 4 == 2, "broken")
    record = lambda kind: made.filter((F.col("type") == kind) & (turn % 5 > 0)).select("block_id", F.lit(1).alias("record_no"), quality.alias("overall_quality"), "text")
    figures = record("figure").withColumn("visual_description", F.concat(F.lit("shows "), F.col("text"))).withColumn("keywords", F.array(F.lit("figure"), F.lit("plot"))).drop("text")
    formulas = record("formula").withColumn("formula_focus", F.lit("a formula")).withColumn("formula_explanation", F.col("text")).drop("text")
    maths = record("text").filter(turn % 3 == 0).withColumn("text_cleaned", F.col("text")).drop("text")
    # A later record of some figures has no quality: it replaces the first one's.
    again = made.filter((F.col("type") == "figure") & (turn % 10 == 1)).select("block_id", F.lit(2).alias("record_no"), F.lit(None).cast("string").alias("overall_quality"), F.lit("drawn anew").alias("visual_description"), F.array(F.lit("late")).alias("keywords"))
    return op.merged(made, {"figure": figures.unionByName(again), "formula": formulas, "text_inline_math": maths})


def merge_overlay(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("block_id", "type", "source", "overall_quality")


def merged_context(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("block_id", "section_title", "nearby_text_before", "nearby_text_after", "visual_description")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.counts_of(op.atomic_chunks(_merged(spark, d)))


def raw_fields(spark: SparkSession, d: str) -> DataFrame:
    raw, told = F.col("raw_fields"), F.col("content_for_generation")
    made = op.atomic_chunks(_merged(spark, d))
    return made.select("chunk_id", raw["text"].alias("text"), raw["text_cleaned"].alias("cleaned"), raw["nearby_text_before"].alias("before"), told["section_title"].alias("title"), F.array_join(raw["keywords"], "|").alias("keywords"))


def vectors_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Offline vectors of all candidates, joined back to their chunks: what the fold gets."""
    chunks = op.atomic_chunks(_merged(spark, d))
    vectors = providers.vector_rows(op.embedding_candidates(chunks))
    records = semantic.atomic_records(vectors, chunks.withColumn("chunk_no", F.lit(1)))
    return records.select("doc_id", "page_no", "block_no", "chunk_id", "section_key", "token_count", "text", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


def chunks_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Merge, chunks, vectors, fold and attached figures: a row for each semantic chunk."""
    chunks = stored(op.atomic_chunks(_merged(spark, d)).drop("raw_fields"))  # which no later step reads
    candidates = op.embedding_candidates(chunks).select(F.col("chunk_id").alias("id"), "content_for_embedding")  # no more goes to the embedder
    records = stored(semantic.atomic_records(providers.embedded(candidates, "content_for_embedding"), chunks.withColumn("chunk_no", F.lit(1))))
    cut = semantic.similarity_thresholds(semantic.adjacent_similarity(records)).first()
    made = semantic.semantic_chunks(records, cut["threshold"], cut["high_threshold"])
    figures = op.auxiliary(chunks).select(F.col("metadata.doc_id").alias("doc_id"), "chunk_id", F.col("metadata.page_no").alias("page_no"), "block_no", "content_for_generation")
    made = semantic.with_auxiliary(made, figures)
    return made.select("semantic_chunk_id", "doc_id", "token_count", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("auxiliary_chunk_ids", ",").alias("auxiliary"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return op.provenance_counts(_merged(spark, d))


def atomic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return op.atomic_chunks(_merged(spark, d)).select("chunk_id", "chunk_type", "indexable", "content_for_embedding")


def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every 17th block is of a type that no chunk is made of, every 19th a table."""
    turn = F.col("doc_id") + F.col("page_no") * 7 + F.col("reading_order")
    return op.skip_counts(_merged(spark, d).withColumn("type", F.when(turn % 17 == 0, "code").when(turn % 19 == 0, "table").otherwise(F.col("type"))))


def embedding_candidates(spark: SparkSession, d: str) -> DataFrame:
    made = op.embedding_candidates(op.atomic_chunks(_merged(spark, d)))
    return made.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(word_count(F.col("content_for_embedding")).cast("long")).alias("n_words"))


def resume(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("done").alias("state"), F.lit(1).alias("record_no"))
    return op.resumed(docs, done, lambda new: new.select("chunk_id", F.lit("new").alias("state")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        F.col("label").alias("doc_id"), F.floor(v / 50).cast("int").alias("page_no"), (v % 50).cast("int").alias("block_no"), F.format_string("v%08d", v).alias("chunk_id"),
        F.when(v % 7 > 0, F.concat(F.lit("s"), F.floor(v / 200))).alias("section_key"), (60 + v % 200).cast("long").alias("token_count"),
        F.concat(F.lit("text of vector number "), v, F.lit(" and some more words")).alias("text"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def adjacent(spark: SparkSession, d: str) -> DataFrame:
    return semantic.adjacent_similarity(_records(spark, d)).select("chunk_id", F.round("similarity", 6).alias("similarity"))


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    made = semantic.similarity_thresholds(semantic.adjacent_similarity(_records(spark, d)))
    return made.select("n", *[F.round(c, 6).alias(c) for c in made.columns if c != "n"])


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    cut = semantic.similarity_thresholds(semantic.adjacent_similarity(records)).first()
    made = semantic.semantic_chunks(records, cut["threshold"], cut["high_threshold"])
    return made.select("semantic_chunk_id", "doc_id", "token_count", F.size("chunk_ids").cast("long").alias("n_chunks"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def auxiliary_hosts(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    chunks = table(spark, d, "embeddings").filter(v % 10 > 0).select(
        F.col("label").alias("doc_id"), v.alias("ordinal"), F.floor(v / 50).cast("int").alias("first_page"), F.floor((v + 30) / 50).cast("int").alias("last_page"),
        F.array((v % 50).cast("int"), (v % 50 + 3).cast("int")).alias("block_nos"), (40 + v % 100).alias("token_count"), F.get(F.array(*[F.lit(t) for t in HOST_TEXTS]), (v % len(HOST_TEXTS)).cast("int")).alias("content_for_embedding"),
    )
    figures = table(spark, d, "embeddings").filter(v % 10 == 0).select(
        F.col("label").alias("doc_id"), v.alias("chunk_id"), F.floor(v / 50).cast("int").alias("page_no"), (v % 50).cast("int").alias("block_no")
    )
    return semantic.attach_auxiliary(chunks, figures).select("chunk_id", "ordinal", F.col("page_gap").cast("long").alias("page_gap"), F.col("block_gap").cast("long").alias("block_gap"))


QUERIES = {
    "merge_overlay": merge_overlay, "merge_provenance_counts": provenance, "atomic_chunks": atomic_chunks, "skip_counts": skip_counts,
    "embedding_candidates": embedding_candidates, "resume_antijoin": resume, "adjacent_similarity": adjacent, "similarity_thresholds": thresholds,
    "semantic_chunks": semantic_chunks, "aux_nearest_attach": auxiliary_hosts, "merged_context": merged_context, "chunk_counts": chunk_counts,
    "chunk_raw_fields": raw_fields, "vectors_of_chunks": vectors_of_chunks, "chunks_end_to_end": chunks_end_to_end,
}

MERGED = f"""titled AS ({BLOCK_SQL['section_title_ffill']}), near AS ({BLOCK_SQL['nearby_text']}), {BLOCKS},
q AS (SELECT *, doc_id + page_no + reading_order AS turn, type = 'figure' AND (doc_id + page_no + reading_order) % 10 = 1 AS anew FROM block WHERE type <> 'table'),
k AS (SELECT *, turn % 5 > 0 AND (type IN ('figure', 'formula') OR (type = 'text' AND turn % 3 = 0)) AS has FROM q),
merged AS (SELECT k.block_id, k.doc_id, page_no, reading_order, text, clean,
  CASE WHEN has AND k.type = 'text' THEN 'text_inline_math' ELSE k.type END AS type,
  CASE WHEN anew OR has THEN CASE k.type WHEN 'text' THEN 'text_inline_math' ELSE k.type END ELSE 'original' END AS source,
  CASE WHEN has AND NOT anew THEN CASE turn % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'poor' WHEN 2 THEN 'broken' END END AS overall_quality,
  CASE WHEN anew THEN 'drawn anew' WHEN has AND k.type = 'figure' THEN trim('shows ' || coalesce(clean, '')) END AS visual_description,
  CASE WHEN anew THEN ['late'] WHEN has AND k.type = 'figure' THEN ['figure', 'plot'] END AS keywords,
  CASE WHEN k.type = 'text' THEN merged_title END AS section_title, CASE WHEN k.type = 'text' THEN nearby_text_before END AS nearby_text_before,
  CASE WHEN k.type = 'text' THEN nearby_text_after END AS nearby_text_after
  FROM k JOIN titled USING (block_id) JOIN near USING (block_id))"""
CHUNKS = f"""{MERGED},
chunk AS (SELECT *, block_id || '_' || type AS chunk_id, type AS chunk_type,
  CASE type WHEN 'formula' THEN coalesce(overall_quality IN ('good', 'poor'), false) WHEN 'figure' THEN coalesce(overall_quality = 'good', false) ELSE true END AS indexable,
  CASE WHEN type = 'formula' THEN CASE WHEN source = 'formula' THEN concat_ws('. ', 'a formula', clean) END
       WHEN type = 'figure' THEN CASE WHEN overall_quality = 'good' THEN concat_ws('. ', visual_description, 'figure. plot') END
       ELSE nullif(concat_ws('. ', section_title, clean), '') END AS content_for_embedding
  FROM merged WHERE type <> 'title' AND (type = 'text' OR overall_quality IS DISTINCT FROM 'broken'))"""
ADJACENT = """rec AS (SELECT label AS doc_id, vec_id, format('v{:08d}', vec_id) AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
adj AS (SELECT chunk_id, list_cosine_similarity(lag(v) OVER w, v) AS similarity FROM rec WINDOW w AS (PARTITION BY doc_id ORDER BY vec_id // 50, vec_id % 50, chunk_id)),
sim AS (SELECT * FROM adj WHERE similarity IS NOT NULL)"""
ORACLE_SQL = {
    "merge_overlay": f"WITH {MERGED} SELECT block_id, type, source, overall_quality FROM merged",
    "merge_provenance_counts": f"WITH {MERGED} SELECT " + ", ".join(f"count(*) FILTER (source = '{s}') AS n_{s}" for s in ("figure", "formula", "text_inline_math", "original")) + " FROM merged",
    "atomic_chunks": f"WITH {CHUNKS} SELECT chunk_id, chunk_type, indexable, content_for_embedding FROM chunk",
    "skip_counts": f"""WITH {MERGED}, m AS (SELECT overall_quality, CASE WHEN (doc_id + page_no * 7 + reading_order) % 17 = 0 THEN 'code' WHEN (doc_id + page_no * 7 + reading_order) % 19 = 0 THEN 'table' ELSE type END AS type FROM merged)
SELECT count(*) FILTER (type = 'title') AS skipped_title, count(*) FILTER (type = 'table') AS skipped_table,
count(*) FILTER (type IN ('figure', 'formula', 'text_inline_math') AND overall_quality = 'broken') AS skipped_broken, count(*) FILTER (type = 'code') AS unknown_type FROM m""",
    "merged_context": f"WITH {MERGED} SELECT block_id, section_title, nearby_text_before, nearby_text_after, visual_description FROM merged",
    "chunk_counts": f"WITH {CHUNKS} SELECT doc_id, chunk_type, count(*) AS chunks, count(*) FILTER (indexable) AS indexable FROM chunk GROUP BY doc_id, chunk_type",
    "chunk_raw_fields": f"""WITH {CHUNKS} SELECT chunk_id, CASE WHEN type = 'text' THEN clean END AS text, CASE WHEN type = 'text_inline_math' THEN clean END AS cleaned,
  nearby_text_before AS before, section_title AS title, array_to_string(keywords, '|') AS keywords FROM chunk""",
    "vectors_of_chunks": f"""WITH {CHUNKS} SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(reading_order AS INTEGER) AS block_no, chunk_id,
  nullif(trim(regexp_replace(lower(section_title), '[^a-z0-9]+', ' ', 'g')), '') AS section_key, CAST(len(regexp_extract_all(content_for_embedding, '{NOT_WS}+')) AS BIGINT) AS token_count,
  content_for_embedding AS text, 1e0 AS square FROM chunk WHERE indexable AND content_for_embedding IS NOT NULL""",
    "embedding_candidates": rf"""WITH {CHUNKS} SELECT chunk_type, count(*) AS n, CAST(sum(len(regexp_extract_all(content_for_embedding, '[\p{{L}}\p{{N}}_]+'))) AS BIGINT) AS n_words
FROM chunk WHERE indexable AND content_for_embedding IS NOT NULL GROUP BY chunk_type""",
    "resume_antijoin": """SELECT doc_id AS chunk_id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'done' ELSE 'new' END AS state FROM documents""",
    "adjacent_similarity": f"WITH {ADJACENT} SELECT chunk_id, round(similarity, 6) AS similarity FROM sim",
    "semantic_chunks": f"""WITH RECURSIVE {ADJACENT}, cut AS (SELECT quantile_cont(similarity, 0.45) AS low, greatest(quantile_cont(similarity, 0.45), quantile_cont(similarity, 0.8)) AS high FROM sim),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id // 50, vec_id % 50, chunk_id) AS k, vec_id, chunk_id, v, CASE WHEN vec_id % 7 > 0 THEN 's' || vec_id // 200 END AS section, 60 + vec_id % 200 AS tokens FROM rec),
fold(doc_id, k, chunk, n, total, mean, section, chunk_id, tokens) AS (
  SELECT doc_id, k, 1, 1, v, v, section, chunk_id, tokens FROM r WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN added ELSE v END,
    list_transform(CASE WHEN fits THEN added ELSE v END, lambda x: x / CASE WHEN fits THEN n + 1 ELSE 1 END), CASE WHEN fits THEN coalesce(own, before) ELSE own END, chunk_id, CASE WHEN fits THEN so_far + tokens ELSE tokens END
  FROM (SELECT *, similarity >= CASE WHEN own IS NULL OR before IS NULL OR own = before THEN 0.3 ELSE 0.8 END AND so_far + tokens <=
      CASE WHEN similarity <= low THEN 400 WHEN similarity >= high THEN 800 ELSE round_even(400 + (similarity - low) / greatest(high - low, 1e-6) * 400, 0) END AS fits
    FROM (SELECT r.doc_id, r.k, f.chunk, f.n, r.v, r.chunk_id, r.tokens, f.tokens AS so_far, r.section AS own, f.section AS before, list_cosine_similarity(f.mean, r.v) AS similarity,
        list_transform(list_zip(f.total, r.v), lambda p: p[1] + p[2]) AS added, low, high FROM fold f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1, cut))),
c AS (SELECT doc_id, chunk, max(tokens) AS token_count, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY k) AS chunk_ids FROM fold GROUP BY doc_id, chunk)
SELECT doc_id || '_semantic_' || lpad(CAST(row_number() OVER (ORDER BY doc_id, chunk) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY doc_id, chunk) AS VARCHAR))) AS INTEGER), '0') AS semantic_chunk_id,
  doc_id, CAST(token_count AS BIGINT) AS token_count, n_chunks, chunk_ids FROM c""",
    "similarity_thresholds": f"WITH {ADJACENT} SELECT count(*) AS n, round(min(similarity), 6) AS least, "
    + ", ".join(f"round(quantile_cont(similarity, {q / 100}), 6) AS p{q}" for q in (10, 25, 50, 60, 75, 85, 90))
    + ", round(max(similarity), 6) AS most, round(quantile_cont(similarity, 0.45), 6) AS threshold, round(quantile_cont(similarity, 0.8), 6) AS high_threshold FROM sim",
    "aux_nearest_attach": f"""WITH h AS (SELECT label AS doc_id, vec_id AS ordinal, vec_id // 50 AS fp, (vec_id + 30) // 50 AS lp, vec_id % 50 AS b FROM embeddings WHERE vec_id % 10 > 0 AND 40 + vec_id % 100 >= 60 AND NOT {[noise for _, noise in HOSTS]}[vec_id % {len(HOSTS)} + 1]),
f AS (SELECT label AS doc_id, vec_id AS chunk_id, vec_id // 50 AS p, vec_id % 50 AS b FROM embeddings WHERE vec_id % 10 = 0),
g AS (SELECT f.chunk_id, h.ordinal, CASE WHEN p BETWEEN fp AND lp THEN 0 ELSE least(abs(p - fp), abs(p - lp)) END AS page_gap, least(abs(h.b - f.b), abs(h.b + 3 - f.b)) AS block_gap FROM f JOIN h USING (doc_id))
SELECT chunk_id, ordinal, page_gap, block_gap FROM g QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY page_gap, block_gap, ordinal) = 1""",
}
