"""Semantic chunks: thresholds, the ordered fold within a document, and auxiliary figures."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import clean_text, section_key, token_count
from ..functions.vectors import cosine
from ..storage import discard, stored

QUANTILE, HIGH_QUANTILE = 0.45, 0.80
LEAST_TOKENS, MOST_TOKENS = 400, 800
ACCEPT_SAME, ACCEPT_OTHER = 0.30, 0.80
HOST_TOKENS = 60
ORDER = ("page_no", "block_no", "chunk_id")


def adjacent_similarity(records: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, similarity) of each record to the one in front of it in its document."""
    order = Window.partitionBy("doc_id").orderBy(*ORDER)
    both = records.withColumn("_before", F.lag("embedding").over(order))
    usable = (F.size("_before") > 0) & (F.size("embedding") > 0)
    return both.filter(usable).select("doc_id", "chunk_id", cosine(F.col("_before"), F.col("embedding")).alias("similarity"))


MARKS = (0.10, 0.25, 0.50, 0.60, 0.75, 0.85, 0.90)


def values_at(df: DataFrame, column: str, ranks: list[int], bins: int = 4096) -> dict[int, float]:
    """Values at 0-based ranks of a sorted column without nulls, exactly.

    A histogram tells which bin a rank falls into, and that bin is cut again, until a bin holds one value
    only: a row for each bin reaches the driver, however many values there are."""
    v = F.col(column).cast("double")
    least, most, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    open_ = {r: (least, most, 0) for r in ranks}  # bounds, both included, and how many values are below
    found: dict[int, float] = {}
    while open_:
        spans = sorted({(lo, hi, below) for lo, hi, below in open_.values()})
        kept = None
        for i, (lo, hi, _) in enumerate(spans):
            at = F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) or 1.0) * bins).cast("int"), F.lit(bins - 1))
            test = F.when(v.between(lo, hi), F.struct(F.lit(i).alias("span"), at.alias("at")))
            kept = test if kept is None else F.coalesce(kept, test)
        rows = df.select(kept.alias("b"), v.alias("v")).filter("b is not null").groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by = {i: sorted((r["b"]["at"], r["n"], r["lo"], r["hi"]) for r in rows if r["b"]["span"] == i) for i in range(len(spans))}
        for rank, span in list(open_.items()):
            below = span[2]
            for _, n, lo, hi in by[spans.index(span)]:
                if rank < below + n:
                    if lo == hi:
                        found[rank] = lo
                        del open_[rank]
                    else:
                        open_[rank] = (lo, hi, below)
                    break
                below += n
    return found


def similarity_thresholds(similarities: DataFrame, quantile: float = QUANTILE, high: float = HIGH_QUANTILE) -> DataFrame:
    """A row: the distribution and both thresholds (exact, interpolated; 0 without any similarity)."""
    known = stored(similarities.select("similarity").filter("similarity is not null"))  # read once for each cut of the histogram
    n = known.count()
    names = ["least", *[f"p{round(100 * m)}" for m in MARKS], "most", "threshold", "high_threshold"]
    at = [0.0, *MARKS, 1.0, quantile, high]
    places = [q * (n - 1) for q in at]
    exact = values_at(known, "similarity", sorted({r for p in places for r in (math.floor(p), math.ceil(p))})) if n else {}
    between = lambda p: exact[math.floor(p)] + (p - math.floor(p)) * (exact[math.ceil(p)] - exact[math.floor(p)])
    made = dict(zip(names, [float(between(p)) if n else 0.0 for p in places]))
    discard(known)
    made["high_threshold"] = max(made["threshold"], made["high_threshold"])
    return similarities.sparkSession.createDataFrame([(n, *made.values())], "n long, " + ", ".join(f"{k} double" for k in names))


CHUNK_SCHEMA = (
    "doc_id {doc}, first_page int, last_page int, first_block int, token_count long, chunk_ids array<string>, block_nos array<int>, "
    "texts array<string>, merge_scores array<struct<similarity:double,effective_threshold:double>>"
)


def limit_of(similarity: float, low: float, high: float, least: int, most: int) -> int:
    if most <= least or similarity <= low:
        return least
    if similarity >= high:
        return most
    return round(least + (similarity - low) / max(high - low, 1e-6) * (most - least))


RECORD = ("doc_id", "page_no", "block_no", "chunk_id", "section_key", "token_count", "text", "embedding")
CHUNKS_SENT = 2_000  # at once


def fold(records: Iterable[tuple], low: float, high: float, least: int, most: int) -> Iterator[dict]:
    """Greedy chunks of records (as in RECORD) that come document by document, ordered.

    A record joins the open chunk if it is similar enough to the chunk's mean vector (more so in another
    section) and the tokens of both stay within a limit that rises with the similarity."""
    open_: dict | None = None
    for doc_id, page_no, block_no, chunk_id, section, tokens, text, vector in records:
        if open_ is not None and doc_id == open_["doc_id"]:
            mean = open_["sum"] / len(open_["chunk_ids"])
            length = np.sqrt(mean @ mean) * np.sqrt(vector @ vector)
            similarity = float(mean @ vector / length) if length > 0 else 0.0
            same = section is None or open_["section"] is None or section == open_["section"]
            accept = ACCEPT_SAME if same else ACCEPT_OTHER
            if similarity >= accept and open_["token_count"] + tokens <= limit_of(similarity, low, high, least, most):
                open_["sum"] = open_["sum"] + vector
                open_["token_count"] += tokens
                open_["last_page"] = page_no
                open_["section"] = section or open_["section"]
                open_["merge_scores"].append({"similarity": similarity, "effective_threshold": accept})
                for k, v in (("chunk_ids", chunk_id), ("block_nos", block_no), ("texts", text)):
                    open_[k].append(v)
                continue
        if open_ is not None:
            yield open_
        open_ = {
            "doc_id": doc_id, "first_page": page_no, "last_page": page_no, "first_block": block_no, "token_count": tokens,
            "chunk_ids": [chunk_id], "block_nos": [block_no], "texts": [text], "merge_scores": [], "sum": vector, "section": section,
        }
    if open_ is not None:
        yield open_


def fold_document(rows: pd.DataFrame, low: float, high: float, least: int, most: int) -> list[dict]:
    """The chunks of one document's records in any order."""
    ordered = rows.sort_values(list(ORDER), kind="stable")[list(RECORD)].itertuples(index=False)
    text = lambda s: s if isinstance(s, str) else None
    return list(fold(((d, int(p), int(b), c, text(s), int(n), t, np.asarray(e, np.float64)) for d, p, b, c, s, n, t, e in ordered), low, high, least, most))


def semantic_chunks(records: DataFrame, low: float, high: float, least: int = LEAST_TOKENS, most: int = MOST_TOKENS) -> DataFrame:
    """Chunks of all documents with a running number over documents.  The fold needs one document at a time.

    ``records``: doc_id, page_no, block_no, chunk_id, section_key, token_count, text, embedding."""
    schema = T.StructType.fromDDL(CHUNK_SCHEMA.format(doc=records.schema["doc_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            vectors = batch.column(len(RECORD) - 1)
            at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            yield from zip(*[batch.column(i).to_pylist() for i in range(len(RECORD) - 1)], (values[a:b] for a, b in zip(at[:-1], at[1:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fold(rows(batches), low, high, least, most)
        while part := list(itertools.islice(made, CHUNKS_SENT)):
            yield pa.RecordBatch.from_pylist([{k: c[k] for k in arrow.names} for c in part], schema=arrow)

    # The records of a document come one after another; no more than the open chunk is held.
    types = {"page_no": "int", "block_no": "int", "token_count": "long", "embedding": "array<double>"}
    typed = records.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in RECORD])
    folded = stored(typed.repartition("doc_id").sortWithinPartitions("doc_id", *[F.asc_nulls_last(c) for c in ORDER]).mapInArrow(run, schema))
    # Numbers run over documents: counts by document are sorted by range, and only a count for each range reaches the driver.
    per_doc = stored(folded.groupBy("doc_id").agg(F.count("*").alias("_n")).repartitionByRange("doc_id").withColumn("_range", F.spark_partition_id()))
    sizes = sorted(per_doc.groupBy("_range").agg(F.sum("_n")).collect())
    starts = dict(zip([r for r, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]])))
    start = F.create_map(*[F.lit(x) for r, n in starts.items() for x in (r, n)])[F.col("_range")] if starts else F.lit(0)
    ahead = F.sum("_n").over(Window.partitionBy("_range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_page", "first_block", F.get("chunk_ids", F.lit(0))))
    numbered = folded.join(per_doc.select("doc_id", (start + F.coalesce(ahead, F.lit(0))).alias("_offset")), "doc_id").withColumn("ordinal", F.col("_offset") + inside)
    return numbered.withColumn("semantic_chunk_id", F.format_string("%s_semantic_%04d", F.col("doc_id").cast("string"), F.col("ordinal"))).withColumn(
        "content_for_embedding", F.array_join("texts", " ")
    ).drop("_offset")


def atomic_records(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records for the fold: vectors (id, values) with their chunk; of chunks of an id the last ``chunk_no`` counts, and those
    without text or vector go.

    ``chunks``: as ``atomic_chunks`` gives them, with ``chunk_no``."""
    last = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("content_for_embedding", F.col("content_for_generation.section_title").alias("section_title"), "metadata.doc_id", "metadata.page_no", "block_no"), "chunk_no").alias("c"))
    both = vectors.select(F.col("id").alias("chunk_id"), F.col("values").alias("embedding")).join(last, "chunk_id")
    text = F.coalesce("c.content_for_embedding", F.lit(""))
    return both.filter(text != "").select(
        F.col("c.doc_id").alias("doc_id"), F.coalesce("c.page_no", F.lit(0)).cast("int").alias("page_no"), F.col("c.block_no").alias("block_no"),
        "chunk_id", section_key(F.col("c.section_title")).alias("section_key"), token_count(text).cast("long").alias("token_count"),
        text.alias("text"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def is_scan_noise(text):
    """Texts of six tokens or more with many odd words or characters; an empty text counts as noise.

    Odd words: one letter but a or i, five letters or more without a vowel, a letter three times in a row."""
    clean = clean_text(text)
    words = F.regexp_extract_all(F.lower(clean), F.lit("[a-z0-9']+"), 0)
    letters = F.transform(words, lambda w: F.regexp_replace(w, "[^a-z]", ""))
    lone = lambda w: (F.length(w) == 1) & ~w.isin("a", "i")
    odd = F.size(F.filter(letters, lambda w: lone(w) | ((F.length(w) >= 5) & ~w.rlike("[aeiouy]")) | w.rlike(r"(.)\1\1")))
    strange = F.regexp_count(clean, F.lit(r"""[^A-Za-z0-9\s,.;:!?()\[\]{}'"/%+\-=]"""))
    dense = F.length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean.isNull(), True).when(token_count(clean) < 6, False).otherwise(
        (odd / F.greatest(F.size(words), F.lit(1)) >= 0.35) | (strange / F.greatest(dense, F.lit(1)) >= 0.08)
    )


def attach_auxiliary(chunks: DataFrame, figures: DataFrame, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """Nearest valid host of each figure in its document: least page gap, then block gap, then number.

    ``chunks``: doc_id, ordinal, first_page, last_page, block_nos, token_count, content_for_embedding;
    ``figures``: doc_id, chunk_id, page_no, block_no.  Figures without a valid host are left out."""
    hosts = chunks.filter((F.col("token_count") >= host_tokens) & ~is_scan_noise(F.col("content_for_embedding")))
    page, first, last = F.col("page_no"), F.col("first_page"), F.col("last_page")
    page_gap = F.when(page.between(first, last), 0).otherwise(F.least(F.abs(page - first), F.abs(page - last)))
    block_gap = F.array_min(F.transform("block_nos", lambda b: F.abs(b - F.col("block_no"))))
    both = figures.join(hosts.select("doc_id", "ordinal", "first_page", "last_page", "block_nos"), "doc_id")
    return both.groupBy("doc_id", "chunk_id").agg(F.min(F.struct(page_gap.alias("page_gap"), block_gap.alias("block_gap"), "ordinal")).alias("h")).select(
        "doc_id", "chunk_id", "h.ordinal", "h.page_gap", "h.block_gap"
    )


def with_auxiliary(chunks: DataFrame, figures: DataFrame, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """``chunks`` with the ids of the figures attached to each (``auxiliary_chunk_ids``) and their content (``auxiliary_chunks``), in
    reading order; empty arrays for the others.

    ``figures``: doc_id, chunk_id, page_no, block_no, content_for_generation."""
    hosts = attach_auxiliary(chunks, figures, host_tokens).select("doc_id", "chunk_id", "ordinal")
    item = F.struct("page_no", "block_no", "chunk_id", "content_for_generation")
    given = hosts.join(figures, ["doc_id", "chunk_id"]).groupBy("ordinal").agg(F.array_sort(F.collect_list(item)).alias("_a"))
    none = F.array().cast(given.schema["_a"].dataType)
    return chunks.join(given, "ordinal", "left").withColumn("_a", F.coalesce("_a", none)).select(
        *chunks.columns, F.transform("_a", lambda x: x["chunk_id"]).alias("auxiliary_chunk_ids"),
        F.transform("_a", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["content_for_generation"].alias("content_for_generation"))).alias("auxiliary_chunks"),
    )
