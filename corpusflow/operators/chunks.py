"""Overlay of enrichment records, typed atomic chunks, and resumable embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import block_number, clean_text, join_parts, span_phrases, strip_control, strip_control_nested
from .context import with_block_context

#: Type of block that a kind of record overlays.
OVERLAYS = {"figure": "figure", "formula": "formula", "text_inline_math": "text"}
RECORD_FIELDS = {
    "overall_quality": "string", "section_title": "string", "nearby_text_before": "string", "nearby_text_after": "string",
    "text_cleaned": "string", "visual_description": "string", "figure_focus": "string", "keywords": "array<string>",
    "formula_latex": "string", "formula_focus": "string", "formula_explanation": "string",
    "math_spans": "array<struct<raw:string,normalized:string,math_name:string>>", "text_raw": "string", "image_path": "string",
}


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def shaped(records: DataFrame) -> DataFrame:
    """``records`` (block_id, record_no, some of RECORD_FIELDS) with all fields and ``present``, the names of those they have: a
    field that is there replaces the block's even by null.  Records with ``present`` of their own name them row by row."""
    field = lambda k, t: F.col(k) if k in records.columns else F.lit(None).cast(t).alias(k)
    names = [k for k in RECORD_FIELDS if k in records.columns]
    present = F.col("present") if "present" in records.columns else F.array(*[F.lit(k) for k in names]).cast("array<string>")
    return records.select("block_id", "record_no", *[field(k, t) for k, t in RECORD_FIELDS.items()], present.alias("present"))


def merge_overlay(blocks: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Blocks with the fields of their record; tables are left out.  ``source`` tells what was taken.

    A record counts for a block of its id and type; of several the last; its fields replace those of the block, nulls as well.
    Control characters go from all strings."""
    every = None
    for kind, df in records.items():
        part = shaped(df).withColumn("record_kind", F.lit(kind)).withColumn("for_type", F.lit(OVERLAYS[kind]))
        every = part if every is None else every.unionByName(part)
    latest = last_per_key(every.withColumn("_key", F.concat_ws("|", "block_id", "for_type")), "_key", "record_no").drop("_key", "record_no")
    r = latest.select(F.col("block_id").alias("r_id"), "for_type", "record_kind", "present", *[F.col(k).alias(f"r_{k}") for k in RECORD_FIELDS])
    kept = blocks.filter(F.col("type") != "table")
    joined = kept.join(r, (F.col("block_id") == F.col("r_id")) & (F.col("type") == F.col("for_type")), "left")

    def own(k: str, t: str) -> Column:
        before = F.col(k) if k in blocks.columns else F.lit(None).cast(t)
        taken = F.when(F.coalesce(F.array_contains("present", k), F.lit(False)), F.col(f"r_{k}")).otherwise(before)
        return strip_control_nested(taken, T._parse_datatype_string(t)).alias(k)

    def kept_column(c: str) -> Column:
        return strip_control(F.col(c)).alias(c) if c == "text" else F.col(c)

    return joined.select(
        *[kept_column(c) for c in blocks.columns if c not in RECORD_FIELDS and c != "type"],
        F.when(F.col("record_kind") == "text_inline_math", "text_inline_math").otherwise(F.col("type")).alias("type"),
        F.coalesce("record_kind", F.lit("original")).alias("source"),
        *[own(k, t) for k, t in RECORD_FIELDS.items()],
    )


def merged(blocks: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """The merge from end to end: texts get section titles and nearby texts, then records are laid over."""
    return merge_overlay(with_block_context(blocks), records)


def provenance_counts(merged: DataFrame) -> DataFrame:
    """A row: blocks by source, zeros included."""
    return merged.agg(*[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("figure", "formula", "text_inline_math", "original")])


def atomic_chunks(merged: DataFrame) -> DataFrame:
    """Chunks of text, inline-math text, formulas and figures.

    Broken records are dropped; figures of less than good quality stay as auxiliary chunks without embedding text."""
    kind, quality = F.col("type"), F.col("overall_quality")
    one = lambda c: F.array(F.col(c))
    text = (
        F.when(kind == "formula", join_parts(one("section_title"), one("formula_focus"), one("formula_explanation")))
        .when(kind == "figure", F.when(quality == "good", join_parts(one("section_title"), one("figure_focus"), one("visual_description"), F.col("keywords"))))
        .when(kind == "text_inline_math", join_parts(one("section_title"), one("text_cleaned"), span_phrases(F.col("math_spans"))))
        .otherwise(join_parts(one("section_title"), one("text")))
    )
    indexable = (
        F.when(kind == "formula", F.coalesce(quality.isin("good", "poor"), F.lit(False)))
        .when(kind == "figure", F.coalesce(quality == "good", F.lit(False))).otherwise(F.lit(True))
    )
    usable = merged.filter(kind.isin("text", "text_inline_math", "formula", "figure") & ((kind == "text") | ~quality.eqNullSafe("broken")))
    return usable.select(
        F.concat_ws("_", "block_id", kind).alias("chunk_id"), kind.alias("chunk_type"), indexable.alias("indexable"), text.alias("content_for_embedding"),
        F.struct(*[F.col(c) for c in ("section_title", "text", "text_cleaned", "math_spans", "formula_focus", "formula_explanation", "formula_latex", "figure_focus", "visual_description", "keywords")]).alias("content_for_generation"),
        F.struct("doc_id", "page_no", "block_id", "bbox", "overall_quality", "reading_order", "image_path", kind.alias("original_type")).alias("metadata"),
        F.struct(
            *[clean_text(F.col(c)).alias(c) for c in ("nearby_text_before", "nearby_text_after")], F.when(kind == "text", clean_text(F.col("text"))).alias("text"),
            *[clean_text(F.col(c)).alias(c) for c in ("text_raw", "text_cleaned")], "math_spans",
            *[clean_text(F.col(c)).alias(c) for c in ("formula_latex", "visual_description", "figure_focus")], "keywords",
        ).alias("raw_fields"),
        block_number(F.col("block_id")).alias("block_no"),
    )


def skip_counts(merged: DataFrame) -> DataFrame:
    """A row: blocks that become no chunk, by reason."""
    kind = F.col("type")
    known = kind.isin("text", "text_inline_math", "formula", "figure")
    return merged.agg(
        F.count_if(kind == "title").alias("skipped_title"), F.count_if(kind == "table").alias("skipped_table"),
        F.count_if(known & (kind != "text") & F.col("overall_quality").eqNullSafe("broken")).alias("skipped_broken"),
        F.count_if(~known & ~kind.isin("title", "table")).alias("unknown_type"),
    )


def embedding_candidates(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("indexable") & clean_text(F.col("content_for_embedding")).isNotNull())


def counts_of(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_type: how many chunks, and how many of them are indexable."""
    return chunks.groupBy("metadata.doc_id", "chunk_type").agg(F.count("*").alias("chunks"), F.count_if("indexable").alias("indexable"))


def auxiliary(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("chunk_type") == "figure") & ~F.col("indexable"))


def resumed(candidates: DataFrame, done: DataFrame, make) -> DataFrame:
    """Vectors of all candidates: those done stay, ``make`` gives the rest; what is no candidate any more goes.

    Both have ``chunk_id``; of repeated done rows the first ``record_no`` stays."""
    first = Window.partitionBy("chunk_id").orderBy("record_no")
    kept = done.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "record_no").join(candidates.select("chunk_id"), "chunk_id", "left_semi")
    return kept.unionByName(make(candidates.join(done, "chunk_id", "left_anti")))
