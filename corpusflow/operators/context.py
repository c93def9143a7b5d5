"""Section titles, neighbouring text and orders of blocks: windows over a document or a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import clean_line, clean_text

LEAST_CHARS = 16
ADDED = ("section_title", "nearby_text_before", "nearby_text_after")


#: Where blocks without a reading order stand.
NO_ORDER = 1_000_000_000


def in_page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_no").orderBy(F.coalesce("reading_order", F.lit(NO_ORDER)))


def in_document() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page_no")


def title_text() -> Column:
    return F.when(F.col("type") == "title", clean_text(F.col("text")))


def with_document_title(blocks: DataFrame) -> DataFrame:
    """``document_title_id``: block id of the first title with text."""
    first = F.min(F.when(title_text().isNotNull(), F.struct("page_no", "reading_order", "block_id"))).over(Window.partitionBy("doc_id"))
    return blocks.withColumn("document_title_id", first["block_id"])


def section_title(title: Column, last_page: int) -> Column:
    """Last title in front of the block on its page, else the last one up to the page ``last_page`` pages off (0 or -1)."""
    on_page = F.last(title, ignorenulls=True).over(in_page().rowsBetween(Window.unboundedPreceding, -1))
    seen = F.when(title.isNotNull(), F.struct("page_no", "reading_order", title.alias("t")))
    return F.coalesce(on_page, F.max(seen).over(in_document().rangeBetween(Window.unboundedPreceding, last_page))["t"])


def with_section_title(blocks: DataFrame) -> DataFrame:
    """For enrichment: a title that follows on the same page counts if none is in front."""
    return blocks.withColumn("section_title", section_title(title_text(), 0))


def with_merged_section_title(blocks: DataFrame) -> DataFrame:
    """For the merge: titles of earlier pages only, and never the document's own title."""
    own = F.when(~F.col("block_id").eqNullSafe(F.col("document_title_id")), title_text())
    return with_document_title(blocks).withColumn("section_title", section_title(own, -1)).drop("document_title_id")


def with_formula_section_title(blocks: DataFrame) -> DataFrame:
    """For formulas: like enrichment, but an empty title counts as one."""
    return blocks.withColumn("section_title", section_title(F.when(F.col("type") == "title", clean_line(F.col("text"))), 0))


def with_nearby_text(blocks: DataFrame, limit: int = 3) -> DataFrame:
    """Up to ``limit`` nearest texts and titles of 16 characters or more on the page, in reading order; null without any."""
    clean = clean_text(F.col("text"))
    usable = F.when(F.col("type").isin("text", "title") & (F.length(clean) >= LEAST_CHARS), clean)
    before = F.collect_list(usable).over(in_page().rowsBetween(Window.unboundedPreceding, -1))
    after = F.collect_list(usable).over(in_page().rowsBetween(1, Window.unboundedFollowing))
    tail = F.slice(before, F.greatest(F.lit(1), F.size(before) - limit + 1), limit)
    joined = lambda a: F.nullif(F.array_join(a, " "), F.lit(""))
    return blocks.withColumn("nearby_text_before", joined(tail)).withColumn("nearby_text_after", joined(F.slice(after, 1, limit)))


def renumbered(blocks: DataFrame) -> DataFrame:
    """``reading_order`` from 1 without gaps on each page."""
    return blocks.withColumn("reading_order", F.row_number().over(in_page()))


def without_lead(blocks: DataFrame) -> DataFrame:
    """Without blocks in front of a page's first title, if that is not the first block."""
    first = F.min(F.when(F.col("type") == "title", F.col("reading_order"))).over(Window.partitionBy("doc_id", "page_no"))
    return blocks.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("_first") <= 1) | (F.col("reading_order") >= F.col("_first"))).drop("_first")


def with_block_context(blocks: DataFrame) -> DataFrame:
    """For the merge: texts get a section title and nearby texts where the blocks bring none."""
    own = F.col("type") == "text"
    made = with_nearby_text(with_merged_section_title(blocks.drop(*ADDED)))
    given = [c for c in ADDED if c in blocks.columns]
    if given:
        made = made.drop(*given).join(blocks.select("block_id", *given), "block_id")
    return made.select(*[F.when(own, F.col(c)).alias(c) if c in ADDED and c not in given else F.col(c) for c in made.columns])


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks by type before and after a step, and how many went: type, before, after, dropped."""
    n = lambda df, name: df.groupBy("type").agg(F.count("*").alias(name))
    both = n(before, "before").join(n(after, "after"), "type", "full")
    both = both.select("type", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("dropped", F.col("before") - F.col("after"))


def type_counts(blocks: DataFrame) -> DataFrame:
    kinds = ("title", "text", "table", "figure", "formula")
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds])
