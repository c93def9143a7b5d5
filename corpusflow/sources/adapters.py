"""Layout blocks from plain documents, for inputs that carry no page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_more_tokens

LINES_PER_PAGE = 6
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def blocks_from_documents(docs: DataFrame) -> DataFrame:
    """A block for each line, six lines a page.  Type and box follow from place and length alone.

    Columns: doc_id, page_no, reading_order, block_id, type, text, bbox, page_width, page_height."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    place = lines.withColumn("page_no", F.floor(F.col("i") / LINES_PER_PAGE).cast("int") + 1).withColumn("reading_order", F.col("i") % LINES_PER_PAGE + 1)
    turn = F.col("doc_id") + F.col("i")
    kind = (
        F.when((F.col("reading_order") == 1) & ~has_more_tokens(F.col("text"), 8), "title")
        .when(turn % 7 == 3, "figure").when(turn % 7 == 5, "table").when(turn % 11 == 4, "formula").otherwise("text")
    )
    left = 40.0 + 60.0 * (turn % 4)
    top = 30.0 + 110.0 * (F.col("reading_order") - 1)
    large = kind.isin("figure", "table")
    width = F.when(large, 260.0).otherwise(120.0 + F.length("text") % 300)
    height = F.when(large, 200.0).otherwise(40.0 + F.length("text") % 90)
    return place.select(
        "doc_id", "page_no", "reading_order",
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("_p"), F.col("page_no"), F.lit("_b"), F.col("reading_order")).alias("block_id"),
        kind.alias("type"), "text",
        F.array(*[x.cast("double") for x in (left, top, left + width, top + height)]).alias("bbox"),
        F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"),
    )
