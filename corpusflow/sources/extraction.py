"""From files to layout blocks: scan, items of a layout parser, blocks.

The parser is a provider (``FileParser``); without one of its own a text file becomes an item a line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Box, from_bottom_left, keep_figure
from ..functions.text import clean_text, document_id, document_title

#: Labels of a layout parser that stand for a title; pictures and tables are told by their kind.
TITLE_LABELS = ("title", "document_index", "section_header")
ITEMS = (
    "page_no int, page_width double, page_height double, items array<struct<kind:string,label:string,text:string,caption:string,latex:string,"
    "orig:string,markdown:string,image_path:string,bbox:array<double>,bottom_left:boolean>>"
)
#: File name and content to pages with items.
FileParser = Callable[[str, bytes], Iterator[dict]]


def parse_lines(name: str, content: bytes, per_page: int = 40) -> Iterator[dict]:
    """A page of items for each ``per_page`` lines of a UTF-8 text; a line that starts with # is a title."""
    lines = content.decode("utf-8", "replace").split("\n")
    for at in range(0, len(lines), per_page):
        items = []
        for i, line in enumerate(lines[at : at + per_page]):
            title = line.startswith("#")
            items.append({"kind": "text", "label": "title" if title else "text", "text": line.lstrip("# ") if title else line, "bbox": [40.0, 18.0 * i, 560.0, 18.0 * i + 16], "bottom_left": False})
        yield {"page_no": at // per_page + 1, "page_width": 612.0, "page_height": 792.0, "items": items}


def scan_files(spark: SparkSession, root: str, course: str, pattern: str = "*", parse: FileParser = parse_lines, skip: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, title, source_file and the pages with items of every file below ``root``, but for the file names in ``skip``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(~name.isin(*skip)) if skip else files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                pages = [{"path": path, **page} for page in parse(path.rsplit("/", 1)[-1], bytes(content))]
                if pages:
                    yield pd.DataFrame(pages)

    pages = files.mapInPandas(run, f"path string, {ITEMS}")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return pages.select(
        document_id(stem, F.lit(course)).alias("doc_id"), document_title(stem, course).alias("title"), F.col("path").alias("source_file"),
        "page_no", "page_width", "page_height", "items",
    )


def enriches_formulas(file_name: Column, default: bool, never: tuple[str, ...] = ()) -> Column:
    """Whether formulas of a file are to be enriched: the default but for the files in ``never``."""
    return ~file_name.isin(*never) & F.lit(default) if never else F.lit(default)


def block_type(kind: Column, label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(kind == "picture", "figure").when(kind == "table", "table").when(low.isin(*TITLE_LABELS), "title").when(low == "formula", "formula").otherwise("text")
    )


def formula_text(item: Column) -> Column:
    """The first that is there: LaTeX, original, text, Markdown."""
    return F.coalesce(*[clean_text(item[k]) for k in ("latex", "orig", "text", "markdown")])


def blocks_from_items(pages: DataFrame) -> DataFrame:
    """A block for each item, numbered from 1 on its page; small figures go after numbering, so orders have gaps.

    A figure's text is its caption; a formula without text takes the first other form it has."""
    placed = pages.select("doc_id", "page_no", "page_width", "page_height", F.posexplode("items").alias("i", "item")).withColumn("reading_order", F.col("i") + 1)
    item = F.col("item")
    kind = block_type(item["kind"], item["label"])
    text = F.coalesce(clean_text(item["text"]), F.when(item["text"].isNull(), clean_text(item["markdown"])))
    text = F.when(kind == "formula", F.coalesce(text, formula_text(item))).when(item["kind"] == "table", clean_text(item["markdown"])).otherwise(text)
    raw = Box.of(item["bbox"])
    box = F.when(item["bottom_left"], from_bottom_left(raw, F.col("page_height"))).otherwise(F.array(*[F.bround(x, 2) for x in (raw.left, raw.top, raw.right, raw.bottom)]))
    made = placed.select(
        "doc_id", "page_no", "reading_order", F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page_no"), F.lit("_b"), F.col("reading_order")).alias("block_id"),
        kind.alias("type"), F.when(kind != "figure", text).alias("text"), F.when(kind == "figure", clean_text(item["caption"])).alias("caption"),
        F.when(kind.isin("figure", "formula"), item["image_path"]).alias("image_path"), box.alias("bbox"),
        F.bround("page_width", 2).alias("page_width"), F.bround("page_height", 2).alias("page_height"),
    )
    return made.filter((F.col("type") != "figure") | keep_figure(Box.of(F.col("bbox"))))
