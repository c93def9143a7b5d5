"""JSON documents, images, vectors and indexes as tables; envelopes for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit

BLOCK = (
    "struct<block_id:string,type:string,text:string,caption:string,image_path:string,bbox:array<double>,reading_order:int,formula_quality:string,"
    "contains_code:boolean,extracted_from_figure:boolean,code_segments:array<struct<kind:string,text:string>>>"
)
DOCUMENTS = (
    "course_id string, course_name string, source_type string, created_at string, documents array<struct<doc_id:string,title:string,source_file:string,"
    f"page_count:int,pages:array<struct<page_no:int,width:double,height:double,blocks:array<{BLOCK}>>>>>"
)
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def input_path(spark: SparkSession, folder: str, course: str, explicit: str | None = None) -> str:
    """The explicit path, else the processed document if there is one, else the extracted one."""
    processed = f"{folder}/{course}/{course}_processed.json"
    return explicit or (processed if exists(spark, processed) else f"{folder}/{course}/{course}_document.json")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_if_sound(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like ``read_json``, but nothing where the file is missing, no JSON or no object."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    return found.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def blocks_of(documents: DataFrame) -> DataFrame:
    """A row for each block of course documents, with document and page."""
    pages = documents.select("course_id", F.explode("documents").alias("d")).select("course_id", "d.doc_id", F.explode("d.pages").alias("p"))
    return pages.select("course_id", "doc_id", "p.page_no", F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.explode("p.blocks").alias("b")).select(
        "course_id", "doc_id", "page_no", "page_width", "page_height", "b.*"
    )


def documents_of(blocks: DataFrame, **envelope: str) -> DataFrame:
    """The other way: one row with all documents, pages and blocks in order (for the export of a course, not a corpus)."""
    inner = [f.split(":")[0] for f in ("block_id", "type", "text", "caption", "image_path", "bbox", "reading_order", "formula_quality", "contains_code", "extracted_from_figure", "code_segments")]
    block = F.struct(*[F.col(c) for c in inner if c in blocks.columns])
    order = F.struct(F.col("reading_order").alias("_o"), block.alias("b"))
    pages = blocks.groupBy("doc_id", "page_no").agg(F.first("page_width").alias("width"), F.first("page_height").alias("height"), F.array_sort(F.collect_list(order), lambda x, y: x["_o"] - y["_o"]).alias("o"))
    pages = pages.select("doc_id", F.struct("page_no", "width", "height", F.transform("o", lambda x: x["b"]).alias("blocks")).alias("p"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("p"), lambda x, y: x["page_no"] - y["page_no"]).alias("pages"))
    doc = F.struct("doc_id", F.size("pages").alias("page_count"), "pages")
    return docs.agg(F.sort_array(F.collect_list(doc)).alias("documents")).select(*[F.lit(v).alias(k) for k, v in envelope.items()], "documents")


def enveloped(rows: DataFrame, name: str, order: list[str], **envelope: Column) -> DataFrame:
    """One row: the envelope's columns (aggregates allowed) and all rows as an ordered array ``name``, for export only."""
    body = F.struct(*[F.col(c) for c in rows.columns])
    keyed = F.struct(F.struct(*[F.col(c) for c in order]).alias("_k"), body.alias("_v"))
    listed = F.transform(F.array_sort(F.collect_list(keyed), lambda x, y: F.when(x["_k"] < y["_k"], -1).when(x["_k"] > y["_k"], 1).otherwise(0)), lambda x: x["_v"])
    return rows.agg(*[c.alias(k) for k, c in envelope.items()], F.count("*").alias("count"), listed.alias(name))


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """Rows as JSON, nulls included, in place of what was there; ``pretty`` indents."""
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str, query: str, **settings: object) -> None:
    """Fused results with the settings of their query."""
    told = {"query": query, "method": "hybrid_dense_bm25_rrf", **settings}
    write_json(enveloped(results, "results", ["rank"], **{k: F.lit(v) for k, v in told.items()}), path, pretty=True)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name and content of the images below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    low = F.lower("path")
    known = F.lit(False)
    for s in SUFFIXES:
        known = known | F.endswith(low, F.lit(s))
    return found.filter(known).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def resolved_images(blocks: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """(block_id, path) of each block's image: its own path, that below ``root``, its name in ``root``, its block id with each suffix
    in ``root``, then the same two names anywhere below.  The first that exists wins; of equal names the least path."""
    own = F.col("image_path")
    name = F.element_at(F.split(own, "/"), -1)
    ids = [F.concat(F.col("block_id"), F.lit(s)) for s in SUFFIXES]
    direct = [own, F.when(~F.startswith(own, F.lit("/")), F.concat(F.lit(f"{root}/"), own)), F.concat(F.lit(f"{root}/"), name), *[F.concat(F.lit(f"{root}/"), i) for i in ids]]
    wanted = F.concat(
        F.transform(F.array(*direct), lambda p, i: F.struct(i.alias("rank"), p.alias("path"), F.lit(None).cast("string").alias("name"))),
        F.transform(F.array(name, *ids), lambda n, i: F.struct((i + 100).alias("rank"), F.lit(None).cast("string").alias("path"), n.alias("name"))),
    )
    asked = blocks.select("block_id", F.explode(wanted).alias("w")).select("block_id", "w.*")
    there = images.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "name")
    by_path = asked.filter("path is not null").drop("name").join(there.select("path"), "path").select("block_id", "rank", "path")
    by_name = asked.filter("name is not null").drop("path").join(there.groupBy("name").agg(F.min("path").alias("path")), "name").select("block_id", "rank", "path")
    return by_path.unionByName(by_name).groupBy("block_id").agg(F.min_by("path", "rank").alias("path"))


def data_url(path: Column, content: Column) -> Column:
    kind = F.when(F.lower(path).rlike(r"\.png$"), "png").otherwise("jpeg")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose ``values`` is a list with numbers, as floats; an error if none is left."""
    kept = vectors.filter(F.size("values") > 0).withColumn("values", F.col("values").cast("array<float>"))
    if kept.isEmpty():
        raise ValueError("no vectors")
    return kept


def write_index(vectors: DataFrame, path: str) -> None:
    """``vectors`` (level, id, values and what else is to be kept) with a row number in each level and unit vectors, a folder a level."""
    numbered = sound_vectors(vectors).withColumn("row_id", F.monotonically_increasing_id())
    numbered.withColumn("values", unit(F.col("values"))).write.mode("overwrite").partitionBy("level").parquet(path)


def load_index(spark: SparkSession, path: str, level: str) -> DataFrame:
    if not exists(spark, f"{path}/level={level}"):
        raise FileNotFoundError(f"no index of level {level} in {path}")
    return spark.read.parquet(path).filter(F.col("level") == level)


def with_items(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hits by row number with what the index holds on them; numbers of no row go, the ranks of the others stay."""
    return hits.filter("row_id >= 0").join(items, "row_id")
