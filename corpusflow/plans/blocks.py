"""Queries over the layout blocks made from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, formula_quality, section_key, token_count
from ..operators import context, layout
from ..sources.adapters import blocks_from_documents
from .tables import table


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(table(spark, d, "documents"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).cast("long").alias("n_tokens"))


def block_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return context.type_counts(blocks(spark, d))


def section_titles(spark: SparkSession, d: str) -> DataFrame:
    made = context.with_merged_section_title(blocks(spark, d)).select("doc_id", "block_id", F.col("section_title").alias("merged_title"))
    other = context.with_section_title(blocks(spark, d)).select("block_id", "section_title")
    return made.join(other, "block_id").select("doc_id", "block_id", "section_title", "merged_title", section_key(F.col("section_title")).alias("section_key"))


def nearby_text(spark: SparkSession, d: str) -> DataFrame:
    return context.with_nearby_text(blocks(spark, d)).select("block_id", "nearby_text_before", "nearby_text_after")


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    made = context.renumbered(context.without_lead(layout.figures_kept(blocks(spark, d))))
    return made.select("block_id", F.col("reading_order").cast("long").alias("reading_order"))


def figure_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return layout.drop_figure_fragments(blocks(spark, d), geometry_only=True).select("block_id", "type")


def table_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return layout.drop_table_fragments(blocks(spark, d), geometry_only=True).select("block_id", "type")


def formula_qualities(spark: SparkSession, d: str) -> DataFrame:
    made = blocks(spark, d).filter("type = 'formula'")
    return made.select("block_id", formula_quality(F.col("text")).alias("quality"))


QUERIES = {
    "token_counts": token_counts,
    "block_type_counts": block_type_counts,
    "section_title_ffill": section_titles,
    "nearby_text": nearby_text,
    "reading_order_renumber": reading_order,
    "bbox_figure_antijoin": figure_antijoin,
    "bbox_table_antijoin": table_antijoin,
    "formula_quality": formula_qualities,
}

NOT_WS = "[^" + WS[1:]
BLOCKS = rf"""
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
placed AS (SELECT doc_id, text, i, i // 6 + 1 AS page_no, i % 6 + 1 AS reading_order, (doc_id + i) AS turn,
                  len(regexp_extract_all(text, '{NOT_WS}+')) AS words FROM line),
kinded AS (SELECT *, CASE WHEN reading_order = 1 AND words <= 8 THEN 'title' WHEN turn % 7 = 3 THEN 'figure' WHEN turn % 7 = 5 THEN 'table'
                          WHEN turn % 11 = 4 THEN 'formula' ELSE 'text' END AS type FROM placed),
block AS (SELECT doc_id, page_no, reading_order, 'd' || doc_id || '_p' || page_no || '_b' || reading_order AS block_id, type, text, words,
                 40e0 + 60 * (turn % 4) AS l, 30e0 + 110 * (reading_order - 1) AS t,
                 40e0 + 60 * (turn % 4) + CASE WHEN type IN ('figure', 'table') THEN 260e0 ELSE 120e0 + length(text) % 300 END AS r,
                 30e0 + 110 * (reading_order - 1) + CASE WHEN type IN ('figure', 'table') THEN 200e0 ELSE 40e0 + length(text) % 90 END AS b,
                 nullif(trim(regexp_replace(replace(text, chr(160), ' '), '{WS}+', ' ', 'g')), '') AS clean
          FROM kinded)"""
PAIR = """
pair AS (SELECT x.block_id, x.type, x.doc_id, x.page_no, x.l, x.t, x.r, x.b, f.l AS fl, f.t AS ft, f.r AS fr, f.b AS fb, f.block_id AS figure_id,
                greatest(0e0, least(x.r, f.r) - greatest(x.l, f.l)) AS cw, greatest(0e0, least(x.b, f.b) - greatest(x.t, f.t)) AS ch,
                (x.r - x.l) * (x.b - x.t) AS area, (f.r - f.l) * (f.b - f.t) AS figure_area
         FROM block x JOIN block f ON f.doc_id = x.doc_id AND f.page_no = x.page_no AND f.type = '{kind}')"""
INSIDE = "(l >= fl - 2 AND t >= ft - 2 AND r <= fr + 2 AND b <= fb + 2)"
ORACLE_SQL = {
    "token_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{NOT_WS}+')) AS BIGINT) AS n_tokens FROM documents",
    "block_type_counts": f"""WITH {BLOCKS} SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (type = 'title') AS n_title, count(*) FILTER (type = 'text') AS n_text,
count(*) FILTER (type = 'table') AS n_table, count(*) FILTER (type = 'figure') AS n_figure, count(*) FILTER (type = 'formula') AS n_formula FROM block GROUP BY doc_id""",
    "section_title_ffill": f"""WITH {BLOCKS},
t AS (SELECT *, CASE WHEN type = 'title' THEN clean END AS title FROM block),
o AS (SELECT *, CASE WHEN block_id IS DISTINCT FROM first_value(block_id) OVER (PARTITION BY doc_id ORDER BY title IS NULL, page_no, reading_order) THEN title END AS own FROM t),
w AS (SELECT doc_id, block_id,
  coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           arg_max(title, page_no * 100 + reading_order) FILTER (title IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY page_no RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS section_title,
  coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           arg_max(own, page_no * 100 + reading_order) FILTER (own IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY page_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS merged_title
  FROM o)
SELECT *, nullif(trim(regexp_replace(lower(section_title), '[^a-z0-9]+', ' ', 'g')), '') AS section_key FROM w""",
    "nearby_text": f"""WITH {BLOCKS}, u AS (SELECT *, CASE WHEN type IN ('text', 'title') AND length(clean) >= 16 THEN clean END AS usable FROM block),
w AS (SELECT block_id,
  list(usable) FILTER (usable IS NOT NULL) OVER (PARTITION BY doc_id, page_no ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  list(usable) FILTER (usable IS NOT NULL) OVER (PARTITION BY doc_id, page_no ORDER BY reading_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM u)
SELECT block_id, nullif(array_to_string(p[greatest(1, len(p) - 2):len(p)], ' '), '') AS nearby_text_before, nullif(array_to_string(n[1:3], ' '), '') AS nearby_text_after FROM w""",
    "reading_order_renumber": f"""WITH {BLOCKS},
k AS (SELECT *, min(CASE WHEN type = 'title' THEN reading_order END) OVER (PARTITION BY doc_id, page_no) AS first FROM block
      WHERE type <> 'figure' OR (r - l >= 24 AND b - t >= 24 AND (r - l) * (b - t) >= 2000))
SELECT block_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY reading_order) AS reading_order FROM k WHERE first IS NULL OR first <= 1 OR reading_order >= first""",
    "bbox_figure_antijoin": f"""WITH {BLOCKS}, {PAIR.format(kind="figure")},
hit AS (SELECT DISTINCT block_id FROM pair WHERE type IN ('text', 'title', 'formula') AND ({INSIDE} OR cw * ch / area >= 0.5 OR (type = 'formula' AND cw * ch > 0)
        OR (type = 'text' AND cw * ch > 0 AND (((l + r) / 2 BETWEEN fl - 2 AND fr + 2 AND (t + b) / 2 BETWEEN ft - 2 AND fb + 2) OR cw * ch / figure_area >= 0.12))))
SELECT block_id, type FROM block WHERE block_id NOT IN (SELECT block_id FROM hit)""",
    "bbox_table_antijoin": f"""WITH {BLOCKS}, {PAIR.format(kind="table")},
hit AS (SELECT DISTINCT block_id FROM pair WHERE type = 'text' AND ({INSIDE} OR cw * ch / area >= 0.35))
SELECT block_id, type FROM block WHERE NOT (block_id IN (SELECT block_id FROM hit) AND trim(text) <> '')""",
    "formula_quality": rf"""WITH {BLOCKS}, f AS (SELECT block_id, trim(text) AS s FROM block WHERE type = 'formula'),
c AS (SELECT *, abs(length(s) - length(replace(s, '{{', '')) - length(s) + length(replace(s, '}}', ''))) AS bd,
             abs(length(s) - length(replace(s, '(', '')) - length(s) + length(replace(s, ')', ''))) AS pd FROM f)
SELECT block_id, CASE WHEN s = '' OR bd >= 2 OR pd >= 2 OR regexp_matches(s, '[=+\-\\{{(]$') OR regexp_matches(s, '^(?:[0-3]\)|\\\\|&)')
   OR (contains(s, '\text {{') AND contains(s, '\\') AND length(s) > 120) THEN 'truncated'
 WHEN regexp_matches(s, '(?:[A-Za-z]{WS}+){{3,}}[A-Za-z](?:[^A-Za-z]|$)') OR contains(s, '\ ') OR regexp_matches(s, '\\\\{WS}+[A-Za-z]') OR regexp_matches(s, '[A-Za-z]+\\max')
   OR regexp_matches(s, '\\[A-Za-z]+{WS}+[A-Za-z]+') OR contains(s, '\mathring') OR contains(s, '\intercal') OR bd = 1 OR pd = 1 THEN 'noisy' ELSE 'good' END AS quality FROM c""",
}
