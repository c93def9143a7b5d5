"""Enrichment rules over the texts of made slides: candidates, spans and keywords come from whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NBSP, PLAY, WS, formula_quality
from ..operators import enrich
from .slides import BEYOND, CLEAN_LINE, NEIGHBOUR, ORACLE_SQL as SLIDE_SQL, SLIDES, collapsed, counted, made_slides, matched, quality_sql, quoted, replaced, without


def overall_quality(spark: SparkSession, d: str) -> DataFrame:
    made = made_slides(spark, d)
    latex = F.when(F.col("reading_order") % 2 == 0, F.concat(F.lit("\\alpha = "), F.col("text")))
    usable = enrich.usable_semantics(F.lit("a formula"), F.col("text"), F.lit("Head"))
    model = F.when(F.col("page_no") % 3 == 0, "poor").otherwise("good")
    return made.select("block_id", usable.alias("usable"), enrich.overall_quality(model, formula_quality(F.col("text")), F.col("text"), F.lit(False), latex, usable).alias("quality"))


def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return made_slides(spark, d).select("block_id", F.array_join(enrich.keywords(F.col("text")), "|").alias("keywords"))


def latex_choice(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    chosen = enrich.choose_latex([("model", F.when(F.col("reading_order") > 3, F.concat(F.lit("{{"), text))), ("scan", F.when(F.col("page_no") > 1, F.concat(F.lit("\\zeta "), text))), ("rules", text)])
    return made_slides(spark, d).select("block_id", chosen["source"].alias("source"), chosen["latex"].alias("latex"))


def inline_math_filter(spark: SparkSession, d: str) -> DataFrame:
    span = lambda w: F.struct(w.alias("raw"), w.alias("normalized"), F.lit(None).cast("string").alias("math_name"))
    spans = F.transform(F.split("text", " "), span)
    return made_slides(spark, d).select("block_id", enrich.keeps_inline_math(F.col("text"), F.col("text"), spans).alias("keeps"))


def figure_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Figures whose model gives an answer on odd pages only: what stands in the answer, else what the texts nearby allow."""
    near = enrich.with_figure_neighbours(made_slides(spark, d))
    made = made_slides(spark, d).filter("type = 'figure'").join(near, "block_id")
    answer = F.when(F.col("page_no") % 2 == 1, F.concat(F.lit('```json\n{"visual_description": "shows  a plot", "keywords": [], "overall_quality": "'), F.when(F.col("doc_id") % 2 == 0, "good").otherwise("fine"), F.lit('"}\n```')))
    told = enrich.figure_answer(answer, F.col("nearby_text_before"), F.col("nearby_text_after"), F.when(F.col("doc_id") % 3 > 0, "Second part of it."))
    return made.select("block_id", told["visual_description"].alias("description"), told["figure_focus"].alias("focus"), told["overall_quality"].alias("quality"))


QUERIES = {
    "overall_quality": overall_quality, "keyword_extract": keyword_extract, "latex_choice": latex_choice, "inline_math_filter": inline_math_filter,
    "figure_fallback": figure_fallback,
}

LINE_OF = lambda x: collapsed(without(f"coalesce({x}, '')", PLAY, NBSP))
KNOWN = ", ".join(map(quoted, enrich.KNOWN_COMMANDS))


def errors(c: str) -> str:
    pairs = " OR ".join(f"{counted(c, a)} <> {counted(c, b)}" for a, b in (("[{]", "[}]"), (r"\\left", r"\\right"), (r"\\begin", r"\\end")))
    return f"coalesce({c} = '' OR {pairs} OR len(list_filter(regexp_extract_all({c}, '\\\\([A-Za-z]+)', 1), lambda k: k NOT IN ({KNOWN}))) > 0, true)"


def doubtful(c: str) -> str:
    return f"coalesce({matched(c, enrich.SUSPICIOUS)}, false)"


SYMBOL = replaced(replaced(replaced("replace(replace(replace(trim(w, '$'), '^\\star', ''), '\\star', ''), '⋆', '')", "_[A-Za-z0-9]+$", ""), r"\^[A-Za-z0-9]+$", ""), enrich.GREEK, "v")
TRIVIAL = f"""({matched(SYMBOL, r"^[A-Za-zα-ωΑ-Ω]" + chr(92) + "p{Nd}*$")} OR {matched('w', r"^" + chr(92) + "([A-Za-z](?:,[A-Za-z]){0,3}" + chr(92) + ")$")}
  OR lower(w) IN ('1/0', '0/1', 'yes/no', 'true/false') OR (({counted('w', '=')}) >= 2 AND contains(lower(w), '\\text{{'))
  OR {matched('lower(w)', 'score|grade|points|threshold|cutoff', r"^(?:[<>]=?|[≈~∼])" + chr(92) + "d+(?:" + chr(92) + "." + chr(92) + "d+)?$")}
  OR {matched(replaced('lower(w)', f"[{BEYOND}]", 'q'), chr(92) + "b(?:hours?|days?|weeks?|minutes?|pts?|points?)" + chr(92) + "b")}
  OR {matched('w', r"^" + chr(92) + "d+(?:" + chr(92) + "." + chr(92) + "d+)?-" + chr(92) + "d+(?:" + chr(92) + "." + chr(92) + "d+)?$")})"""
PHRASES = f"list_transform(regexp_extract_all({replaced('text', f'[{chr(92)}p{{L}}{chr(92)}p{{N}}_]*[{BEYOND}][{chr(92)}p{{L}}{chr(92)}p{{N}}_]*', '¤')}, {quoted(enrich.KEYWORD)}), lambda p: {collapsed('p')})"
BANNED = " OR ".join(f"contains(lower(p), {quoted(b)})" for b in enrich.BANNED_PHRASES)
STOP = ", ".join(map(quoted, enrich.STOPWORDS))
TELLING = f"len(list_filter(regexp_extract_all(lower(p), '[a-z][a-z0-9_\\-]*'), lambda v: v NOT IN ({STOP})))"
CLEAN_OF = lambda x: f"nullif({collapsed(without(x, NBSP))}, '')"
ORACLE_SQL = {
    "overall_quality": f"""WITH {SLIDES}, f AS (SELECT *, trim(text) AS s, {CLEAN_LINE} AS e, CASE WHEN reading_order % 2 = 0 THEN '\alpha = ' || text END AS latex FROM block),
g AS (SELECT *, length(e) >= 32 AND NOT {matched('lower(e)', enrich.GENERIC_STARTS)} AND NOT (contains(lower(e), 'head') AND {counted('e', '[^ ]+')} <= 10) AS usable FROM f)
SELECT block_id, usable, CASE WHEN text = '' THEN 'broken' WHEN ({quality_sql('s')}) = 'truncated' AND NOT usable THEN 'broken'
  WHEN {errors('latex')} OR {doubtful('latex')} THEN CASE WHEN usable THEN 'poor' ELSE 'broken' END WHEN page_no % 3 = 0 THEN 'poor' ELSE 'good' END AS quality FROM g""",
    "keyword_extract": f"""WITH {SLIDES}, k AS (SELECT block_id, list_filter({PHRASES}, lambda p: NOT ({BANNED}) AND {TELLING} >= CASE WHEN len(regexp_extract_all(lower(p), '[a-z][a-z0-9_\\-]*')) >= 2 THEN 2 ELSE 1 END) AS p FROM block)
SELECT block_id, array_to_string(list_filter(p, lambda w, i: list_position(list_transform(p, lambda v: lower(v)), lower(w)) = i)[1:10], '|') AS keywords FROM k""",
    "latex_choice": rf"""WITH {SLIDES}, f AS (SELECT block_id, CASE WHEN reading_order > 3 THEN '{{{{' || text END AS a, CASE WHEN page_no > 1 THEN '\zeta ' || text END AS b, text AS c FROM block),
g AS (SELECT *, {errors('c')} OR {doubtful('c')} AS bad FROM f)
SELECT block_id, CASE WHEN NOT bad THEN 'rules' WHEN a IS NOT NULL THEN 'model' WHEN b IS NOT NULL THEN 'scan' WHEN c <> '' THEN 'rules' END AS source,
  CASE WHEN NOT bad THEN c WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b WHEN c <> '' THEN c END AS latex FROM g""",
    "inline_math_filter": f"""WITH {SLIDES}, n AS (SELECT block_id, text, len(list_filter(string_split(text, ' '), lambda w: w <> '' AND NOT {TRIVIAL})) AS n FROM block)
SELECT block_id, text <> '' AND n > 0 AND NOT (n = 1 AND {matched(replaced('lower(text)', f"[{BEYOND}]", 'q'), chr(92) + "b(?:score|grade|points?)" + chr(92) + "b")} AND length(text) < 120) AS keeps FROM n""",
    "figure_fallback": f"""WITH near AS ({SLIDE_SQL['figure_neighbours']}), {SLIDES},
f AS (SELECT b.block_id, page_no, doc_id, nearby_text_before AS p, nearby_text_after AS n, CASE WHEN doc_id % 3 > 0 THEN 'Second part of it.' END AS section FROM block b JOIN near USING (block_id)),
g AS (SELECT *, {CLEAN_OF("concat_ws(' ', CASE WHEN section IS NULL THEN 'This figure supports the surrounding lecture content.' ELSE 'This figure appears in the ' || section || ' section.' END, 'Nearby text indicates that ' || " + CLEAN_OF("concat_ws(' ', p, n)") + " || '.')")} AS whole FROM f),
h AS (SELECT *, CASE WHEN page_no % 2 = 1 THEN 'shows a plot' ELSE array_to_string(string_split(regexp_replace(whole, '([.!?])[ ]+', '\\1' || chr(1), 'g'), chr(1))[1:4], ' ') END AS description FROM g),
k AS (SELECT *, rtrim(array_to_string(string_split({NEIGHBOUR.replace('replace(text,', 'replace(section,', 1)}, ' ')[1:15], ' '), '.') AS a,
  rtrim(array_to_string(string_split({NEIGHBOUR.replace('replace(text,', 'replace(description,', 1)}, ' ')[1:15], ' '), '.') AS b FROM h)
SELECT block_id, description, CASE WHEN section IS NOT NULL AND {counted('a', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} >= 2 THEN a WHEN {counted('b', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} >= 2 THEN b END AS focus,
  CASE WHEN page_no % 2 = 1 AND doc_id % 2 = 0 THEN 'good' END AS quality FROM k""",
}
