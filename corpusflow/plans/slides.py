"""Queries over made slides: pages in five layouts whose boxes and texts make every layout rule fire.

A line of ``documents`` is a block, eight a page; half of the blocks keep their line, the others carry one of TEXTS."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import Box, keep_figure
from ..operators import context, enrich, layout, notebook, rules, slides
from .tables import table

TEXTS = (
    "Figure 3: the loss of the second model", "Table 2 lists what each of the models scored on all of the tasks that were tried in the course", "0.91/0.85/0.77",
    "1,234%", "1,234", "Accuracy", "GPT-3 (175B)", "MNLI 84.1 and 90.2", "a | 1 | 2", "12.5", "ab", "What is the answer to this?", "In [3]: import numpy as np",
    "df = pd.read_csv('a.csv') # read it print(df) 5", "! echo hi there", "This example is a sentence where we use a plain word = 3.", "1 2 3 4 5 6", "frequency",
    "Traceback (most recent call last) KeyError", "- 0.5", "the estimate is 0.5 with 0.1 and 0.2 and 0.3 of all the values here", "Full Scoring: P (a)", "p-value",
    "sample mean and variance are independent of the bias here", "•", "2 x 3 of a bc", "model size / task", "num trainable parameters / task", "density of residuals",
    "x-axis time", "\\alpha = \\frac{a}{b}", "∑ i = 1 x (i) , y ; z ( 1 - a )",
)
WIDE = [[40, 20 + 90 * k, 560, 70 + 90 * k] for k in range(8)]
LAYOUTS = (
    # Texts in two columns beside a large figure.
    [("title", WIDE[0]), ("text", WIDE[1]), ("figure", [150, 200, 450, 600]), ("text", [20, 220, 140, 300]), ("text", [22, 320, 138, 400]), ("text", [470, 220, 590, 300]), ("text", [470, 320, 590, 400]), ("text", [40, 640, 560, 690])],
    # A figure too small to keep, one just large enough, fragments in and below it.
    [("text", WIDE[0]), ("figure", [100, 100, 120, 110]), ("figure", [100, 150, 140, 200]), ("text", [105, 155, 135, 170]), ("text", [100, 215, 200, 230]), ("formula", [110, 160, 130, 190]), ("title", WIDE[4]), ("text", WIDE[5])],
    # A table with texts in it, across its edge, near it and far from it.
    [("title", WIDE[0]), ("table", [100, 300, 500, 420]), ("text", [120, 320, 180, 340]), ("text", [100, 430, 300, 445]), ("text", WIDE[6]), ("text", [100, 406, 300, 440]), ("text", [100, 190, 300, 210]), ("text", WIDE[7])],
    # A screenshot of a notebook.
    [("title", WIDE[0]), ("figure", [50, 100, 560, 500]), ("text", [60, 120, 540, 160]), ("text", [60, 180, 540, 220]), ("text", [60, 240, 540, 280]), ("text", [60, 300, 540, 340]), ("text", WIDE[6]), ("formula", WIDE[7])],
    # Texts in front of the first title, a footer.
    [("text", WIDE[0]), ("text", WIDE[1]), ("title", WIDE[2]), ("text", WIDE[3]), ("formula", WIDE[4]), ("text", WIDE[5]), ("text", WIDE[6]), ("text", [40, 760, 560, 785])],
)
PLACES = [{"type": k, "box": [float(x) for x in b]} for page in LAYOUTS for k, b in page]


def made_slides(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    page, order = F.floor(F.col("i") / 8).cast("int") + 1, F.col("i") % 8 + 1
    place = F.get(F.from_json(F.lit(json.dumps(PLACES)), "array<struct<type:string,box:array<double>>>"), ((F.col("doc_id") + page) % 5 * 8 + F.col("i") % 8).cast("int"))
    pick = ((F.col("doc_id") * 5 + F.col("i") * 7) % (2 * len(TEXTS))).cast("int")
    text = F.coalesce(F.get(F.from_json(F.lit(json.dumps(TEXTS)), "array<string>"), pick), F.col("line"))
    return lines.select("doc_id", page.alias("page_no"), order.alias("reading_order"), text.alias("text"), place.alias("place")).select(
        "doc_id", "page_no", "reading_order", F.concat(F.lit("d"), F.col("doc_id"), F.lit("_p"), F.col("page_no"), F.lit("_b"), F.col("reading_order")).alias("block_id"),
        F.col("place.type").alias("type"), "text", F.col("place.box").alias("bbox"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


def column_islands(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_clusters(made_slides(spark, d)).select("block_id")


def figures_kept(spark: SparkSession, d: str) -> DataFrame:
    return made_slides(spark, d).filter("type = 'figure'").select("block_id", keep_figure(Box.of(F.col("bbox"))).alias("kept"))


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return made_slides(spark, d).select(
        "block_id", rules.is_obvious_noise(text).alias("noise"), rules.is_caption(text).alias("caption"), rules.is_noisy(text).alias("noisy"),
        rules.is_table_summary(text).alias("summary"), rules.is_numeric_sentence(text).alias("numeric"), rules.is_table_fragment(text).alias("cell"),
        rules.is_figure_fragment(text).alias("label"),
    )


def slide_flags(spark: SparkSession, d: str) -> DataFrame:
    text, t = F.col("text"), rules.bare(F.col("text"))
    return made_slides(spark, d).select(
        "block_id", slides.is_noise(text).alias("noise"), slides.is_cell(text).alias("cell"), slides.is_numeric_sentence(text).alias("numeric"),
        slides.is_content(F.col("type"), text).alias("content"), slides.is_label(text).alias("label"), slides.is_axis_fragment(t, Box.of(F.col("bbox"))).alias("axis"),
    )


def code_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(notebook.tidy(F.col("text")), F.lit(""))
    return made_slides(spark, d).select(
        "block_id", notebook.is_code(t).alias("code"), notebook.clean_code(t).alias("cleaned"), notebook.segment_kind(t).alias("kind"),
        notebook.is_axis_noise(t).alias("axis"), notebook.is_cell(t).alias("cell"), notebook.is_figure_noise(t).alias("figure_noise"),
    )


def code_segments(spark: SparkSession, d: str) -> DataFrame:
    t = notebook.tidy(F.col("text"))
    made = made_slides(spark, d).filter(t.isNotNull()).select("block_id", F.posexplode(notebook.code_segments(t)).alias("i", "s"))
    return made.select("block_id", F.col("i").cast("long").alias("i"), F.col("s.kind").alias("kind"), F.col("s.text").alias("text"))


def latex_repairs(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return made_slides(spark, d).select(
        "block_id", T.clean_formula(text).alias("cleaned"), T.repair_latex(text).alias("repaired"), T.latex_of_formula(text).alias("latex"),
        T.formula_quality(text).alias("full"), T.formula_quality(text, max_rule=False, command_rule=False).alias("short"),
        T.formula_quality(text, max_rule=False, command_rule=False, text_rule=False, accent_rule=False).alias("least"),
    )


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    text, wrapped = F.col("text"), F.concat(F.lit("$$"), F.col("text"), F.lit("$$"))
    return made_slides(spark, d).select(
        "block_id", T.normalize_sentence(text, figure_prefix=True).alias("sentence"), T.slugify(text).alias("slug"), T.document_id(text, F.lit("ab")).alias("doc_slug"),
        T.document_title(text, "this").alias("title"), T.compact(text, 40).alias("short"), T.strip_control(F.concat(text, F.lit("\x07 x"))).alias("plain"),
        T.strip_latex(wrapped).alias("bare"), T.strip_code_fence(F.concat(F.lit("```json\n"), text, F.lit("\n```"))).alias("unfenced"), T.block_number(F.col("block_id")).cast("long").alias("number"),
        F.array_join(T.sanitized_keywords(F.split(text, " "), 5), "|").alias("keywords"),
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.select("block_id", "type", "text", F.col("reading_order").cast("long").alias("reading_order"), "formula_quality")


def profile_papers(spark: SparkSession, d: str) -> DataFrame:
    return _shown(slides.post_process_papers(made_slides(spark, d)))


def profile_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _shown(slides.post_process_statistics(made_slides(spark, d)))


def profile_notebook(spark: SparkSession, d: str) -> DataFrame:
    made = notebook.post_process(made_slides(spark, d))
    return _shown(made).join(made.select("block_id", "contains_code", "extracted_from_figure"), "block_id")


def profile_deltas(spark: SparkSession, d: str) -> DataFrame:
    before = made_slides(spark, d)
    return context.before_and_after(before, notebook.post_process(before))


def formula_context(spark: SparkSession, d: str) -> DataFrame:
    made = context.with_formula_section_title(made_slides(spark, d)).select("block_id", "section_title")
    return enrich.with_formula_context(made_slides(spark, d)).select("block_id", "nearby_text_before", "nearby_text_after").join(made, "block_id")


def figure_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return enrich.with_figure_neighbours(made_slides(spark, d))


QUERIES = {
    "column_islands": column_islands, "figure_size": figures_kept, "noise_filter": noise_filter, "slide_flags": slide_flags, "code_flags": code_flags,
    "code_segments": code_segments, "latex_repairs": latex_repairs, "text_functions": text_functions, "profile_papers": profile_papers,
    "profile_statistics": profile_statistics, "profile_notebook": profile_notebook, "profile_deltas": profile_deltas, "formula_context": formula_context,
    "figure_neighbours": figure_neighbours,
}


# SQL ------------------------------------------------------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matched(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


def counted(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def replaced(x: str, pattern: str, by: str) -> str:
    by = by.replace("\\\\", "\x00").replace("$0", "\\0").replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3").replace("\x00", "\\\\")
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(T.WS + '+')}, ' ', 'g'))"


def without(x: str, *chars: str) -> str:
    for c in chars:
        x = f"replace({x}, {quoted(c)}, ' ')"
    return x


WORDS = counted("{0}", T.NOT_WS + "+")
words = lambda x: counted(x, T.NOT_WS + "+")
BARE = f"regexp_replace(regexp_replace(coalesce(text, ''), {quoted('^' + T.WS + '+')}, ''), {quoted(T.WS + '+$')}, '')"
CLEAN_LINE = collapsed(without("coalesce(text, '')", T.PLAY, T.NBSP))
TIDY = f"nullif({collapsed(without('replace(text, ' + quoted(T.ZWSP) + ', ' + quoted('') + ')', T.PLAY, T.NBSP))}, '')"
SLIDES = f"""
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
put AS (SELECT *, i // 8 + 1 AS page_no, i % 8 + 1 AS reading_order,
               [{', '.join(f"{{'type': '{p['type']}', 'box': {[float(x) for x in p['box']]}::DOUBLE[]}}" for p in PLACES)}][(doc_id + i // 8 + 1) % 5 * 8 + i % 8 + 1] AS place,
               coalesce([{', '.join(map(quoted, TEXTS))}][(doc_id * 5 + i * 7) % {2 * len(TEXTS)} + 1], line) AS text FROM line),
block AS (SELECT doc_id, page_no, reading_order, 'd' || doc_id || '_p' || page_no || '_b' || reading_order AS block_id, place.type AS type, text,
                 place.box[1] AS l, place.box[2] AS t, place.box[3] AS r, place.box[4] AS b, {BARE} AS x, {words('coalesce(text, ' + quoted('') + ')')} AS words FROM put)"""
NUM = counted("x", rules.NUMBER)
FLAT = collapsed("x")
DIGITS = counted("x", r"\p{Nd}")
ENDED = matched(FLAT, "[.?!]$")
HEADERS = ", ".join(map(quoted, rules.HEADER_WORDS))
RULES = {
    "caption": matched("x", r"(?i)^(?:figure|fig|table)\b", r"(?i)\b(?:figure|fig|table)" + T.WS + "+[A-Za-z]?[0-9]"),
    "noisy": f"""(x <> '' AND ((contains(x, '|') AND {NUM} >= 2) OR {NUM} >= 6 OR ({matched('x', rules.METRIC_NAME)} AND {NUM} >= 2) OR {matched('x', rules.OCR_MARKS)}
      OR ({matched('x', rules.DIMENSIONS)} AND {counted('x', chr(92) + 'b[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{1,3}' + chr(92) + 'b')} >= 2) OR ({matched('x', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AND {NUM} >= 1)))""",
    "summary": f"(x <> '' AND ({matched('x', '(?i)^table' + chr(92) + 'b')} OR length(x) >= 70 OR {words('x')} >= 12))",
    "numeric": f"({words('x')} >= 10 AND ({NUM} >= 6 OR {counted('x', rules.SLASHED)} >= 2 OR ({NUM} >= 4 AND {words('x')} <= 28)))",
    "cell": f"""(x <> '' AND {words('x')} <= 4 AND length(x) <= 64 AND ({matched(FLAT, *rules.CELL_NUMBERS, rules.METRIC_CELL, rules.MODEL_CELL, rules.HEADER_CELL)}
      OR contains(x, '|') OR lower({FLAT}) IN ({HEADERS})))""",
}
SENTENCE = f"({words('x')} >= 5 AND {matched('x', '[a-z]{3,}')})"
RULES["noise"] = f"""(CASE WHEN x = '' THEN false WHEN {words('x')} <= 2 THEN true WHEN length(x) <= 12 THEN true WHEN {matched('x', rules.SCORING)} THEN false
  WHEN {matched('x', *rules.NOISE_NUMBERS)} THEN true WHEN ({NUM} >= 3 OR {DIGITS}::DOUBLE / greatest(length(x), 1) >= 0.35) AND NOT {SENTENCE} THEN true
  WHEN {RULES['noisy']} THEN true WHEN {RULES['cell']} AND NOT {SENTENCE} THEN true ELSE false END)"""
RULES["label"] = f"""(x <> '' AND NOT {matched(FLAT, rules.SCORING)} AND (({words('x')} <= 4 AND length(x) <= 42 AND NOT {ENDED})
  OR (({matched(FLAT, rules.QUESTION_START)} OR contains(lower({FLAT}), 'question answering') OR starts_with(lower({FLAT}), 'allow ')) AND {words('x')} <= 10)
  OR (({matched(FLAT, rules.OUTPUT_WORDS)} OR starts_with({FLAT}, '<>')) AND NOT ({words('x')} >= 6 OR {ENDED} OR contains(x, ';') OR (contains(x, ':') AND {words('x')} >= 5)))
  OR (({matched(FLAT, rules.LEGEND_WORDS)} OR contains(x, '|')) AND {words('x')} <= 8) OR ({matched(FLAT, rules.DEMO_WORDS)} AND {words('x')} <= 8)))"""
#: Java and Python count these letters in word boundaries, RE2 does not.
BEYOND = r"\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{3FF}\x{400}-\x{52F}"
ASCII_FLAT = replaced(FLAT, f"[{BEYOND}]", "q")
GARBAGE = f"((length({{0}}) <= 2 AND {{0}} IN ({', '.join(map(quoted, slides.GARBAGE))})) OR regexp_matches({{0}}, '^[^\\p{{{{L}}}}\\p{{{{N}}}}]$'))"
garbage = lambda x: GARBAGE.format(x)
STAT_CELLS = ", ".join(map(quoted, slides.CELL_HEADERS))
STATS = {
    "noise": f"""(x <> '' AND ({garbage('x')} OR {matched('x', slides.TICK)} OR ({words('x')} <= 1 AND length(x) <= 4) OR {matched('x', '^' + rules.NUMBER + '[MK%]?$')}
      OR (({NUM} >= 4 OR {DIGITS}::DOUBLE / greatest(length(x), 1) >= 0.45) AND NOT {SENTENCE})))""",
    "cell": f"""(x <> '' AND {words('x')} <= 4 AND length(x) <= 64 AND ({matched(FLAT, slides.CELL_NUMBER)} OR {matched(ASCII_FLAT, f'(?i)^(?:{slides.STATISTICS})$')}
      OR ({matched(ASCII_FLAT, '(?i)' + slides.STATISTICS)} AND {words('x')} <= 3) OR contains(x, '|') OR lower({FLAT}) IN ({STAT_CELLS})))""",
    "numeric": f"({words('x')} >= 10 AND ({NUM} >= 6 OR ({NUM} >= 4 AND {words('x')} <= 28)))",
    "content": f"""(type IN ('text', 'title', 'formula', 'table') AND {FLAT} <> '' AND NOT {matched(FLAT, slides.TICK)} AND NOT {garbage(FLAT)}
      AND ((length({FLAT}) >= 25 AND {matched(FLAT, '[A-Za-z]{3,}')}) OR ({words('x')} >= 3 AND {matched(FLAT, '[A-Za-z]{3,}')}) OR {matched(ASCII_FLAT, slides.CONTENT)}))""",
    "label": f"""({FLAT} <> '' AND {words('x')} <= 4 AND length(x) <= 42 AND NOT {ENDED} AND ({matched(ASCII_FLAT, slides.LEGEND)} OR {matched(ASCII_FLAT, slides.AXIS)}))""",
    "axis": f"(x <> '' AND ({matched('x', slides.TICK)} OR {garbage('x')} OR (greatest(0, r - l) <= 40 AND greatest(0, b - t) <= 14 AND length(x) <= 2 AND NOT {matched('x', '[A-Za-z0-9]')})))",
}


def cleaned_formula(x: str) -> str:
    """Runs of three letters or more set apart are put between marks first, and lose their blanks there."""
    out = collapsed(without(x, T.PLAY, T.NBSP))
    marks = f"regexp_replace({out}, {quoted('(^|[^A-Za-z' + chr(92) * 2 + '])((?:[A-Za-z] ){2,}[A-Za-z])($|[^A-Za-z])')}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    out = f"array_to_string(list_transform(string_split({marks}, chr(1)), lambda p, i: CASE WHEN i = 1 THEN p ELSE replace(split_part(p, chr(2), 1), ' ', '') || split_part(p, chr(2), 2) END), '')"
    for pattern, by in ((r" +([,.;:)\]}])", "$1"), (r"([(\[{]) +", "$1"), (" *_ *", "_"), (r" *\^ *", "^"), (r" *\\ +([A-Za-z]+)", " \\\\$1"), (r"([(\[{]) +", "$1"), (r" +([)\]}])", "$1")):
        out = replaced(out, pattern, by)
    return collapsed(out)


def quality_sql(x: str, full: bool = True, accents: bool = True) -> str:
    b = f"abs({counted(x, '[{]')} - {counted(x, '[}]')})"
    p = f"abs({counted(x, '[(]')} - {counted(x, '[)]')})"
    more = f" OR {matched(x, '[A-Za-z]+' + chr(92) * 2 + 'max', chr(92) * 2 + '[A-Za-z]+' + T.WS + '+[A-Za-z]+')}" if full else ""
    accent = f" OR contains({x}, '\\mathring') OR contains({x}, '\\intercal')" if accents else ""
    long = f" OR (contains({x}, '\\text {{') AND contains({x}, '\\\\') AND length({x}) > 120)" if accents else ""
    return f"""CASE WHEN {x} = '' OR {b} >= 2 OR {p} >= 2 OR {matched(x, r'[=+' + chr(92) + '-' + chr(92) * 2 + r'{(]$', r'^(?:[0-3]' + chr(92) + r')|' + chr(92) * 4 + '|&)')}{long} THEN 'truncated'
 WHEN {matched(x, '(?:[A-Za-z]' + T.WS + '+){3,}[A-Za-z](?:[^A-Za-z]|$)', chr(92) * 4 + T.WS + '+[A-Za-z]')} OR contains({x}, '\\ '){more}{accent} OR {b} = 1 OR {p} = 1 THEN 'noisy' ELSE 'good' END"""


def repaired_sql(x: str) -> str:
    for symbol, command in T.LATEX_SYMBOLS:
        x = f"replace({x}, {quoted(symbol)}, {quoted(command)})"
    for pattern, by in T.LATEX_REPAIRS:
        x = replaced(x, pattern, by)
    return collapsed(x)


def cleaned_code(x: str) -> str:
    for pattern, by in notebook.CLEANING:
        x = collapsed(replaced(x, pattern, by))
    return x


CODE = f"""({matched('c', notebook.PROMPT, *notebook.SHELL, notebook.ERROR_WORD)} OR ({matched('c', *notebook.CODE)} AND (NOT ({words('c')} >= 5 AND {matched('c', notebook.PROSE_START)}
  AND ({matched('c', '[.:?]$', notebook.PROSE_VERB)} OR {words('c')} >= 6)) OR {matched('c', *notebook.STRONG)})))"""
CODE_AXIS = f"""(c <> '' AND (lower(c) IN ({', '.join(map(quoted, notebook.AXIS_WORDS))}) OR {matched('c', '^-+$', '^-' + chr(92) + 's*' + notebook.SIGNED + '$', '^(?:' + notebook.SIGNED + chr(92) + 's*-?' + chr(92) + 's*)+$')}
  OR ({words('c')} <= 5 AND {counted('c', chr(92) + 'p{Nd}')}::DOUBLE / greatest(length(c), 1) > 0.4) OR {matched('c', '(?:' + chr(92) + 'd+' + chr(92) + 's+){4,}')}))"""
CODE_CELL = f"({matched('c', r'^' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?$')} OR {counted('c', '[|]')} >= 2)"
LETTERS, NUMERALS, MARKS = (counted("c", p) for p in (r"\p{L}", r"\p{Nd}", r"[^\p{L}\p{N}\s]"))
FIGURE_NOISE = f"(c = '' OR {CODE_AXIS} OR {CODE_CELL} OR length(c) < 5 OR ({words('c')} <= 3 AND NOT {CODE}) OR ({LETTERS} < 4 AND {NUMERALS} + {MARKS} > {LETTERS}))"
KIND = f"CASE WHEN c = '' THEN 'output' WHEN starts_with(c, '#') THEN 'comment' WHEN {matched('c', *notebook.SHELL, *notebook.CODE)} THEN 'code' ELSE 'output' END"
TIDIED = f"{SLIDES}, tidied AS (SELECT *, coalesce({TIDY}, '') AS c FROM block)"
#: Pairs of a block of ``page`` and a region of its page, with what the boxes say.
PAIRS = """
pair AS (SELECT x.block_id, x.type, g.type AS region, g.block_id AS region_id, (x.r - x.l) * (x.b - x.t) AS area, (g.r - g.l) * (g.b - g.t) AS region_area,
  greatest(0, least(x.r, g.r) - greatest(x.l, g.l)) AS cw, greatest(0, least(x.b, g.b) - greatest(x.t, g.t)) AS ch,
  x.l >= g.l - 2 AND x.t >= g.t - 2 AND x.r <= g.r + 2 AND x.b <= g.b + 2 AS inside,
  (x.l + x.r) / 2 BETWEEN g.l - 2 AND g.r + 2 AND (x.t + x.b) / 2 BETWEEN g.t - 2 AND g.b + 2 AS centred,
  greatest(0, x.t - g.b, g.t - x.b) AS gap, greatest(0, least(x.r, g.r) - greatest(x.l, g.l)) / least(x.r - x.l, g.r - g.l) AS beside,
  NOT (x.r < g.l - 24 OR x.l > g.r + 24 OR x.b < g.t - 24 OR x.t > g.b + 24) AS by_figure,
  NOT (x.r < g.l - 40 OR x.l > g.r + 40 OR x.b < g.t - 120 OR x.t > g.b + 56) AS by_table
  FROM page x JOIN page g ON g.doc_id = x.doc_id AND g.page_no = x.page_no AND g.type IN ('figure', 'table')),
facts AS (SELECT *, cw * ch AS common, cw * ch / area AS ratio, by_figure OR (gap <= 20 AND beside >= 0.35) AS near_figure, by_table OR (gap <= 28 AND beside >= 0.3) AS near_table FROM pair)"""
EMBEDDED = "(common > 0 AND (ratio >= 0.5 OR centred OR common / region_area >= 0.12))"
ISLANDS = """
beside AS (SELECT p.block_id, p.region_id, (x.l + x.r) / 2 AS mid FROM pair p JOIN page x USING (block_id) JOIN page g ON g.block_id = p.region_id
  WHERE p.type = 'text' AND p.region = 'figure' AND x.n_words >= 12 AND region_area / (612 * 792) >= 0.12
  AND (NOT (x.r < g.l - 56 OR x.l > g.r + 56 OR x.b < g.t - 28 OR x.t > g.b + 28) OR (x.t + x.b) / 2 BETWEEN g.t - 18 AND g.b + 18)
  AND (ch / least(x.b - x.t, g.b - g.t) >= 0.55 OR ((x.t + x.b) / 2 BETWEEN g.t - 18 AND g.b + 18 AND p.beside >= 0.2))),
stepped AS (SELECT *, CASE WHEN mid - lag(mid) OVER w > 90 THEN 1 ELSE 0 END AS step, count(*) OVER (PARTITION BY region_id) AS n FROM beside WINDOW w AS (PARTITION BY region_id ORDER BY mid, block_id)),
grouped AS (SELECT *, sum(step) OVER (PARTITION BY region_id ORDER BY mid, block_id) AS island FROM stepped),
sized AS (SELECT *, count(*) OVER (PARTITION BY region_id, island) AS size FROM grouped),
strong AS (SELECT region_id FROM sized WHERE n >= 4 AND size >= 2 GROUP BY region_id HAVING count(DISTINCT island) <= 2),
cluster AS (SELECT DISTINCT block_id FROM sized JOIN strong USING (region_id) WHERE n >= 4 AND size >= 2)"""
PAGE_FACTS = """bool_or(type = 'figure') OVER p AS has_figure, bool_or(type = 'table') OVER p AS has_table, min(CASE WHEN type = 'title' THEN reading_order END) OVER p AS first_title"""
PAGE = f"""{SLIDES}, plain AS (SELECT * EXCLUDE (text, x), CASE WHEN type = 'formula' THEN {cleaned_formula('text')} ELSE {CLEAN_LINE} END AS text FROM block),
page AS (SELECT *, text AS x, {words('text')} AS n_words, {PAGE_FACTS} FROM plain WINDOW p AS (PARTITION BY doc_id, page_no))"""
NUMBERED = "row_number() OVER (PARTITION BY doc_id, page_no ORDER BY reading_order) AS reading_order"
CELLS = "((inside OR ratio >= 0.35) OR (NOT (summary AND NOT numeric) AND ((near_table AND numeric) OR ((cell OR noise) AND (common > 0 OR near_table)))))"


def flagged(of: dict[str, str], also: str = "") -> str:
    return "flag AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in of.items()) + f"{also} FROM page)"


NEIGHBOUR = f"nullif(trim(regexp_replace(regexp_replace(nullif({collapsed(without('replace(text, ' + quoted(T.ZWSP) + ', ' + quoted('') + ')', T.NBSP))}, ''), {quoted('(?i)' + chr(92) + 'b(?:figure|fig)' + chr(92) + '.?' + T.WS + '*[0-9]+' + T.WS + '*[:.]?' + T.WS + '*')}, '', 'g'), {quoted(T.WS + '+([,.;:!?])')}, '\\1', 'g')), '')"
LOW = f"(lower(c) IN ({', '.join(map(quoted, enrich.LOW_SIGNAL))}) OR length(c) <= 3 OR (len(regexp_extract_all(c, '[A-Za-z]+')) <= 2 AND length(c) <= 14))"


def context_sql(order: str, compare: str, joined: str) -> str:
    """The nearest three texts that say something, as long as those before used less than 280 characters."""
    return f"""(SELECT string_agg(c, ' ' ORDER BY reading_order) FROM (SELECT c, reading_order, row_number() OVER o AS k, coalesce(sum(length(c)) OVER (ORDER BY reading_order {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM said s WHERE s.doc_id = f.doc_id AND s.page_no = f.page_no AND s.reading_order {compare} f.reading_order WINDOW o AS (ORDER BY reading_order {order})) WHERE k <= 3 AND used < 280) AS {joined}"""


ORACLE_SQL = {
    "column_islands": f"WITH {PAGE.replace('CASE WHEN type', 'CASE WHEN false AND type')}, {PAIRS}, {ISLANDS} SELECT block_id FROM cluster",
    "figure_size": f"WITH {SLIDES} SELECT block_id, r - l >= 24 AND b - t >= 24 AND (r - l) * (b - t) >= 2000 AS kept FROM block WHERE type = 'figure'",
    "noise_filter": f"WITH {SLIDES} SELECT block_id, {', '.join(f'{v} AS {k}' for k, v in RULES.items())} FROM block",
    "slide_flags": f"WITH {SLIDES} SELECT block_id, {', '.join(f'{v} AS {k}' for k, v in STATS.items())} FROM block",
    "code_flags": f"WITH {TIDIED} SELECT block_id, {CODE} AS code, {cleaned_code('c')} AS cleaned, {KIND} AS kind, {CODE_AXIS} AS axis, {CODE_CELL} AS cell, {FIGURE_NOISE} AS figure_noise FROM tidied",
    "latex_repairs": f"""WITH {SLIDES}, f AS (SELECT block_id, trim(text) AS s, {cleaned_formula('text')} AS cleaned FROM block), g AS (SELECT *, {repaired_sql('cleaned')} AS repaired FROM f)
SELECT block_id, cleaned, repaired, CASE WHEN cleaned <> '' AND (regexp_matches(repaired, '[=<>\\\\^_(){{}}\\[\\]]') OR length(repaired) >= 6) THEN repaired END AS latex,
  {quality_sql('s')} AS full, {quality_sql('s', full=False)} AS short, {quality_sql('s', full=False, accents=False)} AS least FROM g""",
    "text_functions": f"""WITH {SLIDES}, s AS (SELECT *, nullif(lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_')), '') AS slug, {collapsed('text')} AS flat FROM block),
k AS (SELECT *, list_filter(list_transform(string_split(text, ' '), lambda w: trim(w, ' ,.;:()[]{{}}')),
  lambda w: len(list_filter(regexp_extract_all(lower(w), '[a-z][a-z0-9_\\-]*'), lambda v: v NOT IN ({', '.join(map(quoted, T.STOPWORDS))}))) > 0 AND len(regexp_extract_all(lower(w), '[a-z][a-z0-9_\\-]*')) <= 5) AS kept FROM s)
SELECT block_id, {NEIGHBOUR} AS sentence, coalesce(slug, 'document') AS slug, CASE WHEN starts_with(coalesce(slug, 'document'), 'ab') THEN slug ELSE 'ab_' || coalesce(slug, 'document') END AS doc_slug,
  regexp_replace(text, '(?i)^this[-_]*', '') AS title, CASE WHEN length(flat) > 40 THEN flat[1:37] || '...' ELSE flat END AS short, {collapsed("text || ' x'")} AS plain,
  nullif(trim(text), '') AS bare, regexp_replace(regexp_replace(text, '^[ \\n\\t]+', ''), '[ \\n\\t]+$', '') AS unfenced, reading_order AS number,
  array_to_string(list_filter(kept, lambda w, i: len(list_filter(kept[1:i - 1], lambda v: lower(v) = lower(w))) = 0)[1:5], '|') AS keywords FROM k""",
    "profile_notebook": f"""WITH {TIDIED}, page AS (SELECT *, x AS y FROM tidied), {PAIRS}, hit AS (SELECT DISTINCT block_id FROM facts WHERE region = 'figure' AND inside),
f AS (SELECT *, block_id IN (SELECT block_id FROM hit) AS within, type = 'text' AND {CODE} AS code FROM page),
g AS (SELECT *, CASE WHEN code THEN {cleaned_code('c')} WHEN type = 'text' THEN c WHEN type = 'formula' THEN {cleaned_formula('text')} ELSE text END AS out FROM f),
k AS (SELECT * FROM g WHERE CASE WHEN code THEN out <> '' WHEN type = 'text' THEN NOT ((within AND {FIGURE_NOISE}) OR ({CODE_CELL} AND {words('c')} <= 5) OR {CODE_AXIS} OR length(c) < 5) ELSE true END)
SELECT block_id, CASE WHEN code THEN 'code' ELSE type END AS type, out AS text, {NUMBERED}, CASE WHEN type = 'formula' AND out <> '' THEN {quality_sql('out')} END AS formula_quality,
  code AS contains_code, code AND within AS extracted_from_figure FROM k""",
    "profile_papers": f"""WITH {PAGE}, {PAIRS}, {ISLANDS}, {flagged(RULES)},
lost AS (SELECT DISTINCT p.block_id FROM facts p JOIN flag f USING (block_id) WHERE (region = 'figure' AND f.type IN ('text', 'title', 'formula')
    AND (inside OR (f.type = 'text' AND {EMBEDDED}) OR ratio >= 0.5 OR (f.type = 'formula' AND ratio > 0) OR (f.type = 'text' AND (caption OR noise OR label) AND near_figure)))
  OR (region = 'table' AND f.type = 'text' AND x <> '' AND {CELLS}))
SELECT block_id, type, CASE WHEN type <> 'table' THEN text END AS text, {NUMBERED}, CASE WHEN type = 'formula' THEN {quality_sql('text')} END AS formula_quality FROM flag
WHERE (first_title IS NULL OR first_title <= 1 OR reading_order >= first_title) AND block_id NOT IN (SELECT block_id FROM cluster) AND NOT (type = 'text' AND has_figure AND noise)
  AND NOT (has_table AND type = 'text' AND x <> '' AND (((cell OR noise) AND NOT summary) OR (numeric AND NOT starts_with(lower(x), 'table')))) AND block_id NOT IN (SELECT block_id FROM lost)""",
    "profile_statistics": f"""WITH {PAGE}, {PAIRS}, {flagged(STATS, f", {RULES['caption']} AS caption, {RULES['summary']} AS summary")},
lost AS (SELECT DISTINCT p.block_id FROM facts p JOIN flag f USING (block_id) WHERE NOT content AND ((region = 'figure' AND f.type IN ('text', 'title', 'formula')
    AND (inside OR (f.type = 'text' AND {EMBEDDED}) OR ratio >= 0.5 OR (f.type = 'text' AND (caption OR noise OR label) AND near_figure)))
  OR (region = 'table' AND f.type = 'text' AND x <> '' AND {CELLS})))
SELECT block_id, type, text, {NUMBERED}, CASE WHEN type = 'formula' THEN {quality_sql('text', full=False)} END AS formula_quality FROM flag
WHERE NOT (type = 'text' AND x <> '' AND ({garbage('x')} OR (has_figure AND axis) OR (has_figure AND noise AND NOT content)
    OR (has_table AND NOT content AND (((cell OR noise) AND NOT summary) OR (numeric AND NOT starts_with(lower(x), 'table'))))))
  AND NOT (type = 'text' AND coalesce(first_title BETWEEN 2 AND 3 AND reading_order < first_title, false) AND NOT content) AND block_id NOT IN (SELECT block_id FROM lost)""",
    "formula_context": f"""WITH {SLIDES}, said AS (SELECT * FROM (SELECT *, rtrim({CLEAN_LINE}, ' .;:,') AS c FROM block WHERE type IN ('text', 'title')) WHERE c <> '' AND NOT {LOW}),
t AS (SELECT doc_id, page_no, reading_order, {CLEAN_LINE} AS title FROM block WHERE type = 'title')
SELECT block_id, {context_sql('DESC', '<', 'nearby_text_before')}, {context_sql('ASC', '>', 'nearby_text_after')},
  coalesce((SELECT arg_max(title, reading_order) FROM t WHERE t.doc_id = f.doc_id AND t.page_no = f.page_no AND t.reading_order < f.reading_order),
           (SELECT arg_max(title, page_no * 10 + reading_order) FROM t WHERE t.doc_id = f.doc_id AND t.page_no <= f.page_no)) AS section_title
FROM block f WHERE type = 'formula'""",
    "figure_neighbours": f"""WITH {SLIDES}, page AS (SELECT *, {NEIGHBOUR} AS s FROM block), good AS (
  SELECT f.block_id AS figure_id, f.reading_order AS figure_order, x.reading_order, x.s FROM page f JOIN page x ON f.doc_id = x.doc_id AND f.page_no = x.page_no AND f.type = 'figure'
  WHERE x.type IN ('text', 'title', 'formula') AND NOT (x.t <= 792 * 0.08 OR x.b >= 792 * 0.92) AND {counted('x.s', r'[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} >= 4 AND length(x.s) >= 20
  AND NOT coalesce(x.type IN ('text', 'title') AND greatest(0, x.t - f.b, f.t - x.b) <= 40 AND (regexp_matches(x.s, '(?i)^(?:figure|fig)\\b') OR ({counted('x.s', r'[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} <= 24 AND length(x.s) <= 180
    AND (greatest(0, least(x.r, f.r) - greatest(x.l, f.l)) / least(x.r - x.l, f.r - f.l) >= 0.35 OR abs((x.l + x.r) / 2 - (f.l + f.r) / 2) <= 60) AND (x.b <= f.t + 5 OR x.t >= f.b - 5))), false)),
side AS (SELECT figure_id, list(s ORDER BY reading_order) FILTER (reading_order < figure_order) AS p, list(s ORDER BY reading_order) FILTER (reading_order > figure_order) AS n FROM good GROUP BY figure_id)
SELECT b.block_id, nullif(array_to_string(p[greatest(1, len(p) - 2):len(p)], ' '), '') AS nearby_text_before, nullif(array_to_string(n[1:3], ' '), '') AS nearby_text_after
FROM block b LEFT JOIN side ON figure_id = block_id WHERE type = 'figure'""",
}
ORACLE_SQL["profile_deltas"] = f"""WITH kept AS ({ORACLE_SQL['profile_notebook']}), {SLIDES}, a AS (SELECT type, count(*) AS n FROM block GROUP BY type), z AS (SELECT type, count(*) AS n FROM kept GROUP BY type)
SELECT type, coalesce(a.n, 0) AS before, coalesce(z.n, 0) AS after, coalesce(a.n, 0) - coalesce(z.n, 0) AS dropped FROM a FULL JOIN z USING (type)"""
