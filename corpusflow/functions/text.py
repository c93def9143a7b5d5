"""Text functions on columns.

White space is what Python's ``\\s`` means, spelled out, because the engines differ on it.
All functions return null for null unless they say otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space class, the same in Java and RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
#: The same classes for Java, which tries the parts of a class one by one: most characters are told by the first.
BLANK = r"[\x00-\x20\x7f-\x{10ffff}&&" + WS + "]"
SOLID = "[!-~" + NOT_WS + "]"
#: Runs of white space that are more than one blank.
UNEVEN = f"{BLANK}(?:{BLANK}++|(?<! ))"
NBSP, ZWSP, PLAY = " ", "​", "▶"
#: Joins single letters set apart, as in "L e a k y".
SPACED_LETTERS = r"(?:(?<![A-Za-z\\])(?=(?:[A-Za-z] ){2,}[A-Za-z](?![A-Za-z]))|(?!^)\G)([A-Za-z]) (?=[A-Za-z](?![A-Za-z]))"

#: Symbols and what LaTeX writes for them, in the order of replacement.
LATEX_SYMBOLS = (
    ("⊺", r"^\top"), ("×", r" \times "), ("·", r" \cdot "), ("∑", r"\sum "), ("∏", r"\prod "), ("√", r"\sqrt "), ("∈", r" \in "),
    ("∼", r" \sim "), ("∞", r"\infty"), ("α", r"\alpha"), ("β", r"\beta"), ("γ", r"\gamma"), ("δ", r"\delta"), ("θ", r"\theta"),
    ("λ", r"\lambda"), ("μ", r"\mu"), ("σ", r"\sigma"), ("π", r"\pi"), ("ℓ", r"\ell"), ("...", r" \ldots "),
)
#: Patterns and replacements (Java) that follow, in this order.
LATEX_REPAIRS = (
    (WS + "+/+" + WS + "*", " / "),
    (WS + r"*\|" + WS + "*", " | "),
    ("([A-Za-z])" + WS + r"+\(", "$1("),
    (r"\(" + WS + "+", "("),
    (WS + r"+\)", ")"),
    (WS + r"+([=+\-<>])" + WS + "+", " $1 "),
    (WS + "*," + WS + "*", ", "),
    (WS + "*;" + WS + "*", "; "),
    (r"([A-Za-z\\]+)" + WS + r"+\^\\top", r"$1^\\top"),
    (r"\\(sum|prod)" + WS + "+([A-Za-z])" + WS + "*=" + WS + "*([0-9A-Za-z]+)", r"\\$1_{$2=$3}"),
    ("([A-Za-z])" + WS + r"+\((i|j|k|n|N|[0-9]+)\)", "$1^{($2)}"),
    (r"\(" + WS + "*1 -" + WS + "*", "(1 - "),
)
#: Signs that make a formula of even a short text.
STRUCTURE = r"[=<>\\^_(){}\[\]]"
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "with")


def let(value: Column, body) -> Column:
    """``body(value)``, evaluating ``value`` once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def first_spellings(phrases: Column) -> Column:
    """Strings of an array that no earlier one equals but for case."""
    return let(phrases, lambda k: let(F.transform(k, F.lower), lambda low: F.filter(k, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, UNEVEN, " "))


def clean_text(c: Column, *, drop: str = "", blank: str = NBSP) -> Column:
    """Collapsed text, null if nothing is left.  Characters of ``drop`` go, those of ``blank`` become blanks."""
    for ch in drop:
        c = F.replace(c, F.lit(ch), F.lit(""))
    for ch in blank:
        c = F.replace(c, F.lit(ch), F.lit(" "))
    return empty_to_null(collapse(c))


def clean_line(c: Column) -> Column:
    """Collapsed text; null becomes the empty text."""
    return F.coalesce(collapse(F.replace(F.replace(c, F.lit(PLAY), F.lit(" ")), F.lit(NBSP), F.lit(" "))), F.lit(""))


def normalize_sentence(c: Column, *, figure_prefix: bool = False) -> Column:
    """Clean text without blanks in front of punctuation; optionally without "Figure N:" marks."""
    out = clean_text(c, drop=ZWSP)
    if figure_prefix:
        out = F.regexp_replace(out, r"(?i)\b(?:figure|fig)\.?" + WS + r"*\d+" + WS + "*[:.]?" + WS + "*", "")
    return empty_to_null(F.trim(F.regexp_replace(out, WS + r"+([,.;:!?])", "$1")))


def strip_control(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def strip_control_nested(c: Column, of: T.DataType) -> Column:
    """``strip_control`` of every string in a value of type ``of``; nulls stay."""
    if isinstance(of, T.StringType):
        return strip_control(c)
    if isinstance(of, T.ArrayType):
        return F.transform(c, lambda x: strip_control_nested(x, of.elementType))
    if isinstance(of, T.MapType):
        return F.transform_values(c, lambda k, v: strip_control_nested(v, of.valueType))
    if isinstance(of, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[strip_control_nested(c[f.name], f.dataType).alias(f.name) for f in of.fields]))
    return c


def decode_unicode_escapes(c: Column) -> Column:
    """Escapes of a text with a backslash and u decoded as Python does, which reads its other bytes as Latin-1; as it was where that fails.

    No built-in function knows these escapes, so this is Arrow-batched Python: use it on texts of models, not on a corpus."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or "\\u" not in t:
                return t
            try:
                return t.encode("utf-8").decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            except UnicodeDecodeError:
                return t

        return texts.map(one)

    return decode(c)


def document_id(stem: Column, course: Column) -> Column:
    """Slug of a file name, behind the course unless it begins with it."""
    slug = slugify(stem)
    return F.when(F.startswith(slug, course), slug).otherwise(F.concat_ws("_", course, slug))


def document_title(stem: Column, course: str) -> Column:
    """File name without the course in front, whatever its case."""
    return F.regexp_replace(stem, rf"(?i)^{course}[-_]*", "")


def slugify(c: Column, default: str = "document") -> Column:
    return F.coalesce(empty_to_null(F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")))), F.lit(default))


def token_count(c: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(SOLID + "+")), F.lit(0))


def has_more_tokens(c: Column, most: int) -> Column:
    """Whether there are more than ``most`` runs without white space; reads no further than needed."""
    return F.coalesce(c.rlike(f"^{BLANK}*+(?:{SOLID}++{BLANK}++){{{most}}}{SOLID}"), F.lit(False))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def compact(c: Column, limit: int = 260) -> Column:
    flat = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def section_key(c: Column) -> Column:
    return empty_to_null(F.trim(F.regexp_replace(F.lower(clean_text(c)), "[^a-z0-9]+", " ")))


def join_parts(*parts: Column) -> Column:
    """Clean parts joined by ". "; null if none is left.  Array parts are flattened."""
    cleaned = [F.transform(p, lambda x: clean_text(x)) for p in parts]
    kept = F.filter(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in cleaned])), lambda x: x.isNotNull())
    return empty_to_null(F.array_join(kept, ". "))


def span_phrases(spans: Column) -> Column:
    """"name normalized" of each math span, or what there is of both."""
    phrase = lambda s: empty_to_null(F.trim(F.concat_ws(" ", clean_text(s["math_name"]), clean_text(s["normalized"]))))
    return F.filter(F.transform(spans, phrase), lambda x: x.isNotNull())


def block_number(block_id: Column) -> Column:
    """Number at the end of a block id, 10**9 without one."""
    return F.coalesce(empty_to_null(F.regexp_extract(block_id, r"_b(\d+)$", 1)).try_cast("int"), F.lit(1_000_000_000))


def clean_formula(c: Column) -> Column:
    """Spaced letters joined and blanks around brackets, scripts and commands removed."""
    out = collapse(F.replace(F.replace(c, F.lit(PLAY), F.lit(" ")), F.lit(NBSP), F.lit(" ")))
    steps = (
        (SPACED_LETTERS, "$1"),
        (r" +([,.;:)\]}])", "$1"),
        (r"([(\[{]) +", "$1"),
        (r" *_ *", "_"),
        (r" *\^ *", "^"),
        (r" *\\ +([A-Za-z]+)", r" \\$1"),
        (r"([(\[{]) +", "$1"),
        (r" +([)\]}])", "$1"),
    )
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return collapse(out)


def repair_latex(c: Column) -> Column:
    """A clean formula with symbols as commands, even blanks around operators, and limits and indices in braces."""
    out = clean_formula(c)
    for symbol, command in LATEX_SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(command))
    for pattern, by in LATEX_REPAIRS:
        out = F.regexp_replace(out, pattern, by)
    return collapse(out)


def latex_of_formula(c: Column) -> Column:
    """Repaired formula; null for empty ones and for fewer than six characters without any structure."""
    out = repair_latex(c)
    return F.when((clean_formula(c) != "") & (out.rlike(STRUCTURE) | (F.length(out) >= 6)), out)


def normalized_keyword(c: Column) -> Column:
    """Keyword without punctuation at its ends; null without a word, with over five, or of stop words alone."""
    phrase = F.trim(clean_text(c), F.lit(" ,.;:()[]{}"))
    words = F.regexp_extract_all(F.lower(phrase), F.lit(r"[A-Za-z][A-Za-z0-9_\-]*"), 0)
    telling = F.exists(words, lambda w: ~w.isin(*STOPWORDS))
    return F.when(telling & (F.size(words) <= 5), phrase)


def sanitized_keywords(c: Column, most: int = 10) -> Column:
    """Normalised keywords, the first spelling of each, at most ``most``."""
    kept = F.filter(F.transform(c, normalized_keyword), lambda k: k.isNotNull())
    return F.slice(first_spellings(kept), 1, most)


def strip_latex(c: Column) -> Column:
    """Without the first wrapper that fits: $$, $, \\[ \\] or \\( \\)."""
    t = F.trim(c)
    inner = lambda n: F.trim(F.substring(t, F.lit(n + 1), F.length(t) - 2 * n))
    case = None
    for left, right in (("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")):
        test = F.startswith(t, F.lit(left)) & F.endswith(t, F.lit(right)) & (F.length(t) >= len(left) + len(right))
        case = F.when(test, inner(len(left))) if case is None else case.when(test, inner(len(left)))
    return empty_to_null(case.otherwise(t))


def strip_code_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def parse_model_json(c: Column, schema: str) -> Column:
    """JSON of a model's answer; a second try doubles backslashes that JSON does not know.  Null if it is no object."""
    bare = strip_code_fence(c)
    mended = F.regexp_replace(bare, r"""(?<!\\)\\(?!["\\/bfnrtu])""", r"\\\\")
    read = lambda t: F.when(F.startswith(F.trim(t), F.lit("{")), F.from_json(t, schema, {"mode": "PERMISSIVE"}))
    ok = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(ok(bare), read(bare)).when(ok(mended), read(mended))


def formula_quality(c: Column, *, max_rule: bool = True, command_rule: bool = True, text_rule: bool = True, accent_rule: bool = True) -> Column:
    """good, noisy or truncated; the last also for null.  The rules in front win.

    Three sets are in use: all rules; without ``max_rule`` and ``command_rule``; without any of the four."""
    t = F.trim(F.coalesce(c, F.lit("")))
    count = lambda ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
    braces, parens = F.abs(count("{") - count("}")), F.abs(count("(") - count(")"))
    out = (
        F.when(t == "", "truncated")
        .when((braces >= 2) | (parens >= 2), "truncated")
        .when(t.rlike(r"[=+\-\\{(]$"), "truncated")
        .when(t.rlike(r"^(?:[0-3]\)|\\\\|&)"), "truncated")
        .when(F.lit(text_rule) & F.contains(t, F.lit("\\text {")) & F.contains(t, F.lit("\\\\")) & (F.length(t) > 120), "truncated")
        .when(t.rlike(r"(?:[A-Za-z]" + WS + r"+){3,}[A-Za-z](?![A-Za-z])"), "noisy")
        .when(F.contains(t, F.lit("\\ ")) | t.rlike(r"\\\\" + WS + "+[A-Za-z]"), "noisy")
    )
    if max_rule:
        out = out.when(t.rlike(r"[A-Za-z]+\\max"), "noisy")
    if command_rule:
        out = out.when(t.rlike(r"\\[A-Za-z]+" + WS + "+[A-Za-z]+"), "noisy")
    return (
        out.when(F.lit(accent_rule) & (F.contains(t, F.lit("\\mathring")) | F.contains(t, F.lit("\\intercal"))), "noisy")
        .when((braces == 1) | (parens == 1), "noisy")
        .otherwise("good")
    )
