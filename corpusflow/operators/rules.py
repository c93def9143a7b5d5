"""Rules on the text of a block, as boolean columns; null and empty texts match none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS, collapse, token_count

# Fixed values.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
SLASHED = rf"{NUMBER}(?:/{NUMBER}){{1,3}}"
#: Numbers that are noise on their own, and numbers that fill a cell.
NOISE_NUMBERS = (rf"^{NUMBER}[MK%]?$", r"^[0-9]+(?:,[0-9]{3})+(?:\.[0-9]+)?[MK%]?$", rf"^{SLASHED}$")
CELL_NUMBERS = (rf"^{NUMBER}[MK%]?$", rf"^{SLASHED}$", r"^[0-9]+(?:,[0-9]{3})+(?:\.[0-9]+)?[MK]?$")
SCORING = rf"(?i)^(?:Full|Partial){WS}+Scoring:{WS}*P{WS}*\("
METRIC_NAME = r"\b(?:BLEU|F1|Acc|Accuracy|SST-2|MRPC|MNLI|QQP|STS-B|SQuAD|SuperGLUE)\b"
METRIC_CELL = (
    r"(?i)^(?:Acc\.?\s*\(%\)|Accuracy|BLEU|ROUGE(?:-\d)?|R1/R2/RL|F1|EM|PPL|MNLI(?:-m|-mm)?|"
    r"MRPC|SST-2|QQP|QNLI|RTE|STS-B|WiC|BoolQ|WSC|COPA|MultiRC|ReCoRD|"
    r"SQuAD(?:\s*v?\d\.\d)?|WikiSQL|SAMSum)$"
)
MODEL_CELL = r"(?i)^(?:GPT-?\d(?:\s*\([^)]*\))?|BERT(?:-base|-large)?|RoBERTa(?:-base|-large)?|LoRA|Adapter['\"]?|BitFit|PreEmbed|PreLayer|FT)$"
HEADER_CELL = r"^[A-Za-z][A-Za-z0-9._/%()-]*$"
HEADER_WORDS = ("parameter", "parameters", "num trainable parameters / task")
OCR_MARKS = "[÷‹›•·₫∆≈]"
DIMENSIONS = r"(?i)\b[0-9]+\s*[x×]\s*[0-9]+(?:\s*[x×]\s*[0-9]+)?\b"
QUESTION_START = r"(?i)^(?:who|what|when|where|why|how|which|state|name)\b"
OUTPUT_WORDS = r"(?i)\b(?:zero shot|one-shot|few-shot|json output|maximize|output)\b"
LEGEND_WORDS = r"(?i)\b(?:example|context|completion|parameters in lm|small model completion|gpt-2 completion)\b"
DEMO_WORDS = r"(?i)\b(?:hugging face|billing|account access|website|mobile|winograd)\b"


def bare(text: Column) -> Column:
    """Without white space at the ends; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WS}+|{WS}+$", "")


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_caption(text: Column) -> Column:
    t = bare(text)
    return t.rlike(r"(?i)^(?:figure|fig|table)\b") | t.rlike(r"(?i)\b(?:figure|fig|table)" + WS + r"+[A-Za-z]?[0-9]")


def is_noisy(text: Column) -> Column:
    """Numbers, metrics, scan marks, dimensions or foreign characters as in the cells of a table or a plot."""
    t = bare(text)
    n = count(t, NUMBER)
    return (t != "") & (
        (F.contains(t, F.lit("|")) & (n >= 2))
        | (n >= 6)
        | (t.rlike(METRIC_NAME) & (n >= 2))
        | t.rlike(OCR_MARKS)
        | (t.rlike(DIMENSIONS) & (count(t, r"\b[\p{L}\p{N}_]{1,3}\b") >= 2))
        | (t.rlike(r"[^\x00-\x7F]") & (n >= 1))
    )


def is_table_summary(text: Column) -> Column:
    t = bare(text)
    return (t != "") & (t.rlike(r"(?i)^table\b") | (F.length(t) >= 70) | (token_count(t) >= 12))


def is_numeric_sentence(text: Column) -> Column:
    t = bare(text)
    n, words = count(t, NUMBER), token_count(t)
    return (words >= 10) & ((n >= 6) | (count(t, SLASHED) >= 2) | ((n >= 4) & (words <= 28)))


def is_table_fragment(text: Column) -> Column:
    """A cell: a number, a metric, a model or a header."""
    t = bare(text)
    flat = collapse(t)
    return (t != "") & (token_count(t) <= 4) & (F.length(t) <= 64) & (
        matches_any(flat, CELL_NUMBERS) | flat.rlike(METRIC_CELL) | flat.rlike(MODEL_CELL)
        | F.contains(flat, F.lit("|")) | F.lower(flat).isin(*HEADER_WORDS) | flat.rlike(HEADER_CELL)
    )


def is_obvious_noise(text: Column) -> Column:
    """The first rule that applies decides."""
    t = bare(text)
    words, chars = token_count(t), F.length(t)
    dense = (count(t, NUMBER) >= 3) | (digit_count(t) / F.greatest(chars, F.lit(1)) >= 0.35)
    sentence = (words >= 5) & t.rlike("[a-z]{3,}")
    return (
        F.when(t == "", False).when(words <= 2, True).when(chars <= 12, True).when(t.rlike(SCORING), False).when(matches_any(t, NOISE_NUMBERS), True)
        .when(dense & ~sentence, True).when(is_noisy(t), True).when(is_table_fragment(t) & ~sentence, True).otherwise(False)
    )


def is_figure_fragment(text: Column) -> Column:
    """Labels, questions, outputs, legends and demo texts that belong to a figure nearby."""
    t = collapse(bare(text))
    words, low = token_count(t), F.lower(t)
    ended = t.rlike("[.?!]$")
    sentence = (words >= 6) | ended | F.contains(t, F.lit(";")) | (F.contains(t, F.lit(":")) & (words >= 5))
    label = (words <= 4) & (F.length(bare(text)) <= 42) & ~ended
    question = (t.rlike(QUESTION_START) | F.contains(low, F.lit("question answering")) | F.startswith(low, F.lit("allow "))) & (words <= 10)
    output = (t.rlike(OUTPUT_WORDS) | F.startswith(t, F.lit("<>"))) & ~sentence
    legend = (t.rlike(LEGEND_WORDS) | F.contains(t, F.lit("|"))) & (words <= 8)
    demo = t.rlike(DEMO_WORDS) & (words <= 8)
    return (t != "") & ~t.rlike(SCORING) & (label | question | output | legend | demo)
