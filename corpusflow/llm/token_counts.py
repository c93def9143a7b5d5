"""Operator 1: token counts.

Method: pieces are counted once per distinct pre-token, the counts are joined to
each document's pre-token frequencies, and the products are summed; ids of whole
texts are never materialised.

A pre-token is a part that no piece of the vocabulary can cross.  The vocabulary
has no piece with a word-start mark after another character and none with a line
feed, so the encoding of a text is the concatenation of the encodings of its
pre-tokens (``check_vocabulary`` proves both for the given file, else raises).

The dictionary (distinct pre-token -> pieces) belongs to a worker process and is
bounded: it has two generations, and one of over MAX_CACHED entries becomes the
old one, whose entries return as they are met again.  Joining a corpus-wide
dictionary instead would shuffle one row for each document and distinct word,
which is more bytes than the corpus has.  Here nothing is shuffled.

Edge cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import fields, map_rows

MAX_CACHED = 500_000
BLOCK_CHARS = 4_000_000
LINES = 200
MARK = "▁"
UNUSUAL = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")
SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_vocabulary(model) -> None:
    shape = re.compile(f"{MARK}*[^{MARK}\n]*")
    for i in range(model.get_piece_size()):
        if not model.is_byte(i) and not shape.fullmatch(model.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a pre-token boundary")


def pretokens(text: str) -> Counter:
    """How often each pre-token occurs.

    The library turns a space into the word-start mark and adds a mark in front, so
    nearly every pre-token is a word behind one mark (given without it) or a line feed
    with the word behind it.  Texts with runs of spaces or marks of their own are taken
    apart by a pattern, and their pre-tokens keep their marks.
    """
    if not text:
        return Counter()
    if MARK not in text:
        found = Counter(text.replace("\n", " \n").split(" "))
        if "" not in found:
            return found
    return Counter(UNUSUAL.findall(MARK + text.replace(" ", MARK)))


def as_line(pretoken: str) -> str:
    return pretoken[1:] if pretoken[0] == "\n" else pretoken if pretoken[0] == MARK else MARK + pretoken


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_vocabulary(self.model)
        self.feed = self.model.encode("\n")[-1]
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def pieces(self, new: list[str]) -> list[int]:
        """Pieces of each pre-token, encoded as the lines of one short text."""
        ids = np.asarray(self.model.encode("\n" + "\n".join(map(as_line, new)) + "\n"))
        n = np.diff(np.flatnonzero(ids == self.feed)) - 1
        return [int(k) + (p[0] == "\n") for k, p in zip(n, new)]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > MAX_CACHED:
            self.old, self.known = self.known, {}
        known, get, get_old = self.known, self.known.get, self.old.get
        totals, pending = [], []
        for i, text in enumerate(texts):
            total = 0
            for p, times in pretokens(text).items():
                n = get(p)
                if n is None:
                    n = get_old(p)
                    if n is None:
                        pending.append((i, p, times))
                        continue
                    known[p] = n
                total += n * times
            totals.append(total)
        new = list({p for _, p, _ in pending})
        made = {}
        for at in range(0, len(new), LINES):
            made.update(zip(new[at : at + LINES], self.pieces(new[at : at + LINES])))
        known.update((p, n) for p, n in made.items() if len(p) <= 64)
        for i, p, times in pending:
            totals[i] += made[p] * times
        return totals


COUNTERS: dict[str, PieceCounter] = {}


def counter_of(path: str) -> PieceCounter:
    """One for each worker process and model; a process that serves several tasks keeps it."""
    if path not in COUNTERS:
        COUNTERS[path] = PieceCounter(path)
    return COUNTERS[path]


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        block.append(t)
        chars += len(t)
        if chars >= size:
            yield block
            block, chars = [], 0
    yield block


def count_tokens(
    df: DataFrame, model_path: str | None = None, text_col: str = "text", keep: list[str] | None = None, limit: int = 4096
) -> DataFrame:
    """``keep`` columns plus n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for every row."""
    path = model_path or default_model()

    def start():
        counter = counter_of(path)

        def kernel(texts):
            texts = [t or "" for t in texts]
            n = [x for block in blocks(texts) for x in counter.counts(block)]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return kernel

    return map_rows(df, start, fields(SCHEMA), [text_col], keep if keep is not None else ["doc_id"])
