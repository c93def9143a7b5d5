"""Models outside the engine: embedders and language models behind one interface, with offline defaults.

A factory runs once for each task on the executor; what it returns is asked in batches.  A factory that
can't make its client raises at once (``require``), so a job without a key fails before any work."""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 128
DIMENSIONS = 64
WORDS_KEPT = 100_000
#: Texts to as many vectors.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Prompts to as many answers, None where there is none.
Answerer = Callable[[Sequence[str]], Sequence[str | None]]


def require(library: str, key: str) -> None:
    if importlib.util.find_spec(library) is None:
        raise RuntimeError(f"{library} is not installed")
    if not os.environ.get(key):
        raise RuntimeError(f"{key} is not set")


def hash_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Signed counts of hashed words, of length 1: texts that share words are similar.  The same on every machine."""

    places: dict[str, int] = {}  # of words, with their signs; begun anew when full

    def place(word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        at = places[word] = (h >> 1) % dimensions + (0 if h & 1 else dimensions)
        return at

    def one(text: str) -> list[float]:
        if len(places) > WORDS_KEPT:
            places.clear()
        at = [places[w] if w in places else place(w) for w in text.lower().split()]
        n = np.bincount(np.array(at, np.int64), minlength=2 * dimensions)
        out = (n[:dimensions] - n[dimensions:]).astype(np.float64)
        if not out.any():
            out[0] = 1.0
        return (out / np.sqrt(out @ out)).tolist()

    return lambda texts: [one(t) for t in texts]


def no_answers() -> Answerer:
    """The offline model: it never answers, so every caller's fallback applies."""
    return lambda prompts: [None] * len(prompts)


def retried(ask: Callable[[str], str | None], attempts: int = 1, strict: bool = False) -> Answerer:
    """Each prompt up to ``attempts`` times; what still fails is None or, if ``strict``, an error."""

    def one(prompt: str) -> str | None:
        error: Exception | None = None
        for _ in range(attempts):
            try:
                if answer := ask(prompt):
                    return answer
                error = ValueError("empty answer")
                break
            except Exception as e:  # whatever a client raises
                error = e
        if strict:
            raise RuntimeError(f"no answer after {attempts} attempts") from error
        return None

    return lambda prompts: [one(p) for p in prompts]


class Once:
    """A model that is built on first use and kept, as is the error if it can't be built."""

    def __init__(self, build: Callable[[], object]):
        self.build = build
        self.made: object | None = None
        self.error: str | None = None

    def get(self) -> tuple[object | None, str | None]:
        if self.made is None and self.error is None:
            try:
                self.made = self.build()
            except Exception as e:  # whatever a model raises
                self.error = f"{type(e).__name__}: {e}"
        return self.made, self.error


def _mapped(df: DataFrame, text_col: str, out_col: str, kind: str, factory: Callable[[], Callable], batch: int) -> DataFrame:
    inputs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    made_type = pa.list_(pa.float64()) if kind == "array<double>" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = factory()
        for rows in batches:
            texts = ["" if t is None else t for t in rows.column(1).to_pylist()]
            made: list = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                answers = list(ask(part))
                if len(answers) != len(part):
                    raise RuntimeError("a provider must give one answer for each input")
                made += answers
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, made_type)], names=["_row", "_made"])

    out = T.StructType([inputs.schema["_row"], T.StructField("_made", T._parse_datatype_string(kind))])
    made = inputs.mapInArrow(run, out)
    return made.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != out_col], F.col("_made").alias(out_col))


def embedded(df: DataFrame, text_col: str, factory: Callable[[], Embedder] = hash_embedder, batch: int = BATCH, out_col: str = "values") -> DataFrame:
    """``df`` with a vector of each text; ``batch`` texts a request, answers by place."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    return _mapped(df, text_col, out_col, "array<double>", factory, batch)


def answered(df: DataFrame, prompt_col: str, factory: Callable[[], Answerer] = no_answers, batch: int = 1, out_col: str = "answer") -> DataFrame:
    return _mapped(df, prompt_col, out_col, "string", factory, batch)


def vector_rows(chunks: DataFrame, factory: Callable[[], Embedder] = hash_embedder, batch: int = BATCH) -> DataFrame:
    """id, values, metadata and document of each chunk."""
    made = embedded(chunks, "content_for_embedding", factory, batch)
    extra = [F.col("chunk_type").alias("chunk_type"), F.col("indexable").alias("indexable")] if "indexable" in chunks.columns else []
    fields = [f for f in chunks.schema["metadata"].dataType.names if f not in ("chunk_type", "indexable")]
    return made.select(
        F.col("chunk_id").alias("id"), "values", F.struct(*[F.col(f"metadata.{f}") for f in fields], *extra).alias("metadata"),
        F.struct(F.col("content_for_embedding").alias("text"), *[F.col(c) for c in ("chunk_type", "content_for_generation", "raw_fields") if c in chunks.columns]).alias("document"),
    )
