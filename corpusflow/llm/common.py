"""Shared helpers of the training-data operators.

Conventions
-----------
* A *document* is a row.  Operators read an id column and a text column under
  names that are parameters and ignore every other column, so extra columns with
  any name are harmless.  Repeated rows are separate documents unless an
  operator says otherwise.
* ``null`` text is the empty text; a ``null`` id is kept as it is.
* Tables that a lazy result still reads stay in the shared folder; what is read no more is deleted.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import discard, let_go, shared_folder, stored  # noqa: F401

#: Rows that Python holds as objects at a time.
ROWS_AT_ONCE = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fold_of(doc_id: object, modulus: int) -> int:
    """The same remainder in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def give_back() -> None:
    """Memory that is free goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; workers wait for later tasks and stages, so what a task has freed is given back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def map_rows(
    df: DataFrame,
    start: Callable[[], Callable[..., dict]],
    schema: T.StructType,
    inputs: list[str | tuple[str, str]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Arrow-batched row mapper.

    ``start()`` runs once per task and returns a function from the lists of the
    input columns to a dict of equally long output columns; it gets at most ROWS_AT_ONCE
    rows a call.  ``keep`` columns are passed through untouched, in front of the new ones.
    An input (column, field) is a field of a kept struct, which so isn't sent twice.
    """
    keep = keep or []
    out = T.StructType([df.schema[c] for c in keep] + list(schema.fields))
    arrow = to_arrow_schema(out)

    def place(column: str, field: str) -> int:
        names = df.schema[column].dataType.names
        return names.index(field) if field in names else [n.lower() for n in names].index(field.lower())

    paths = [(c, None) if isinstance(c, str) else (c[0], place(*c)) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                made = kernel(*((batch.column(c) if i is None else batch.column(c).field(i)).to_pylist() for c, i in paths))
                columns = [batch.column(c) for c in keep]
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)]
                columns += [pa.array(made[f.name], type=f.type) for f in list(arrow)[len(keep):]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*dict.fromkeys([*keep, *(c for c, _ in paths)])).mapInArrow(giving_back(run), out)


def fields(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns of ``df`` as one struct, so that no added column can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
