"""Helpers of the text operators: Arrow batches in, Arrow batches out, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows whose Python strings are alive at once inside a task.
SLICE_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str | None]:
    """The column's texts; bytes that are not UTF-8 come as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def text_map(
    docs: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    new: T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (None: all) and the ``new`` columns that ``make()`` computes from the texts.

    ``make`` is called once in each task and returns a function from a list of texts to a
    dict of equally long lists. A kept column whose name clashes with a new one gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    source = docs.select(*names, docs[text_col].alias("__text"))
    schema = T.StructType([source.schema[c] for c in names] + list(new.fields))

    def run(batches):
        out = to_arrow_schema(schema)
        fn = None
        for part in slices(batches):
            fn = fn or make()
            values = fn(strings(part.column("__text")))
            columns = [part.column(c).cast(out.field(c).type) for c in names]
            columns += [pa.array(values[f.name], out.field(f.name).type) for f in new.fields]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return source.mapInArrow(run, schema)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())
