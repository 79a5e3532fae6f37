"""Shared plumbing: Arrow row mapping, tables, column names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phylospan.shipping import ship
from phylospan.storage import dropped, new_path, shared_dir, written

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


__all__ = ["Remembered", "dropped", "each_group", "each_row", "fresh", "new_path", "quoted", "shared_dir", "spans", "table", "text_sizes", "with_computed", "written"]

Rows = Callable[..., tuple]


class _Each:
    """Maps slices of Arrow batches through ``setup()``'s function of one argument per input column."""

    def __init__(self, setup: Callable[[], Rows], schema: pa.Schema, rows: int, many: bool):
        self.setup, self.schema, self.rows, self.many = setup, schema, rows, many

    def __call__(self, batches):
        fn = self.setup()
        for batch in batches:
            for lo in range(0, batch.num_rows, self.rows):
                part = batch.slice(lo, self.rows)
                got = map(fn, *(part.column(i).to_pylist() for i in range(part.num_columns)))
                out = [y for x in got for y in x] if self.many else list(got)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), self.schema.types)], schema=self.schema)


def each_row(df: DataFrame, setup: Callable[[], Rows], schema: str, rows: int = 256, many: bool = False) -> DataFrame:
    """``df`` mapped row by row in Arrow batches, with no shuffle.

    ``setup()`` runs once per task and returns a function of the row's values, giving the tuple of an
    output row (with ``many`` an iterable of them).  At most ``rows`` rows are Python objects at a time.
    """
    ship(df.sparkSession)
    spark_schema = T._parse_datatype_string(schema)
    return df.mapInArrow(_Each(setup, to_arrow_schema(spark_schema), rows, many), spark_schema)


class _Groups:
    """Maps rows of Arrow batches in groups of like size through a function of one list per input column."""

    def __init__(self, fn: Callable[..., list[tuple]], schema: pa.Schema, column: int, size: Callable[[pa.Array], np.ndarray], most: int):
        self.fn, self.schema, self.column, self.size, self.most = fn, schema, column, size, most

    def __call__(self, batches):
        for batch in batches:
            size = self.size(batch.column(self.column))
            order = np.argsort(-size, kind="stable")
            for lo, hi in spans(size[order] + ROW, self.most):
                part = batch.take(pa.array(order[lo:hi]))
                out = self.fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), self.schema.types)], schema=self.schema)


#: Bytes that a row of a group counts for beside its size.
ROW = 1024


def spans(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where to cut what has these sizes into parts of at most ``most``, or of one item."""
    end, out, lo = np.cumsum(size), [], 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, most + (end[lo - 1] if lo else 0), "right")))
        out.append((lo, hi))
        lo = hi
    return out


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, none for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def each_group(df: DataFrame, fn: Callable[..., list[tuple]], schema: str, column: int, size: Callable[[pa.Array], np.ndarray], most: int) -> DataFrame:
    """``df`` mapped in groups of rows of like ``size``, a function of a column's values, with no shuffle.

    ``fn`` has a list of values per column and gives a tuple per row.  A group is of one row, or the sizes of its rows,
    with ``ROW`` more for each, come to at most ``most``.
    """
    ship(df.sparkSession)
    spark_schema = T._parse_datatype_string(schema)
    return df.mapInArrow(_Groups(fn, to_arrow_schema(spark_schema), column, size, most), spark_schema)


class _Extended:
    """Passes whole batches through with further columns, or only the rows that a column marks."""

    def __init__(self, setup, index, types, names, rows):
        self.setup, self.index, self.types, self.names, self.rows = setup, index, types, names, rows

    def __call__(self, batches):
        fn = self.setup()
        for batch in batches:
            for lo in range(0, batch.num_rows, self.rows):
                part = batch.slice(lo, self.rows)
                got = list(map(fn, *(part.column(i).to_pylist() for i in self.index)))
                new = [pa.array(c, t) for c, t in zip(zip(*got), self.types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *self.names])


def with_computed(df: DataFrame, cols: list[str], setup: Callable[[], Rows], schema: str, rows: int = 256) -> DataFrame:
    """``df`` with the columns of ``schema`` added, computed from ``cols``; rows and other columns stay as they are."""
    ship(df.sparkSession)
    new = T._parse_datatype_string(schema)
    index = [df.columns.index(c) for c in cols]
    arrow = to_arrow_schema(new)
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*df.schema.fields, *new.fields]])
    return df.mapInArrow(_Extended(setup, index, arrow.types, arrow.names, rows), out)


class Remembered(dict):
    """``make(key)`` remembered in two generations of at most ``bound`` entries; keys in use outlive the rest."""

    def __init__(self, make: Callable, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
