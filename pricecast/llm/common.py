"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricecast.session import checkpoint

__all__ = ["append_columns", "checkpoint", "fresh_name", "map_columns", "table", "without"]

#: Rows handed to a row function at once; bounds the Python lists, not the result.
CHUNK_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in used:
        name = f"{stem}_{uuid.uuid4().hex[:6]}"
    return name


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, CHUNK_ROWS):
        yield batch.slice(at, CHUNK_ROWS)


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: T.StructType) -> DataFrame:
    """Apply ``fn(*column_lists) -> {column: list}`` to bounded chunks of rows; no shuffle.

    ``fn`` may return a different number of rows than it got (none, or several per row).
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, inputs: list[str], fn: Callable[..., list[list]],
                   fields: list[T.StructField], replace: dict[str, str] | None = None) -> DataFrame:
    """``df`` with computed columns added (or, by ``replace`` = {field: column}, put in place).

    ``fn(*input_lists)`` returns one list per field, each as long as its inputs. Rows keep all
    their columns, so no join back to the documents is needed.
    """
    replace = replace or {}
    added = [f for f in fields if f.name not in replace]
    schema = T.StructType(df.schema.fields + added)
    arrow = to_arrow_schema(schema)
    names = df.columns
    at = [names.index(c) for c in inputs]
    spots = {f.name: names.index(replace[f.name]) for f in fields if f.name in replace}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                got = fn(*(part.column(i).to_pylist() for i in at))
                cols = list(part.columns)
                for f, values in zip(fields, got, strict=True):
                    if f.name in spots:
                        i = spots[f.name]
                        cols[i] = pa.array(values, type=arrow.field(i).type)
                    else:
                        cols.append(pa.array(values, type=arrow.field(f.name).type))
                cols = [c if c.type == arrow.field(i).type else c.cast(arrow.field(i).type)
                        for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, schema)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``ids`` (null keys stay), same columns."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).where(F.col("__gone").isNotNull())
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")
