"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each registered query reads the driver tables under ``sf_dir`` (through the
fixture mapping) and runs its operator over the whole tables. Floating
outputs are rounded to 4 dp on both sides so the engines' last-bit
differences do not change value hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_fixed(c, scale: int = 4):
    """``rint(x*10^s) / 10^s`` in IEEE doubles, half to even.

    Written out (instead of ``round``) because Spark rounds through the
    decimal string of a double and DuckDB through binary arithmetic; the
    explicit formula is the same in both engines and stays in doubles, so it
    holds for values of any size.
    """
    m = float(10 ** scale)
    return F.rint(c * m) / m


def finish(df: DataFrame, scale: int = 4) -> DataFrame:
    """Round floating columns to ``scale`` dp; widen ints to BIGINT."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_fixed(F.col(f.name).cast("double"), scale).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
