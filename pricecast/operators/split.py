"""Time splits, seeded sampling, first/last row picks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricecast.operators.join import attach_one_row
from pricecast.operators.order import with_positions

DATE = "arrival_date"


def time_split(df: DataFrame, order: list[str], fracs: tuple[float, ...] = (0.70, 0.15),
               labels: tuple[str, ...] = ("train", "val", "test"),
               split_col: str = "split") -> DataFrame:
    """Positional split by global order; ``order`` is a total order led by a date.

    The first int(n*f1) rows get the first label, up to int(n*(f1+f2)) the
    second, the rest the last; a boundary day can fall in two splits. No row
    of the table is moved for it: rows are counted per date, a running sum
    over the dates (a calendar, not the data) finds the date on which each cut
    falls, only that date's order columns are ranked, and every row is then
    compared with the cut's order values, which are literals.
    """
    day = order[0]
    rows = df.where(F.col(day).isNotNull())
    per_day = rows.groupBy(day).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy(day))
    n = F.sum("_c").over(Window.partitionBy(F.lit(0)))
    days = per_day.withColumn("_end", upto).withColumn("_n", n).withColumn("_beg", F.col("_end") - F.col("_c"))
    shares = [sum(fracs[:k + 1]) for k in range(len(fracs))]
    rank = [F.floor(F.col("_n") * F.lit(s)) for s in shares]
    falls = [(F.col("_beg") <= r) & (r < F.col("_end")) for r in rank]
    found = days.where(reduce(or_, falls)).select(
        day, *[F.when(f, r - F.col("_beg")).alias(f"_r{k}") for k, (f, r) in enumerate(zip(falls, rank))]).collect()
    cuts: list[Column | None] = [None] * len(shares)
    for row in found:    # at most one date per cut
        wanted = {k: row[f"_r{k}"] for k in range(len(shares)) if row[f"_r{k}"] is not None}
        placed = with_positions(rows.where(F.col(day) == F.lit(row[day])).select(*order), [], order)
        for hit in placed.where(F.col("_pos").isin(*wanted.values())).collect():
            at = F.struct(*[F.lit(hit[c]).cast(df.schema[c].dataType).alias(c) for c in order])
            for k, pos in wanted.items():
                if pos == hit["_pos"]:
                    cuts[k] = at
    here = F.struct(*[F.col(c) for c in order])
    lab = F.lit(labels[-1])
    for cut, name in reversed(list(zip(cuts, labels))):
        # a cut past the last row leaves nothing to the later labels
        lab = F.lit(name) if cut is None else F.when(here < cut, F.lit(name)).otherwise(lab)
    return rows.withColumn(split_col, lab)


def time_split_by_date(df: DataFrame, date_col: str = DATE, fracs=(0.70, 0.15),
                       split_col: str = "split") -> DataFrame:
    """Cut at distinct-date indexes int(n*.70), int(n*.85).

    Distinct dates are ranked with the distributed position helper (no
    single-partition window); the two cut dates form a one-row table.
    """
    dates = df.select(date_col).where(F.col(date_col).isNotNull()).distinct()
    ranked = with_positions(dates, [], [date_col]).withColumnsRenamed({"_pos": "_i",
                                                                       "_n": "_nd"})
    f1, f2 = fracs[0], fracs[0] + fracs[1]
    cuts = ranked.agg(
        F.max(F.when(F.col("_i") == F.floor(F.col("_nd") * F.lit(f1)), F.col(date_col))).alias("_train_end"),
        F.max(F.when(F.col("_i") == F.floor(F.col("_nd") * F.lit(f2)), F.col(date_col))).alias("_val_end"))
    j = attach_one_row(df.where(F.col(date_col).isNotNull()), cuts)
    lab = (F.when(F.col(date_col) <= F.col("_train_end"), "train")
            .when(F.col(date_col) <= F.col("_val_end"), "val").otherwise("test"))
    return j.withColumn(split_col, lab).drop("_train_end", "_val_end")


def union_splits(*dfs: DataFrame) -> DataFrame:
    """Concatenate frames by column name, tolerating missing columns."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def sample_n(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """Repeatable sample of at most ``n`` rows: the ``n`` smallest seeded
    hashes of the row key (a top-n, so each task keeps at most ``n`` rows)."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


def pick_test_row(df: DataFrame, key: list[str], split_col: str = "split",
                  position_col: str | None = None, test_label: str = "TEST") -> DataFrame:
    """Per ``key`` the row labelled TEST, else the last row."""
    is_test = (F.upper(F.coalesce(F.col(split_col).cast("string"), F.lit(""))) == test_label)\
        if split_col in df.columns else F.lit(False)
    pos = F.col(position_col) if position_col else F.monotonically_increasing_id()
    ranked = df.withColumn("_ord", F.struct(is_test.alias("t"), pos.alias("p")))
    return (ranked.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]),
                                              F.col("_ord")).alias("_r"))
                  .select(*key, "_r.*"))
