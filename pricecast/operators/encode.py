"""Category indexes, one-hot by column name, standard scaler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast.functions.keys import norm_key, norm_names
from pricecast.operators.join import attach_one_row
from pricecast.operators.order import with_positions
from pricecast.session import checkpoint

# Fixed value: the string a null category becomes (pandas ``astype(str)``).
NULL_CATEGORY = "nan"


def _as_category(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY))


def fit_category_index(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mapping table (column, value, idx): sorted distinct values -> 0..n-1.

    Fitted on the frame given (train only). Ranks come from the distributed
    position helper, so a huge category set is never sorted in one task. The
    mapping is written, so that its real size decides for a broadcast before a
    row it is applied to is moved.
    """
    parts = [df.select(F.lit(c).alias("column"), _as_category(c).alias("value")).distinct()
             for c in cols if c in df.columns]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, value string, idx bigint")
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    ranked = with_positions(allv, ["column"], ["value"])
    return checkpoint(ranked.select("column", "value", F.col("_pos").alias("idx")))


def apply_category_index(df: DataFrame, mapping: DataFrame, cols: list[str],
                         suffix: str = "") -> DataFrame:
    """Replace categories by their index; unseen value or column -> -1."""
    out = df
    for c in cols:
        out_col = f"{c}{suffix}"
        if c not in out.columns:
            out = out.withColumn(out_col, F.lit(-1).cast("bigint"))
            continue
        m = mapping.where(F.col("column") == c).select(
            F.col("value").alias("_cv"), F.col("idx").alias("_ci"))
        out = (out.join(m, _as_category(c) == F.col("_cv"), "left")
                  .withColumn(out_col, F.coalesce(F.col("_ci"), F.lit(-1).cast("bigint")))
                  .drop("_cv", "_ci"))
    return out


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """codes = rank of the value among the frame's own sorted distinct values."""
    mapping = fit_category_index(df, [col])
    return apply_category_index(df, mapping, [col], suffix="" if out is None else "_code")


# Prefixes of one-hot feature names.
ONE_HOT_PREFIXES = {"state": ["state_", "State_"], "market": ["market_", "Market_"],
                    "commodity": ["commodity_", "Commodity_"]}


def _candidates(field: str, prefixes: list[str]) -> list[Column]:
    """Normalized names a field's value may have as a feature, best first."""
    v = norm_key(field)
    return [norm_key(F.concat(F.lit(p), variant), null_as=None)
            for variant in (v, F.replace(v, F.lit(" "), F.lit("_")), F.replace(v, F.lit(" "), F.lit("")))
            for p in prefixes]


def one_hot_hits(df: DataFrame, names: DataFrame, keep: list[str],
                 prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    """E4 in long form: (``keep``, feature) for every feature that a row switches on.

    ``names(feature)`` is a table, so the number of features is free: the
    distinct values of each field meet it by an equi-join on the normalized
    name, and only the first candidate that exists is taken. Equal normalized
    names count as one feature, the last in order.
    """
    known = (names.select("feature", norm_key("feature").alias("_norm")).groupBy("_norm")
                  .agg(F.max("feature").alias("feature")))
    out = None
    for field, pfx in (prefixes or ONE_HOT_PREFIXES).items():
        if field not in df.columns:
            continue
        vals = df.select(field).where(norm_key(field) != "").distinct()
        tried = vals.select(F.col(field).alias("_v"), F.posexplode(F.array(*_candidates(field, pfx))).alias("_p", "_c"))
        best = (tried.join(known, tried["_c"] == known["_norm"])
                     .groupBy("_v").agg(F.min_by("feature", "_p").alias("feature")))
        hits = df.join(best, df[field] == best["_v"]).select(*keep, "feature")
        out = hits if out is None else out.unionByName(hits)
    return out


def set_one_hot(df: DataFrame, feature_cols: list[str],
                prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    """For state/market/commodity set the feature column whose normalized
    name equals prefix + value (raw, ``_``-joined or squashed), first match wins.

    Column names are normalized on the driver (metadata only) into one
    literal map; each row probes it with its candidates in order.
    """
    prefixes = prefixes or ONE_HOT_PREFIXES
    norm_to_col = {norm: c for c, norm in norm_names(df.sparkSession, feature_cols).items()}
    lookup = F.create_map(*[x for kv in norm_to_col.items() for x in map(F.lit, kv)]) \
        if norm_to_col else None
    out = df
    hits = []
    for field, pfx in prefixes.items():
        if field not in df.columns or lookup is None:
            continue
        v = norm_key(field)
        cands = _candidates(field, pfx)
        target = F.when(v != "", F.coalesce(*[F.try_element_at(lookup, c) for c in cands]))
        out = out.withColumn(f"_oh_{field}", target)
        hits.append(f"_oh_{field}")
    for c in feature_cols:
        hit = F.lit(False)
        for h in hits:
            hit = hit | F.coalesce(F.col(h) == F.lit(c), F.lit(False))
        base = F.col(c) if c in out.columns else F.lit(0)
        out = out.withColumn(c, F.when(hit, F.lit(1)).otherwise(base))
    return out.drop(*hits)


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row mean / population std per column; zero std -> 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    st = df.agg(*aggs)
    return st.withColumns({f"{c}__std": F.when(F.col(f"{c}__std") == 0, F.lit(1.0))
                           .otherwise(F.col(f"{c}__std")) for c in cols})


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / std with the one-row fitted statistics."""
    j = attach_one_row(df, stats)
    j = j.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in cols})
    return j.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])
