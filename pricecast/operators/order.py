"""Exact order statistics that never put a whole key group in one task.

``with_positions`` gives every row its 0-based rank within its key under a
total order. It range-partitions on (key, order), so a hot key is spread
over many partitions. Each partition is sorted locally, and a small table
of per-(partition, key) counts turns local row indexes into global ranks.
That table has at most #keys + #partitions rows; its window runs per key
over the partitions that key spans.

Beside it:
* ``exact_quantiles`` - percentile_cont per key by narrowing counts (Spark's
  exact ``percentile`` aggregate keeps a whole group's values in one buffer);
* ``chunked`` - series windows whose long series are cut into chunks with a
  halo of preceding rows, so lag/rolling frames stay exact.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricecast.session import checkpoint

# Rows of a series that one window task takes, up to whole buckets: few enough that a task sorts and
# buffers them in its share of an executor's memory, and spills nothing.
CHUNK_ROWS = 500_000

# Ranges in which a key's values are counted, and values that are counted singly.
BINS = 65_536

# Rows without a series are spread over this many window partitions.
STRAY_CHUNKS = 4096


def with_positions(df: DataFrame, keys: list[str], order: list[str | Column],
                   n_parts: int | None = None) -> DataFrame:
    """Add ``_pos`` (0-based rank within ``keys`` by ``order``) and ``_n`` (key size).

    ``order`` should be a total order within the key for deterministic
    ranks; ties get distinct consecutive ranks in an unspecified order.
    The range-partitioned, sorted data is checkpointed so the partition ids
    and local indexes stay fixed across the two uses below (and across an
    executor loss).
    """
    # without an explicit count AQE sizes (coalesces) the range partitions
    # from the measured data; coalescing merges adjacent ranges only
    ranged = (df.repartitionByRange(n_parts, *keys, *order) if n_parts
              else df.repartitionByRange(*keys, *order))
    s = (ranged.sortWithinPartitions(*keys, *order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = checkpoint(s)
    stats = (s.groupBy("_pid", *keys)
              .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first")))
    w_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    stats = (stats.withColumn("_off", F.sum("_cnt").over(w_key.orderBy("_pid")) - F.col("_cnt"))
                  .withColumn("_n", F.sum("_cnt").over(w_key)))
    stats = stats.select(
        F.col("_pid").alias("_spid"), *[F.col(k).alias(f"_s_{k}") for k in keys],
        "_off", "_first", "_n")
    cond = [s["_pid"] == stats["_spid"]] + [s[k].eqNullSafe(stats[f"_s_{k}"]) for k in keys]
    out = s.join(stats, reduce(lambda a, b: a & b, cond))
    return (out.withColumn("_pos", F.col("_off") + F.col("_mid") - F.col("_first"))
               .drop("_spid", "_pid", "_mid", "_off", "_first", *[f"_s_{k}" for k in keys]))


def exact_quantiles(df: DataFrame, keys: list[str], col: str, qs: dict[str, float],
                    weight: str | None = None, bins: int = BINS, written: bool = False) -> DataFrame:
    """percentile_cont of ``col`` per key for each named fraction in ``qs``.

    Same definition as Spark ``percentile`` / DuckDB ``quantile_cont``:
    position (n-1)q, linear interpolation between its floor and ceiling.
    ``weight`` names a column that says how many times a row counts, for rows
    that are counted beforehand (few of them share a key and value).
    ``written`` says that ``df`` is cheap to read again (written rows, at most
    repeated under several keys), so its values are not written once more.

    Distributed selection by narrowing: a key's values are counted in ``bins``
    equal ranges between its least and greatest, running sums find the range
    that holds each wanted rank, and only the rows of these ranges are counted
    again, between the least and greatest value found there. An interval of at
    most ``bins`` rows is counted by value, which ends it. All keys and
    quantiles narrow together; what a task sorts is the counts of one interval,
    never a key's values, and what moves is counts. Values are not moved or
    sorted. Each round splits every interval, so the rounds end; two or three
    suffice with the default number of ranges. A key whose ranks are all found
    leaves: only keys of more than ``bins`` rows, of which there are few, are
    met with the rows again.
    """
    v, inf = F.col("_v"), float("inf")
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    thin = df.select(*keys, F.col(col).cast("double").alias("_v"), times.alias("_w")).where(v.isNotNull())
    if not written:
        thin = checkpoint(thin)
    finite = F.when(~F.isnan(v) & (F.abs(v) < inf), v)
    names = list(qs)
    pos = [(F.col("_n") - 1) * F.lit(float(qs[name])) for name in names]
    wanted = F.array(*[F.struct(F.lit(2 * k + up).alias("q"), (F.ceil if up else F.floor)(p).cast("bigint").alias("r"))
                       for k, p in enumerate(pos) for up in (0, 1)])
    group = thin.groupBy(*keys) if keys else thin.groupBy()
    found = group.agg(F.sum("_w").alias("_n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).where(F.col("_n") > 0)
    # a written number stands for the key in all counts, which then move and sort as numbers
    found = found.select(*keys, "_n", F.monotonically_increasing_id().alias("_g"), F.array(F.struct(F.lit(0).alias("id"), F.col("_n").alias("c"), "lo", "hi",
                                                       wanted.alias("t"))).alias("_iv"))
    known, done = checkpoint(found), None
    more = F.exists("_iv", lambda i: i["hi"] > i["lo"])
    while True:
        known = checkpoint(_narrowed(thin, known, keys, bins, done is None))
        settled = known.where(~more)
        done = settled if done is None else done.unionByName(settled)
        known = known.where(more)
        if known.isEmpty():
            break
        # written, so that its real size decides for a broadcast before a row is moved
        known = checkpoint(known)
    at = [_value_of(k) for k in range(2 * len(names))]
    return done.select(*keys, *[(at[2 * k] + (at[2 * k + 1] - at[2 * k]) * (p - F.floor(p))).alias(name)
                                 for k, (name, p) in enumerate(zip(names, pos))])


def _value_of(target: int) -> Column:
    """The value of a wanted rank, once its interval holds one value."""
    def holds(interval: Column) -> Column:
        return F.exists(interval["t"], lambda t: t["q"] == target)
    return F.get(F.filter("_iv", holds), F.lit(0))["lo"]


def _size(x: Column) -> Column:
    """A logarithm over all finite doubles, in their order: 0 at 0, odd."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746.0))


def _narrowed(thin: DataFrame, known: DataFrame, keys: list[str], bins: int, whole: bool) -> DataFrame:
    """One round of ``exact_quantiles``: the intervals that hold the wanted ranks, one level finer."""
    v, inf = F.col("_v"), float("inf")
    if keys:
        side = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_g", F.inline("_iv")).withColumnRenamed("id", "_id")
        same = reduce(and_, [thin[k].eqNullSafe(side[f"_k_{k}"]) for k in keys])
        inside = same if whole else same & (v >= side["lo"]) & (v <= side["hi"])
        j = thin.join(side.drop("t"), inside)
    else:       # the whole column is one key, whose few intervals are put in as literals
        side = known.select("_g", F.inline("_iv")).withColumnRenamed("id", "_id")
        at = F.lit(None).cast("struct<_g:bigint,_id:int,c:bigint,lo:double,hi:double>")
        for r in side.collect():
            here = F.lit(True) if whole else (v >= F.lit(r["lo"])) & (v <= F.lit(r["hi"]))
            at = F.when(here, F.struct(*[F.lit(r[c]).cast(side.schema[c].dataType).alias(c) for c in ("_g", "_id", "c", "lo", "hi")])).otherwise(at)
        j = thin.withColumn("_i", at).where(F.col("_i").isNotNull()).select("*", "_i.*")
    lo, hi = F.col("lo"), F.col("hi")
    wide = _size(hi) - _size(lo) > 1.0      # over orders of magnitude the ranges are of a logarithm
    share = (F.when(wide, (_size(v) - _size(lo)) / (_size(hi) - _size(lo)))
             .otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0))))
    range_no = (F.when(F.isnan(v), float(bins + 2)).when(v == inf, float(bins + 1)).when(v == -inf, -1.0)
                .otherwise(F.coalesce(F.floor(share * bins).cast("double"), F.lit(0.0))))
    j = j.withColumn("_b", F.when(F.col("c") <= bins, v).otherwise(range_no))
    counts = j.groupBy("_g", "_id", "_b").agg(F.sum("_w").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    upto = F.sum("c").over(Window.partitionBy("_g", "_id").orderBy("_b"))
    counts = counts.withColumn("_beg", upto - F.col("c"))       # of one interval: few ranges or few values
    held = F.filter("t", lambda t: (t["r"] >= F.col("_beg")) & (t["r"] < F.col("_beg") + F.col("c")))
    hit = counts.join(side.select("_g", "_id", "t"), ["_g", "_id"]).withColumn("t", held).where(F.size("t") > 0)
    hit = hit.withColumn("t", F.transform("t", lambda t: F.struct(t["q"].alias("q"), (t["r"] - F.col("_beg")).alias("r"))))
    hit = hit.groupBy("_g").agg(F.collect_list(F.struct("c", "lo", "hi", "t")).alias("_l"))
    numbered = F.transform("_l", lambda x, k: F.struct(k.cast("int").alias("id"), x["c"].alias("c"), x["lo"].alias("lo"),
                                                       x["hi"].alias("hi"), x["t"].alias("t")))
    return known.drop("_iv").join(hit.select("_g", numbered.alias("_iv")), "_g")


def known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key columns are all present: grouped series drop the others."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def chunked(df: DataFrame, keys: list[str], order: list[str], halo: int,
            bucket: list[str] | None = None, chunk_rows: int = CHUNK_ROWS,
            counted: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Prepare ``df`` for series windows with frames reaching ``halo`` rows back.

    Returns ``(frame, partition_cols)``: window over
    ``partitionBy(*partition_cols).orderBy(*order)``, then ``finish_chunked``.

    Rows are counted per key, one pass over the key columns. Without a key of
    more than ``chunk_rows`` rows that is all, and the window is the plain one.
    The long keys are counted per (key, ``bucket``), where ``bucket`` is a
    leading part of ``order`` (default: its first column, the date); a bucket
    of more than ``chunk_rows`` rows is cut further, by the exact ranks of its
    rows, which only then are range-partitioned. A running sum over the counts
    cuts each long series into chunks that begin within ``chunk_rows`` rows of
    each other, and finds the earlier buckets that hold the ``halo`` rows before
    each chunk. Rows of such a bucket are repeated, flagged, at the head of that
    chunk. A halo may hold more than ``halo`` rows, which no frame reaches.

    The written list of chunks is joined by its real size. The rows themselves
    move once, for the window, and no task gets more than about two chunks' rows
    and a halo, however a key's rows lie on dates.

    Rows with a null key belong to no series. They are spread over chunks of
    their own by a hash, so callers must not use what a window says of them.
    ``counted`` is a frame with the same keys and order columns as ``df``, for
    callers whose ``df`` is costly to compute.
    """
    bucket = list(bucket or order[:1])
    base = known_keys(df if counted is None else counted, keys)
    stray = reduce(or_, [F.col(k).isNull() for k in keys]) if keys else F.lit(False)
    apart = F.when(stray, F.pmod(F.xxhash64(*order), F.lit(STRAY_CHUNKS))).otherwise(F.lit(0).cast("bigint"))
    count = (base.groupBy(*keys) if keys else base.groupBy()).agg(F.count(F.lit(1)).alias("_n"))
    long = count.where(F.col("_n") > chunk_rows).select(*keys, "_n")
    if long.isEmpty():
        return df.withColumns({"_chunk": apart, "_halo": F.lit(False)}), [*keys, "_chunk"]
    if keys:   # a written list, so that only the long series' rows are counted by bucket
        base = base.join(checkpoint(long.select(*keys)), keys, "left_semi")
    per_bucket = checkpoint(base.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("_c")))
    cut = [*bucket, "_sub"]
    whole = F.lit(0).cast("bigint")
    crowded = per_bucket.where(F.col("_c") > chunk_rows).drop("_c")
    if crowded.isEmpty():
        per_bucket, df = per_bucket.withColumn("_sub", whole), df.withColumn("_sub", whole)
    else:
        same = [c for c in (*keys, *bucket)]
        crowded = checkpoint(crowded).select(*[F.col(c).alias(f"_c_{c}") for c in same], F.lit(True).alias("_crowd"))
        j = df.join(crowded, reduce(and_, [df[c].eqNullSafe(crowded[f"_c_{c}"]) for c in same]), "left")
        j = j.drop(*[f"_c_{c}" for c in same])
        ranked = with_positions(j.where(F.col("_crowd")).drop("_crowd"), same, order[len(bucket):] or order)
        ranked = checkpoint(ranked.withColumn("_sub", F.floor(F.col("_pos") / chunk_rows)).drop("_pos", "_n"))
        df = j.where(F.col("_crowd").isNull()).drop("_crowd").withColumn("_sub", whole).unionByName(ranked)
        parts = F.sequence(whole, F.floor((F.col("_c") - 1) / chunk_rows))
        per_bucket = (per_bucket.withColumn("_sub", F.explode(parts))
                      .withColumn("_c", F.least(F.lit(chunk_rows).cast("bigint"), F.col("_c") - F.col("_sub") * chunk_rows)))
    series = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    along = series.orderBy(*cut)
    b = (per_bucket.withColumn("_end", F.sum("_c").over(along))
                   .withColumn("_beg", F.col("_end") - F.col("_c"))
                   .withColumn("_chunk", F.floor(F.col("_beg") / chunk_rows))
                   .withColumn("_opens", F.col("_chunk") != F.lag("_chunk").over(along)))
    if halo > 0:
        # chunks that open less than ``halo`` rows after this bucket's end, seen
        # from the next bucket, which begins there
        near = series.orderBy("_beg").rangeBetween(0, halo - 1)
        ahead = F.collect_list(F.when(F.col("_opens"), F.col("_chunk"))).over(near)
        b = b.withColumn("_ahead", ahead).withColumn("_serves", F.lead("_ahead").over(along))
    else:
        b = b.withColumn("_serves", F.lit(None).cast("array<bigint>"))
    cols = [*keys, *cut]
    b = checkpoint(b.select(*[F.col(c).alias(f"_b_{c}") for c in cols], "_chunk", "_serves"))
    j = df.join(b, reduce(and_, [df[c].eqNullSafe(b[f"_b_{c}"]) for c in cols]), "left")
    own = F.coalesce("_chunk", apart)
    at = F.concat(F.array(F.struct(own.alias("c"), F.lit(False).alias("h"))),
                  F.coalesce(F.transform("_serves", lambda c: F.struct(c.alias("c"), F.lit(True).alias("h"))),
                             F.array().cast("array<struct<c:bigint,h:boolean>>")))
    out = j.select(*[df[c] for c in df.columns if c != "_sub"], F.inline(at).alias("_chunk", "_halo"))
    return out, [*keys, "_chunk"]


def finish_chunked(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", "_chunk")
