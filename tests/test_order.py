"""Distributed order statistics and chunked (hot-key) windows vs brute force."""
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricecast.operators import order
from pricecast.operators.clean import ffill
from pricecast.operators.features import add_series_windows
from pricecast.operators.sequence import log_delta, sequences
from tests.conftest import rows


def _hot_frame(spark, n=3000, seed=7):
    """One key holds a third of the rows (the skew case to design for)."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{i % 17}"
        v = None if rnd.random() < 0.05 else round(rnd.uniform(1, 100), 3)
        data.append((key, i, v))
    return spark.createDataFrame(data, "key string, t long, v double")


def test_positions_match_row_number(spark):
    df = _hot_frame(spark)
    p = order.with_positions(df, ["key"], ["t"], n_parts=5)
    w = Window.partitionBy("key").orderBy("t")
    ref = df.withColumn("_pos", F.row_number().over(w) - 1)
    assert rows(p, "key", "t", "_pos") == rows(ref, "key", "t", "_pos")
    n = p.groupBy("key").agg(F.max("_n").alias("n"), F.count("*").alias("c"))
    assert all(r["n"] == r["c"] for r in n.collect())


def test_global_positions(spark):
    df = _hot_frame(spark)
    p = order.with_positions(df, [], ["t"], n_parts=7)
    assert sorted(r["_pos"] for r in p.collect()) == list(range(df.count()))
    assert rows(p.where(F.col("_pos") != F.col("t")), "t") == []


def test_exact_quantiles_match_percentile(spark):
    df = _hot_frame(spark)
    qs = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q90": 0.9}
    got = order.exact_quantiles(df, ["key"], "v", qs, bins=16)
    ref = df.groupBy("key").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()])
    g = {r["key"]: r for r in got.collect()}
    for r in ref.collect():
        for n in qs:
            assert abs(g[r["key"]][n] - r[n]) < 1e-9
    glob = order.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert abs(glob - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-9
    twice = df.withColumn("w", F.lit(2))
    doubled = df.unionByName(df).groupBy("key").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()])
    s = {r["key"]: r for r in order.exact_quantiles(twice, ["key"], "v", qs, weight="w").collect()}
    for r in doubled.collect():
        for n in qs:
            assert abs(s[r["key"]][n] - r[n]) < 1e-9


def test_quantiles_of_a_price_that_half_the_rows_share(spark):
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.rand(3) * 10).alias("v"), F.lit("k").alias("key"))
    qs = {"a": 0.1, "m": 0.5, "z": 0.9}
    got = order.exact_quantiles(df, ["key"], "v", qs).first()
    want = df.select(*[F.percentile("v", q).alias(n) for n, q in qs.items()]).first()
    assert all(abs(got[c] - want[c]) < 1e-9 for c in qs)


def test_quantiles_of_every_kind_of_double(spark):
    """Infinities, NaN (greatest), denormals, the whole range of exponents, null keys, few and many ranges."""
    rnd = random.Random(5)
    odd = [float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, -0.0]
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, *odd, rnd.gauss(0, 1), 10.0 ** rnd.randint(-300, 300)])) for _ in range(3000)]
    data += [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(data, "key string, v double")
    for bins in (2, 50, 65_536):
        got = {r["key"]: r for r in order.exact_quantiles(df, ["key"], "v", {"q0": 0.0, "q3": 0.3, "q1": 1.0}, bins=bins).collect()}
        assert set(got) == {"a", "b", None, "one"}
        for key in ("a", "b", None):
            vals = sorted((v for k, v in data if k == key and v is not None), key=lambda v: (v != v, v))
            at = (len(vals) - 1) * 0.3
            for name, pos in (("q0", 0), ("q1", len(vals) - 1)):
                assert got[key][name] == vals[pos] or got[key][name] != got[key][name]
            lo, hi = vals[int(at)], vals[min(int(at) + 1, len(vals) - 1)]
            assert got[key]["q3"] != got[key]["q3"] or lo <= got[key]["q3"] <= hi
        assert got["one"]["q3"] == 3.5
    assert order.exact_quantiles(df.where("false"), ["key"], "v", {"m": 0.5}).count() == 0


def test_one_date_is_cut_evenly(spark):
    """A series whose rows all lie on one date: chunks of even size, results as with one window."""
    df = spark.range(5000).select(F.lit("k").alias("key"), F.lit(3).alias("d"), ((F.col("id") * 37) % 5000).alias("i"),
                                  F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"))
    df = df.unionByName(df.where("i < 40").withColumn("key", F.lit("short"))).unionByName(df.where("i < 9").withColumn("d", F.lit(4)))
    frame, parts = order.chunked(df, ["key"], ["d", "i"], halo=7, chunk_rows=100)
    sizes = [r["count"] for r in frame.where("key = 'k'").groupBy(*parts).count().collect()]
    assert len(sizes) == 51 and max(sizes) <= 200
    by = ["d", "i"]
    w = Window.partitionBy("key").orderBy(*by)
    plain = rows(df.select("key", *by, F.lag("v", 1).over(w), F.lag("v", 7).over(w)))
    got = rows(add_series_windows(df, ["key"], by, "v", lags=(1, 7), roll=None, chunk_rows=100), "key", *by, "v_lag_1", "v_lag_7")
    assert got == plain
    full = rows(ffill(df, ["key"], by, "v").select("key", *by, F.coalesce("v", F.lit(-1.0))))
    assert rows(ffill(df, ["key"], by, "v", chunk_rows=100).select("key", *by, F.coalesce("v", F.lit(-1.0)))) == full


def _close(a, b):
    if a is None or b is None or not isinstance(a, float):
        return a == b
    return abs(a - b) < 1e-9


def _bursts(spark, n=900, seed=11):
    """Series with several rows a date, some dates longer than a chunk, some empty, some null."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        day = rnd.choice([None, *range(12), *[40] * 6, *range(60, 90)])
        data.append(("hot" if i % 3 == 0 else f"k{i % 5}", day, i, None if i % 7 == 0 else float(i % 31)))
    return spark.createDataFrame(data, "key string, d int, i int, v double")


def test_chunked_windows_equal_plain(spark):
    """Chunks and halos give what one window over the whole series gives."""
    for df, by in ((_hot_frame(spark), ["t"]), (_bursts(spark), ["d", "i"])):
        w = Window.partitionBy("key").orderBy(*by)
        wf = w.rowsBetween(-7, -1)
        plain = rows(df.select("key", by[-1], F.lag("v", 1).over(w), F.lag("v", 7).over(w),
                               F.when(F.count("v").over(wf) == 7, F.avg("v").over(wf))))
        for size in (1, 3, 50, 10_000):
            got = rows(add_series_windows(df, ["key"], by, "v", lags=(1, 7), roll=7, roll_fns=("mean",),
                                          chunk_rows=size), "key", by[-1], "v_lag_1", "v_lag_7", "v_roll_mean_7")
            assert len(got) == len(plain) == df.count()
            assert all(_close(u, v) for x, y in zip(got, plain) for u, v in zip(x, y))


def test_chunks_bound_a_series(spark):
    """No chunk of a hot series exceeds the chunk size by more than one date and its halo."""
    df = _hot_frame(spark)
    frame, parts = order.chunked(df, ["key"], ["t"], halo=7, chunk_rows=40)
    assert frame.groupBy(*parts).count().agg(F.max("count")).first()[0] <= 47
    assert frame.where(~F.col("_halo")).count() == df.count()


def test_chunked_ffill_and_sequences(spark):
    for df, by in ((_hot_frame(spark, n=900), ["t"]), (_bursts(spark), ["d", "i"])):
        plain_ff = rows(ffill(df, ["key"], by, "v").select("key", by[-1], F.coalesce("v", F.lit(-1.0))))
        plain_seq = rows(sequences(df, ["key"], by, ["i" if "i" in by else "t"], "v", n=5), "key", by[-1], "seq")
        whole = rows(sequences(df, None, by, ["v"], "v", n=5), by[-1])
        for size in (2, 40):
            got = ffill(df, ["key"], by, "v", chunk_rows=size)
            assert rows(got.select("key", by[-1], F.coalesce("v", F.lit(-1.0)))) == plain_ff
            assert rows(sequences(df, ["key"], by, ["i" if "i" in by else "t"], "v", n=5, chunk_rows=size),
                        "key", by[-1], "seq") == plain_seq
            assert rows(sequences(df, None, by, ["v"], "v", n=5, chunk_rows=size), by[-1]) == whole


def test_ffill_matches_pandas(spark):
    df = _hot_frame(spark, n=600)
    pdf = df.toPandas().sort_values(["key", "t"])
    pdf["v"] = pdf.groupby("key")["v"].ffill()
    got = ffill(df, ["key"], ["t"], "v").toPandas().sort_values(["key", "t"])
    pd.testing.assert_series_equal(got["v"].reset_index(drop=True),
                                   pdf["v"].reset_index(drop=True), check_names=False)


def test_null_series_keys_are_no_series(spark):
    """As with grouped pandas frames: null-key rows fill nothing and start no window."""
    data = [(None, t, float(t) if t % 3 else None) for t in range(60)] + [("a", t, float(t) if t % 4 else None) for t in range(60)]
    df = spark.createDataFrame(data, "key string, t int, v double")
    plain = rows(ffill(df, ["key"], ["t"], "v").select("key", "t", F.coalesce("v", F.lit(-1.0)).alias("v")), "t", "v")
    assert len(plain) == 120 and sum(v == -1.0 for _, v in plain) == 61
    seq = sequences(df, ["key"], ["t"], ["v"], "v", n=5)
    assert seq.where("key is null").count() == 0 and seq.count() == 55
    assert log_delta(df.na.fill(1.0), ["key"], ["t"], "v").where("key is null").count() == 0
    assert rows(ffill(df, ["key"], ["t"], "v", chunk_rows=16).select("key", "t", F.coalesce("v", F.lit(-1.0)).alias("v")), "t", "v") == plain
    assert sequences(df, ["key"], ["t"], ["v"], "v", n=5, chunk_rows=16).count() == 55


def test_only_keys_with_open_ranks_meet_the_rows_again(spark, monkeypatch):
    rows_ = [(k, float(v)) for k, n in (("a", 5), ("b", 6), ("long", 90)) for v in range(n)]
    df = spark.createDataFrame(rows_, "key string, v double")
    asked, narrow = [], order._narrowed

    def spy(thin, known, *rest):
        asked.append(sorted(r["key"] for r in known.select("key").collect()))
        return narrow(thin, known, *rest)

    monkeypatch.setattr(order, "_narrowed", spy)
    got = {r["key"]: r["m"] for r in order.exact_quantiles(df, ["key"], "v", {"m": 0.5}, bins=8).collect()}
    assert got == {"a": 2.0, "b": 2.5, "long": 44.5}
    assert asked[0] == ["a", "b", "long"] and asked[1:] and all(a == ["long"] for a in asked[1:])
