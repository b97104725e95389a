"""Driver tables and their mapping onto the price-observation data model.

The driver ships TPC-H-like tables; FIXTURES.md part B defines how they map
onto the forecasting inputs. The mapping is built here with the DataFrame
API; the oracle side (``pricecast.plans.oracle``) restates it in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecast.session import checkpoint

SERIES_KEY = ["commodity", "state", "district", "market"]   # 4-col series
SERVE_KEY = ["state", "market", "commodity"]                # 3-col serving key
TIEBREAK = ["k1", "k2", "k3"]                               # unique within (series, date)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table reader; listed anew each time, so a rewritten table is seen."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _supplier_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> (market, district, state); nation/region are bounded dims.

    Written, so that its real size (a join's estimate is the product of its sides) decides for a
    broadcast before a row of lineitem is moved."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    return checkpoint(s.join(nr, s.s_nationkey == nr.n_nationkey)
                       .select("s_suppkey", F.col("s_name").alias("market"),
                               F.col("n_name").alias("district"), F.col("r_name").alias("state")))


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: a market price observation."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    geo = _supplier_geo(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    # part first: where it is too large for a broadcast, the rows move without the places' names
    return (li.join(part, li.l_partkey == part.p_partkey)
              .join(geo, li.l_suppkey == geo.s_suppkey)
              .select("state", "district", "market",
                      F.substring("p_brand", 1, 7).alias("commodity_group"),
                      F.col("p_type").alias("commodity"),
                      F.col("p_brand").alias("variety"),
                      F.col("l_returnflag").alias("grade"),
                      F.to_date("l_shipdate").alias("arrival_date"),
                      (unit * (1 - F.col("l_discount"))).alias("min_price"),
                      (unit * (1 + F.col("l_tax"))).alias("max_price"),
                      unit.alias("modal_price"),
                      F.col("l_quantity").alias("arrival_quantity"),
                      F.col("l_orderkey").alias("k1"),
                      F.col("l_linenumber").alias("k2"),
                      F.col("l_partkey").alias("k3")))


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per district (aggregate with map-side partial agg), written: its size, bounded by
    districts and days, decides for a broadcast before the observations it is joined to are moved."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_tax", "l_discount", "l_quantity", "l_linenumber")
    geo = _supplier_geo(spark, sf_dir).select("s_suppkey", "district")
    daily = (li.join(geo, li.l_suppkey == geo.s_suppkey)
               .groupBy("district", F.to_date("l_shipdate").alias("arrival_date"))
               .agg((20 + 100 * F.avg("l_tax")).alias("t2m"),
                    (22 + 100 * F.max("l_tax")).alias("t2m_max"),
                    (18 + 100 * F.min("l_tax")).alias("t2m_min"),
                    (100 * F.avg("l_discount")).alias("prectotcorr"),
                    F.avg("l_quantity").alias("rh2m"),
                    F.avg("l_linenumber").alias("ws2m")))
    return checkpoint(daily)


def seasonal(spark: SparkSession, sf_dir: str, obs: DataFrame | None = None) -> DataFrame:
    """Seasonal factors per (state, district, market, commodity, date), day <= 20."""
    obs = obs if obs is not None else price_obs(spark, sf_dir)
    m = F.month("arrival_date")
    return (obs.where(F.dayofmonth("arrival_date") <= 20)
               .groupBy("state", "district", "market", "commodity", "arrival_date")
               .agg(F.max("modal_price").alias("modal_price"))
               .withColumn("season",
                           F.when(m.isin(6, 7, 8, 9), "Kharif")
                            .when(m.isin(10, 11, 12, 1), "Rabi").otherwise("Zaid"))
               .withColumn("festival", F.when(m.isin(10, 11), 1).otherwise(0)))


# The request commodity spellings by c_custkey % 7 (FIXTURES.md B).
REQUEST_COMMODITIES = ["ECONOMY", "medium", "Promo", "SMALL", " Large", "STANDARD", "unknown"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast requests: raw (un-normalized) text keys and a request date."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("c_custkey")
    commodity = F.element_at(F.array(*[F.lit(x) for x in REQUEST_COMMODITIES]),
                             (key % 7 + 1).cast("int"))
    return (c.join(nr, c.c_nationkey == nr.n_nationkey)
             .select(key.alias("request_id"),
                     F.when(key % 11 == 0, F.lit("Atlantis"))
                      .otherwise(F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")))
                      .alias("state"),
                     F.concat(F.lit("SUPPLIER#"),
                              F.lpad((key % 150).cast("string"), 9, "0")).alias("market"),
                     commodity.alias("commodity"),
                     F.date_add(F.lit("1994-06-01").cast("date"),
                                ((key * 37) % 2800).cast("int")).alias("arrival_date")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
