"""Registered metadata queries (A1–A6, S4, A11) over the fixture mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricecast.operators import meta
from pricecast.plans.catalog import finish, register
from pricecast.plans.oracle import r4, with_fixtures
from pricecast.sources import tables as tb

_TOP_SQL = with_fixtures(select=f"""
SELECT market, CAST(count(*) AS DOUBLE) AS activity,
       {r4("round_even(avg(modal_price), 2)")} AS avg_price, count(*) AS records
FROM price_obs WHERE modal_price IS NOT NULL
GROUP BY market ORDER BY activity DESC, market ASC LIMIT 10""")


@register("top_markets", _TOP_SQL)
def q_top_markets(spark, sf_dir):
    """A2 with no arrivals column (the service's path, see SURVEY Q5)."""
    obs = tb.price_obs(spark, sf_dir)
    return finish(meta.top_markets(obs, k=10))


_TOP_ARR_SQL = with_fixtures(select=f"""
SELECT market, {r4("coalesce(sum(arrival_quantity), 0)")} AS activity,
       {r4("round_even(avg(modal_price), 2)")} AS avg_price, count(*) AS records
FROM price_obs WHERE commodity = 'STANDARD' AND modal_price IS NOT NULL
GROUP BY market ORDER BY activity DESC, market ASC LIMIT 25""")


@register("top_markets_by_arrivals", _TOP_ARR_SQL)
def q_top_markets_arrivals(spark, sf_dir):
    """A2 with the arrivals column present (activity = sum of arrivals)."""
    obs = tb.price_obs(spark, sf_dir)
    return finish(meta.top_markets(obs, commodity="STANDARD", k=25,
                                   arrivals_col="arrival_quantity"))


@register("distinct_states", with_fixtures(select=f"""
SELECT DISTINCT state FROM price_obs WHERE state IS NOT NULL"""))
def q_states(spark, sf_dir):
    return meta.distinct_values(tb.price_obs(spark, sf_dir), "state")


@register("markets_in_state", with_fixtures(select=f"""
SELECT DISTINCT market FROM price_obs WHERE state = 'ASIA' AND market IS NOT NULL"""))
def q_markets(spark, sf_dir):
    return meta.distinct_values(tb.price_obs(spark, sf_dir), "market", state="ASIA")


@register("districts_in_state", with_fixtures(select=f"""
SELECT DISTINCT district FROM price_obs WHERE state = 'EUROPE' AND district IS NOT NULL"""))
def q_districts(spark, sf_dir):
    return meta.distinct_values(tb.price_obs(spark, sf_dir), "district", state="EUROPE")


@register("commodity_counts", with_fixtures(select=f"""
SELECT commodity, count(*) AS n_records FROM price_obs
WHERE commodity IS NOT NULL GROUP BY commodity"""))
def q_commodity_counts(spark, sf_dir):
    return meta.value_counts(tb.price_obs(spark, sf_dir), "commodity")


@register("price_trend", with_fixtures("""top AS (
  SELECT commodity FROM price_obs WHERE commodity IS NOT NULL
  GROUP BY commodity ORDER BY count(*) DESC, commodity ASC LIMIT 1)""", select=f"""
SELECT arrival_date,
       {r4("CAST(sum(CAST(modal_price AS DECIMAL(38,8))) AS DOUBLE) / count(modal_price)")} AS avg_price,
       count(*) AS n_records
FROM price_obs WHERE commodity IN (SELECT commodity FROM top) GROUP BY arrival_date"""))
def q_price_trend(spark, sf_dir):
    return finish(meta.price_trend(tb.price_obs(spark, sf_dir)))


@register("top_markets_per_commodity", with_fixtures("""g AS (
  SELECT commodity, market, count(*) AS n_records FROM price_obs GROUP BY commodity, market)""",
                                                     select="""
SELECT commodity, market, n_records, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY n_records DESC, market) AS rank
  FROM g) WHERE rank <= 2"""))
def q_top2(spark, sf_dir):
    return finish(meta.top_markets_per_commodity(tb.price_obs(spark, sf_dir), n=2))


@register("audit_load", with_fixtures(select=f"""
SELECT count(*) AS rows, min(arrival_date) AS min_date, max(arrival_date) AS max_date
FROM price_obs"""))
def q_audit(spark, sf_dir):
    return meta.audit_load(tb.price_obs(spark, sf_dir))


@register("weather_coverage", with_fixtures("""m AS (
  SELECT o.*, w.t2m FROM price_obs o LEFT JOIN weather_daily w
  ON o.district = w.district AND o.arrival_date = w.arrival_date)""", select=f"""
SELECT {r4("avg(CASE WHEN t2m IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100")} AS coverage_pct
FROM m"""))
def q_weather_coverage(spark, sf_dir):
    """A11 over the weather join: share of observations with weather."""
    obs = tb.price_obs(spark, sf_dir)
    w = tb.weather_daily(spark, sf_dir).select("district", "arrival_date", "t2m")
    return finish(meta.coverage_pct(obs.join(w, ["district", "arrival_date"], "left"), "t2m"))



_SINK_PRICE = "CAST(sum(CAST(modal_price AS DECIMAL(38,8))) AS DOUBLE) / count(modal_price)"


@register("sink_roundtrip", with_fixtures(select=f"""
SELECT s.sink, count(*) AS rows, CASE WHEN s.sink <> 'predictions' THEN min(arrival_date) END AS min_date,
       CASE WHEN s.sink <> 'predictions' THEN max(arrival_date) END AS max_date, {r4(_SINK_PRICE)} AS avg_price
FROM price_obs, (VALUES ('stage'), ('predictions'), ('json')) s(sink) GROUP BY s.sink"""))
def q_sink_roundtrip(spark, sf_dir):
    """S2 + S5 + S6 + S4: the observations written as a year-partitioned stage
    table, interval predictions and a JSON export (all under the shared
    checkpoint folder), then each read back and audited."""
    import uuid

    from pricecast.session import ensure_checkpoint_dir
    from pricecast.sources import io as sio
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    obs = tb.price_obs(spark, sf_dir)
    sio.write_stage(obs.withColumn("year", F.year("arrival_date")), f"{base}/stage",
                    partition_by=["year"])
    bands = obs.select(F.col("modal_price").alias("y_true"), F.col("min_price").alias("p10"),
                       F.col("modal_price").alias("p50"), F.col("max_price").alias("p90"))
    sio.write_predictions(bands, f"{base}/predictions")
    sio.export_json(obs.select("market", "arrival_date", "modal_price"), f"{base}/json")
    back = {"stage": spark.read.parquet(f"{base}/stage"),
            "predictions": spark.read.parquet(f"{base}/predictions").select(
                F.lit(None).cast("date").alias("arrival_date"), F.col("p50").alias("modal_price")),
            "json": spark.read.schema("market string, arrival_date date, modal_price double").json(f"{base}/json")}
    # from an exact decimal sum: independent of summation order
    price = F.sum(F.col("modal_price").cast("decimal(38,8)")).cast("double") / F.count("modal_price")
    out = None
    for name, df in back.items():
        audit = df.groupBy(F.lit(name).alias("sink")).agg(
            F.count(F.lit(1)).alias("rows"), F.min("arrival_date").alias("min_date"),
            F.max("arrival_date").alias("max_date"), price.alias("avg_price"))
        out = audit if out is None else out.unionByName(audit)
    return finish(out)


_LOAD_AUDIT = f"""count(*) AS rows, min(arrival_date) AS min_date, max(arrival_date) AS max_date, {r4(_SINK_PRICE)} AS avg_price"""


@register("warehouse_load", with_fixtures("""kept AS (SELECT * FROM price_obs WHERE grade = 'R')""", """twice AS (
  SELECT * FROM price_obs UNION ALL SELECT * FROM kept)""", select=f"""
SELECT 1 AS step, 'fail' AS if_exists, false AS refused, {_LOAD_AUDIT} FROM price_obs
UNION ALL SELECT 2, 'append', false, {_LOAD_AUDIT} FROM twice
UNION ALL SELECT 3, 'fail', true, {_LOAD_AUDIT} FROM twice
UNION ALL SELECT 4, 'replace', false, {_LOAD_AUDIT} FROM kept"""))
def q_warehouse_load(spark, sf_dir):
    """S3 + S4: the observations loaded in batches of 5000 into a new table, rows of one grade
    appended, a second load with ``fail`` refused, the table replaced; audited after every step."""
    import uuid

    from pricecast.session import ensure_checkpoint_dir
    from pricecast.sources import io as sio
    from pricecast.sources import warehouse
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/load-{uuid.uuid4().hex}"
    obs = tb.price_obs(spark, sf_dir)
    kept = obs.where(F.col("grade") == "R")
    price = F.sum(F.col("modal_price").cast("decimal(38,8)")).cast("double") / F.count("modal_price")
    out = None
    for step, (part, how) in enumerate(((obs, "fail"), (kept, "append"), (obs, "fail"), (kept, "replace")), start=1):
        refused = False
        try:
            sio.load_table(part, "price_obs", how, folder=folder)
        except FileExistsError:
            refused = True
        audit = warehouse.read(spark, f"{folder}/price_obs").agg(
            F.count(F.lit(1)).alias("rows"), F.min("arrival_date").alias("min_date"), F.max("arrival_date").alias("max_date"),
            price.alias("avg_price"))
        audit = audit.select(F.lit(step).alias("step"), F.lit(how).alias("if_exists"), F.lit(refused).alias("refused"), "*")
        out = audit if out is None else out.unionByName(audit)
    return finish(out)
