"""What the shared stages move: fact tables meet written dimensions without a shuffle, windows carry no column that a date or a join tells."""
import re

from pyspark.sql import functions as F

from pricecast.operators import encode, features
from pricecast.sources import tables as tb

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_observations_meet_their_dimensions_where_they_lie(spark):
    assert "Exchange hashpartitioning" not in _plan(tb.price_obs(spark, SF))
    joined = tb.price_obs(spark, SF).join(tb.weather_daily(spark, SF), ["district", "arrival_date"], "left")
    assert "Exchange hashpartitioning" not in _plan(joined)


def test_the_feature_stage_moves_its_rows_twice_and_without_derived_columns(spark):
    ft = features.feature_table(tb.price_obs(spark, SF), tb.SERIES_KEY, tb.TIEBREAK, weather=tb.weather_daily(spark, SF))
    plan = ft._jdf.queryExecution().optimizedPlan().toString()
    assert _plan(ft).count("Exchange hashpartitioning") == 2
    below = plan[plan.index("Window"):]      # what lies under the last window is moved for it
    assert not re.search("month_sin|arrival_qty_log1p|temp_range", below)


def test_weather_given_apart_gives_the_same_features(spark):
    obs, w = tb.price_obs(spark, SF), tb.weather_daily(spark, SF)
    one = features.feature_table(obs.join(w, ["district", "arrival_date"], "left"), tb.SERIES_KEY, tb.TIEBREAK)
    two = features.feature_table(obs, tb.SERIES_KEY, tb.TIEBREAK, weather=w).select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_categories_are_coded_without_moving_a_row(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("c"))
    out = encode.apply_category_index(df, encode.fit_category_index(df, ["c"]), ["c"], suffix="_idx")
    assert "Exchange hashpartitioning" not in _plan(out)
