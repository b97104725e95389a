"""S1/P1-P8/F1-F9/W8/W9 on hand-written dirty rows."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricecast.operators import clean, schema
from pricecast.sources import io as sio


def test_dirty_csv_coercion(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(
        " State ,Market,Modal Price,Arrival Date,report.xlsx\n"
        "TN,A,12.5,2026-02-10,x\nTN,A, 12.5 ,2026-02-30,x\nTN,A,\"1,200\",10/02/2026,x\n"
        "TN,A,N/A,,x\nTN,A,1d,2026-02-11,x\nTN,A,NaN,2026-02-12,x\nTN,A,,2026-02-13,x\n")
    raw = sio.read_raw(spark, str(p))
    assert all(t == "string" for _, t in raw.dtypes)
    df = clean.clean_observations(raw.withColumnRenamed("Arrival Date", "date"))
    assert "report.xlsx" not in df.columns and "arrival_date" in df.columns
    got = [(r["modal_price"], str(r["arrival_date"])) for r in df.orderBy("arrival_date").collect()]
    # only the first row has both a valid price and a valid date ("1,200", "1d",
    # "NaN", "N/A" and "" are not numbers; 2026-02-30 is not a date)
    assert got == [(12.5, "2026-02-10")]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "`Arrival  Date!` int, `Some Col` string, x double")
    assert schema.clean_cols(df).columns == ["arrival_date", "some_col", "x"]
    assert schema.normalize_cols(df).columns == ["arrival__date!", "some_col", "x"]
    with pytest.raises(ValueError, match="missing|Missing"):
        schema.require_cols(df, cols=["nope", "x"])
    assert schema.feature_columns(df, drop=["x"]) == ["Arrival  Date!"]
    al = schema.align_features(df, ["x", "y"]).collect()[0]
    assert (al["x"], al["y"]) == (2.0, 0)
    assert schema.alias_first(df.withColumnRenamed("x", "date")).columns[-1] == "arrival_date"


def test_min_group_rows_and_fill_from(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "k string, v double")
    assert clean.min_group_rows(df, ["k"], 2).count() == 2
    assert clean.min_group_rows(df, ["k"], 2, strict=True).count() == 0
    f = clean.fill_from(df.withColumn("o", F.lit(9.0)), "v", "o", "has_v").orderBy("k", "v")
    assert [(r["v"], r["has_v"]) for r in f.collect()] == [(1.0, 1), (9.0, 0), (3.0, 1)]
    assert clean.filter_positive(df.withColumn("v", F.lit(-1.0)), "v").count() == 0


def test_iqr_cap_and_median_fill_match_pandas(spark):
    data = [("g1", float(x)) for x in [1, 2, 3, 4, 100]] + [("g2", 5.0), ("g2", None)]
    df = spark.createDataFrame(data, "g string, v double")
    pdf = pd.DataFrame(data, columns=["g", "v"])

    def cap(s):
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        return s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    exp = pdf.groupby("g")["v"].transform(cap)
    got = clean.iqr_cap(df, ["g"], "v").toPandas()
    m = pdf.assign(e=exp).merge(got, on="g", suffixes=("", "_got"))
    assert sorted(got["v"].dropna()) == sorted(exp.dropna())
    filled = clean.fill_group_median(df, ["g"], ["v"]).toPandas()
    assert filled["v"].isna().sum() == 0 and 5.0 in set(filled["v"])
    assert len(m) > 0


def test_load_table_and_model_persistence(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "x double, y double")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS t_{tmp_path.name} LOCATION '{tmp_path}/db'")
    name = f"t_{tmp_path.name}.obs"
    sio.load_table(df, name, if_exists="replace")
    sio.load_table(df, name, if_exists="append")
    assert spark.table(name).count() == 6
    with pytest.raises(Exception):
        sio.load_table(df, name, if_exists="fail")
    with pytest.raises(ValueError):
        sio.load_table(df, name, if_exists="merge")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    sio.save_model(pipe, f"{tmp_path}/m/q50", ["x"])
    got = sio.load_models(f"{tmp_path}/m", ["q50"], PipelineModel)
    assert got["q50_features"] == ["x"]
    with pytest.raises(FileNotFoundError, match="q10/model"):
        sio.load_models(f"{tmp_path}/m", ["q50", "q10"], PipelineModel)
