"""S3: loads are whole or not there; replace, append and fail; batches."""
import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pricecast.sources import warehouse as wh
from tests.conftest import rows


@pytest.fixture()
def df(spark):
    return spark.range(23).repartition(3).select(
        "id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("name"), F.lit("2020-01-02").cast("date").alias("day"),
        F.to_timestamp(F.lit("2020-01-02 03:04:05.678")).alias("at"), (F.col("id") / 7).alias("price"), F.array("id").alias("list"))


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


def failing(df):
    """Its tasks write rows, and the last row fails."""
    return df.withColumn("price", F.when(F.col("id") == 22, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("price")))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_replace_append_fail(spark, df, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/t"
    wh.load(df, path, "fail")
    assert rows(wh.read(spark, path)) == rows(df) and wh.read(spark, path).schema.simpleString() == df.schema.simpleString()
    wh.load(df.select(*reversed(df.columns)), path, "append")
    assert rows(wh.read(spark, path)) == sorted(rows(df) * 2)
    with pytest.raises(FileExistsError):
        wh.load(df, path, "fail")
    wh.load(df.where("id < 5"), path, "replace")
    assert rows(wh.read(spark, path)) == rows(df.where("id < 5"))
    wh.load(df.where("id >= 5"), path, "append")
    assert rows(wh.read(spark, path)) == rows(df)


def test_a_failed_task_leaves_the_table_as_it_was(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(Exception, match="broken row"):
        wh.load(failing(df), path, "fail")
    assert wh.loads(path) == [] and files(tmp_path) == []
    wh.load(df, path, "fail")
    before = files(tmp_path)
    for how in ("append", "replace"):
        with pytest.raises(Exception, match="broken row"):
            wh.load(failing(df), path, how)
        assert files(tmp_path) == before and rows(wh.read(spark, path)) == rows(df)


def test_batches(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    wh.load(df.coalesce(1), path, "fail", batchsize=5)
    (part,) = Path(path).rglob("*.parquet")
    groups = pq.ParquetFile(part).metadata
    assert [groups.row_group(k).num_rows for k in range(groups.num_row_groups)] == [5, 5, 5, 5, 3]
    (head,) = Path(path).rglob("_load.json")
    told = json.loads(head.read_text())
    assert (told["rows"], told["batches"]) == (23, 5)


def test_files_of_lost_attempts_are_not_loaded(spark, df, tmp_path):
    w = wh.LoadWriter(df.schema, f"{tmp_path}/t", "append", 5000)
    staging = tmp_path / "t" / "staging" / w.load
    staging.mkdir(parents=True)
    (staging / "part-000000-7.parquet").write_bytes(b"half a file")
    w.commit([None])
    assert rows(wh.read(spark, f"{tmp_path}/t")) == []


def test_a_load_that_comes_second_is_refused_at_the_commit(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    late = wh.LoadWriter(df.schema, path, "fail", 5000)
    wh.load(df, path, "fail")
    with pytest.raises(FileExistsError):
        late.commit([])
    assert rows(wh.read(spark, path)) == rows(df) and not any("staging" in f for f in files(path))


def test_defined_cases(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        wh.read(spark, path)
    wh.load(df.where("false"), path, "append")
    assert wh.read(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        wh.load(df, path, "fail")
    for other in (df.drop("name"), df.withColumn("price", F.col("id")), df.withColumn("extra", F.lit(1))):
        with pytest.raises(ValueError, match="other columns"):
            wh.load(other, path, "append")
    for bad in ({"if_exists": "overwrite"}, {"batchsize": 0}):
        with pytest.raises(ValueError):
            wh.load(df, path, **bad)


def test_reading_prunes_and_pushes_down(spark, df, tmp_path):
    path = f"{tmp_path}/t"
    wh.load(df, path)
    plan = wh.read(spark, path).where("id > 20").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,20)" in plan and "ReadSchema: struct<id:bigint,name:string>" in plan
