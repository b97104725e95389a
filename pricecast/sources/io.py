"""Sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecast.sources import warehouse

# The reference's ``if_exists`` words and the Spark save modes.
IF_EXISTS = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read an observation file.

    CSV is read with a header and *every column as STRING* (no
    ``inferSchema``: that would be a second pass over the data); coercion
    is done explicitly afterwards (``clean.coerce_*``). Parquet keeps its
    own types.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        return spark.read.parquet(path)
    return (spark.read.option("header", True).option("inferSchema", False)
                 .option("mode", "PERMISSIVE").option("multiLine", False).csv(path))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a stage output (Parquet by default, optionally partitioned)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def load_table(df: DataFrame, table: str, if_exists: str = "fail", batchsize: int = 5000,
               jdbc_url: str | None = None, properties: dict | None = None, folder: str | None = None) -> None:
    """S3: load into a warehouse table.

    ``if_exists`` replace/append/fail maps to overwrite/append/errorifexists.
    With ``folder`` the table is ``{folder}/{table}`` and a load is all or
    nothing, in batches of ``batchsize`` (``warehouse.load``). With ``jdbc_url``
    the rows go through the JDBC writer in batches of ``batchsize`` (executors
    write in parallel, one connection per task); a JDBC load that fails midway
    keeps what its finished tasks wrote. Otherwise into a catalog table
    (``saveAsTable``).
    """
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {sorted(IF_EXISTS)}")
    if folder and jdbc_url:
        raise ValueError("either folder or jdbc_url")
    mode = IF_EXISTS[if_exists]
    if folder:
        warehouse.load(df, f"{folder.rstrip('/')}/{table}", if_exists, batchsize)
    elif jdbc_url:
        props = dict(properties or {})
        props.setdefault("batchsize", str(batchsize))
        df.write.jdbc(jdbc_url, table, mode=mode, properties=props)
    else:
        df.write.mode(mode).saveAsTable(table)


def write_predictions(df: DataFrame, path: str, cols=("y_true", "p10", "p50", "p90"),
                      fmt: str = "parquet") -> None:
    """Interval predictions."""
    write_stage(df.select(*cols), path, fmt=fmt)


def to_json_column(df: DataFrame, name: str = "json") -> DataFrame:
    """S6 (per row): the whole row as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def export_json(df: DataFrame, path: str) -> None:
    """Forecast rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_model(model, path: str, feature_cols: list[str]) -> None:
    """Persist an MLlib model plus its ordered feature list."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(list(feature_cols)),)], "features string")\
        .coalesce(1).write.mode("overwrite").json(f"{path}/features")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_models(base: str, names: list[str], loader) -> dict:
    """Load several saved models; fail listing every missing piece.

    ``loader`` is the MLlib model class (e.g. ``PipelineModel``). Only a path
    that is not there counts as missing; other failures to load are raised.
    """
    spark = SparkSession.getActiveSession()
    out, missing = {}, []
    for n in names:
        absent = [part for part in ("model", "features") if not _exists(spark, f"{base}/{n}/{part}")]
        if absent:
            missing += [f"{n}/{part}" for part in absent]
            continue
        out[n] = loader.load(f"{base}/{n}/model")
        row = spark.read.json(f"{base}/{n}/features").first()
        out[f"{n}_features"] = json.loads(row["features"])
    if missing:
        raise FileNotFoundError(f"Missing model artifacts: {missing}")
    return out
