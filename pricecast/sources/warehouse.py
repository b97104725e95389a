"""S3 without a database: a batch writer that loads a table all or nothing.

A table is a folder on storage that all tasks and the driver share; its loads are subfolders of
Parquet files. Every task writes its rows in batches of ``batchsize`` (a Parquet row group each) into
the load's staging folder; when all have, the driver renames that folder into the table, which is the
commit. A failed task or driver leaves the table as it was. ``replace`` starts the table anew at its
load (earlier loads stay on the storage until they are cleared away), ``append`` adds one, ``fail``
is refused if the table holds any load, before a row is written and again at the commit.

Reading is Spark's own Parquet scan over the loads in force, with its pruning and push-down.

Defined cases: an empty frame makes an empty load, which counts as a table; a repeated attempt of a
task writes its own file, and files that no committed attempt names are deleted before the rename;
a load must have the columns of the table that it is appended to, by name and type, in any order;
two loads that commit at once need storage whose rename fails on an existing folder (a distributed
or local file system; not an object store), and the later one tries the next number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

IF_EXISTS = ("replace", "append", "fail")


@dataclass
class Written(WriterCommitMessage):
    """A task's file, its rows and batches."""
    file: str
    rows: int
    batches: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def loads(path: str) -> list[str]:
    """Folder names of the loads in force, oldest first: the last replacing one and those after it."""
    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/loads", allow_not_found=True))
    names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
    starts = [k for k, n in enumerate(names) if n.split("-")[1] == "replace"]
    return names[starts[-1]:] if starts else names


class LoadWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str, if_exists: str, batchsize: int):
        self.schema, self.path, self.if_exists, self.batchsize = schema, path, if_exists, batchsize
        self.load = uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/staging/{self.load}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        arrow, rows, batches = to_arrow_schema(self.schema), 0, 0
        store.create_dir(self._staging(base), recursive=True)
        with store.open_output_stream(f"{self._staging(base)}/{name}") as sink, pq.ParquetWriter(sink, arrow) as out:
            held: list[pa.RecordBatch] = []
            waiting = 0

            def flush(size: int) -> None:
                nonlocal held, waiting, rows, batches
                whole = pa.Table.from_batches(held, schema=arrow)
                out.write_table(whole.slice(0, size), row_group_size=size)
                rest = whole.slice(size)
                held, waiting, rows, batches = rest.to_batches(), rest.num_rows, rows + size, batches + 1

            for b in iterator:
                held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow, strict=True)], schema=arrow))
                waiting += b.num_rows
                while waiting >= self.batchsize:
                    flush(self.batchsize)
            if waiting:
                flush(waiting)
        return Written(name, rows, batches)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        staging, known = self._staging(base), {m.file for m in messages if m}
        store.create_dir(staging, recursive=True)
        for info in store.get_file_info(fs.FileSelector(staging)):
            if info.base_name not in known:
                store.delete_file(info.path)
        with store.open_output_stream(f"{staging}/_load.json") as out:
            out.write(json.dumps({"schema": self.schema.jsonValue(), "rows": sum(m.rows for m in messages if m),
                                  "batches": sum(m.batches for m in messages if m)}).encode())
        store.create_dir(f"{base}/loads", recursive=True)
        while True:
            there = store.get_file_info(fs.FileSelector(f"{base}/loads"))
            if there and self.if_exists == "fail":
                self.abort(messages)
                raise FileExistsError(f"table {self.path} exists")
            number = 1 + max((int(i.base_name.split("-")[0]) for i in there), default=0)
            kind = "append" if self.if_exists == "append" else "replace"
            try:
                store.move(staging, f"{base}/loads/{number:09d}-{kind}")
                return
            except OSError:
                # another load took the number; anything else is a failure of the storage
                if store.get_file_info(f"{base}/loads/{number:09d}-{kind}").type == fs.FileType.NotFound:
                    raise

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        if store.get_file_info(self._staging(base)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(base))


class LoadSource(DataSource):
    """``df.write.format("pricecast_load")`` with the options path, if_exists and batchsize."""

    @classmethod
    def name(cls) -> str:
        return "pricecast_load"

    def writer(self, schema: StructType, overwrite: bool) -> LoadWriter:
        return LoadWriter(schema, self.options["path"], self.options["if_exists"], int(self.options["batchsize"]))


def table_schema(path: str) -> StructType | None:
    """Columns of the table's loads in force; None if there is no table."""
    store, base = _store(path)
    if not (names := loads(path)):
        return None
    with store.open_input_stream(f"{base}/loads/{names[0]}/_load.json") as f:
        return StructType.fromJson(json.loads(f.read())["schema"])


def load(df: DataFrame, path: str, if_exists: str = "fail", batchsize: int = 5000) -> None:
    """S3: load ``df`` into the table at ``path``, all or nothing."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {sorted(IF_EXISTS)}")
    if batchsize < 1:
        raise ValueError("batchsize must be positive")
    there = table_schema(path)
    if there is not None and if_exists == "fail":
        raise FileExistsError(f"table {path} exists")
    if there is not None and if_exists == "append":
        mine = {f.name: f.dataType for f in df.schema}
        if mine != {f.name: f.dataType for f in there}:
            raise ValueError(f"the table has other columns: {there.simpleString()}")
        df = df.select(*(f"`{f.name}`" for f in there))
    df.sparkSession.dataSource.register(LoadSource)
    (df.write.format(LoadSource.name()).mode("append").option("path", path).option("if_exists", if_exists)
       .option("batchsize", str(batchsize)).save())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows: the loads in force, by Spark's Parquet scan."""
    names, schema = loads(path), table_schema(path)
    if schema is None:
        raise FileNotFoundError(f"no table {path}")
    return spark.read.schema(schema).parquet(*(f"{path}/loads/{n}" for n in names))
