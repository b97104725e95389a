"""Embedding near-duplicates by an exact metric range join (operator 2).

Vectors of one label are compared by cosine; on unit vectors, cosine >= c means a chord of at
most r = sqrt(2 - 2c), a metric. Pivots cut the space into cells (a vector's home is its nearest
pivot p). By the triangle inequality a vector within r of x cannot live in the cell of q if
d(x, q) - d(x, p) > 2r; x visits the other cells only. Cells join independently.

* Equal vectors of a label are collapsed first, so one very common vector costs one.
* A cell with more than ``CHUNK`` residents is dealt into chunks; a vector visits the chunks that
  come after its own in a fixed order, so every pair meets in one task exactly once.
* In a task, the residents are compared with each other and with the visitors, block by block;
  pairs whose distances to the pivot differ by more than r are cut before the cosine counts.
* Tasks return per vector the number of links they saw and a spanning forest of the links, never
  the pairs. Components are joined in Spark.

Defined cases: a null label, a null, empty or zero vector, or one with null or non-finite
components links with nothing; vectors of different lengths do not link; equal vectors of a
label link with each other; repeated rows count as vectors of their own; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricecast.llm.common import checkpoint, map_columns
from pricecast.llm.components import connected_components, spanning

PIVOTS = 16
LENGTHS = 64          # so many vector lengths, the commonest, get pivots; the others' cell is the whole length
CHUNK = 2048
EDGE = 1e-9           # cosines this near the threshold are computed again, one by one


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision, or None if it can't link."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    big = np.abs(v).max()
    if big == 0:
        return None
    v = v / big
    return v / math.sqrt(float(v @ v))


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, key, unit): key is a digest of the exact components, null if it can't link."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("key", T.StringType()), T.StructField("unit", T.BinaryType())])

    def run(ids, vecs, labels):
        units = [None if lab is None else unit(v) for v, lab in zip(vecs, labels, strict=True)]
        keys = [None if u is None else md5((np.array(v, dtype=np.float64) + 0.0).tobytes()).hexdigest()
                for u, v in zip(units, vecs, strict=True)]
        return {"vec_id": ids, "label": labels, "key": keys, "unit": [None if u is None else u.tobytes() for u in units]}

    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec_col, F.col(label_col).cast("string").alias("label"))
    return map_columns(own, run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _pivots(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a length; without any, the origin, from which all unit vectors are one away."""
    return pivots[dim] if dim in pivots else np.zeros((1, dim))


def _homes(reps: DataFrame, pivots: dict[int, np.ndarray], r: float) -> DataFrame:
    """reps with dim, home cell, distance to its pivot, and the cells it must be compared in."""
    schema = T.StructType([*reps.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("cells", T.ArrayType(T.IntegerType()))])
    names = reps.columns

    def run(*cols):
        out = dict(zip(names, cols, strict=True)) | {"dim": [], "cell": [], "cells": []}
        for raw in out["unit"]:
            v = np.frombuffer(raw, dtype=np.float64)
            d = np.linalg.norm(_pivots(pivots, len(v)) - v, axis=1)
            home = int(d.argmin())
            out["dim"].append(len(v))
            out["cell"].append(home)
            out["cells"].append(np.flatnonzero(d - d[home] <= 2 * r + 1e-9).tolist())
        return out

    return map_columns(reps, run, schema)


def _compare(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix of cosine >= least."""
    cos = a @ b.T
    ok = cos >= least
    for i, j in np.argwhere(np.abs(cos - least) < EDGE):
        x, y = a[i], b[j]
        ok[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= least
    return ok


class _Cell:
    """Residents of one chunk, their links so far and a union-find over them."""

    def __init__(self):
        self.ids: list[int] = []
        self.units: list[np.ndarray] = []
        self.root: dict[int, int] = {}
        self.links: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = self.root.get(self.root[x], self.root[x])
            x = self.root[x]
        return x

    def meet(self, ids: list[int], units: np.ndarray, copies: np.ndarray, resident: bool, pivot: np.ndarray,
             least: float, r: float) -> None:
        gap = np.linalg.norm(units - pivot, axis=1)
        for mine, mine_units, mine_copies, mine_gap in self.units:
            near = np.abs(mine_gap[:, None] - gap[None, :]) <= r + 1e-9
            if near.any():
                self._link(mine, mine_copies, ids, copies, _compare(mine_units, units, least) & near)
        if resident:
            self._link(ids, copies, ids, copies, np.triu(_compare(units, units, least), 1))
            self.units.append((ids, units, copies, gap))

    def _link(self, ids_a, copies_a, ids_b, copies_b, ok) -> None:
        for ids, n in ((ids_a, ok @ copies_b), (ids_b, ok.T @ copies_a)):
            for k in np.flatnonzero(n):
                self.links[ids[k]] = self.links.get(ids[k], 0) + int(n[k])
        i, j = np.nonzero(ok)
        if not len(i):
            return
        for x, y in zip(*spanning(np.asarray(ids_a)[i], np.asarray(ids_b)[j]), strict=True):
            x, y = self.find(int(x)), self.find(int(y))
            if x != y:
                self.root[max(x, y)] = min(x, y)


def _cells(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], least: float, r: float, arrow: pa.Schema):
    """Stream of (rep, links, root) from rows sorted by cell and chunk, residents first."""
    key, cell = None, _Cell()

    def done():
        ids = sorted(cell.links)
        if ids:
            yield pa.RecordBatch.from_pydict({"rep": ids, "links": [cell.links[i] for i in ids],
                                              "root": [cell.find(i) for i in ids]}, schema=arrow)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in ("label", "dim", "cell", "chunk", "visitor")]
        marks = list(zip(*cols, strict=True))
        at = 0
        while at < len(marks):
            end = at
            while end < len(marks) and end - at < 1024 and marks[end] == marks[at]:
                end += 1
            if marks[at][:4] != key:
                yield from done()
                key, cell = marks[at][:4], _Cell()
            part = batch.slice(at, end - at)
            cell.meet(part.column("rep").to_pylist(), _matrix(part.column("unit")),
                      np.array(part.column("copies").to_pylist(), dtype=np.int64), not marks[at][4],
                      _pivots(pivots, key[1])[key[2]], least, r)
            at = end
    yield from done()


def join(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    r = math.sqrt(2 - 2 * least)
    own = checkpoint(_prepared(vectors, id_col, vec_col, label_col))
    reps = (own.where(F.col("key").isNotNull()).groupBy("label", "key")
            .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    reps = checkpoint(reps)
    # pivots: for each of the commonest vector lengths, the first rep of each of PIVOTS classes by hash
    size, h = F.length("unit"), F.xxhash64("rep")
    lengths = [x["n"] for x in reps.groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect() if x["n"]]
    first = (reps.where(size.isin(lengths)).groupBy(size.alias("n"), F.pmod(h, F.lit(PIVOTS)).alias("class"))
             .agg(F.min_by("unit", F.struct(h, "rep")).alias("unit")).orderBy("n", "class").collect())
    pivots = {n // 8: _matrix(pa.array([x["unit"] for x in first if x["n"] == n])) for n in lengths}
    homes = checkpoint(_homes(reps, pivots, r))
    keys = ["label", "dim", "cell"]
    sizes = homes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = (homes.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
             .select("rep", "copies", "unit", *keys, "chunk", "cells"))
    stay = dealt.select("rep", "copies", "unit", *keys, "chunk", F.lit(False).alias("visitor"))
    there = sizes.select("label", "dim", F.col("cell").alias("there"), "chunks")
    visit = (dealt.withColumn("there", F.explode("cells")).join(there, ["label", "dim", "there"])
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .where((F.col("there") > F.col("cell")) | ((F.col("there") == F.col("cell")) & (F.col("other") > F.col("chunk"))))
             .select("rep", "copies", "unit", "label", "dim", F.col("there").alias("cell"), F.col("other").alias("chunk"),
                     F.lit(True).alias("visitor")))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("rep", "links", "root")])
    arrow = to_arrow_schema(schema)
    place = [*keys, "chunk"]
    found = checkpoint(stay.unionByName(visit).repartition(*place).sortWithinPartitions(*place, "visitor")
                       .mapInArrow(lambda it: _cells(it, pivots, least, r, arrow), schema))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (reps.select("label", "key", "rep", "copies").join(links, "rep", "left")
             .join(comps, F.col("rep") == F.col("node"), "left")
             .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("component", "rep").alias("c")))
    return (own.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("c", "vec_id").alias("component_id"),
                    (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept")))
