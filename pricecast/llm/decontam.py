"""Benchmark decontamination by a stored, distributed positional inverted index (operator 8).

* The benchmark is cut into windows (a run of ``width`` words, or a shorter item's all words); its
  distinct words are numbered in a written dictionary.
* ``index`` writes the documents' postings, one row (term, document key, position) per word that the
  dictionary knows, sorted by term. A bitmap of fixed size (``SIEVE`` bits, from word checksums)
  keeps most other words from leaving the tokenizer; the join with the dictionary is exact.
* Terms are counted once over the whole index. Every window takes the list of its globally rarest
  term, shifted by the term's offset, and intersects it with the shifted list of its second rarest
  and then of all its other terms, by equi-joins on (document, term, position). What is left are
  exact phrase matches; the same joins on position ranges of ``2 * slop + 1`` give proximity matches:
  every term within ``slop`` positions of its place beside the rarest.

No benchmark row reaches the driver, only the bitmap. Lists are never gathered: a frequent term or a
common passage is many rows, which joins and counts spread, and adaptive execution may split. The
tables that grow with the benchmark or the matches are written before they are joined, so their size
decides for a broadcast. Postings are cut to the asked terms, and to the documents that still have a candidate,
before they are moved. A document's key is two 64-bit hashes of id and text: rows that share it (repeated rows)
have the same words and share their result.

Defined cases: null and empty texts have no words and are never hit; items without words are
ignored; items with a null id hit words but are not listed; equal item ids count once; repeated
document rows are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricecast.llm.common import CHUNK_ROWS, append_columns, checkpoint, fresh_name, map_columns

WIDTH = 10            # at most 62
SLOP = 5
SIEVE = 1 << 24       # bits
BATCH = 50_000        # rows of one output batch

#: A-Z to lower case; 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F part words; the rest, and all of UTF-8, stays.
_TABLE = bytes(0x20 if (c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F)
               else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


KEY = ["k1", "k2"]
WINDOWS = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.StringType())])
WORDS = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("word", T.StringType()),
                      T.StructField("pos", T.IntegerType())])


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(docs[id_col], docs[text_col]), F.xxhash64(F.lit("second"), docs[text_col], docs[id_col])]


def _texts(found: list[bytes]) -> pa.Array:
    """Words are cut at ASCII characters, so they are UTF-8 as the text was."""
    return pa.array(found, pa.binary()).cast(pa.string())


def _spread(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[list[pa.Array]]], schema: T.StructType) -> DataFrame:
    """``df`` through a generator of column lists."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):     # few texts are Python objects at a time
                for columns in rows(batch.slice(at, CHUNK_ROWS)):
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window) pairs, each once; a window is its words, joined by spaces."""
    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for name, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
            ws = words(text)
            n = min(width, len(ws))
            for at in range(0, len(ws) - n + 1 if ws else 0, BATCH // width):
                own = [b" ".join(ws[k:k + n]) for k in range(at, min(at + BATCH // width, len(ws) - n + 1))]
                yield [pa.array([name] * len(own), pa.string()), _texts(own)]

    own = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return _spread(own, rows, WINDOWS).distinct()


def sieve(dictionary: DataFrame) -> bytes:
    """``SIEVE`` bits, set where a term's checksum falls."""
    at = (F.crc32("word") % SIEVE) + 1
    parts = (dictionary.groupBy(F.bitmap_bucket_number(at).alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
    out = np.zeros((SIEVE // 32768, 4096), dtype=np.uint8)
    for r in parts:
        out[r["b"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.tobytes()


@lru_cache(maxsize=1)
def _opened(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little").view(bool)


def index(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (tid, k1, k2, pos) of the dictionary's terms, a written table sorted by term."""
    packed = sieve(dictionary)

    def rows(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        known = _opened(packed)
        held: list[tuple] = []

        def out() -> list[pa.Array]:
            counts = [len(x[2]) for x in held]
            return [pa.array(np.repeat([x[0] for x in held], counts).astype(np.int64)), pa.array(np.repeat([x[1] for x in held], counts).astype(np.int64)),
                    _texts([w for x in held for w in x[2]]), pa.array(np.concatenate([x[3] for x in held]).astype(np.int32))]

        size = 0
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "t")), strict=True):
            ws = words(text)
            if not ws:
                continue
            sums = np.fromiter(map(crc32, ws), dtype=np.uint32, count=len(ws))
            at = np.flatnonzero(known[sums & np.uint32(SIEVE - 1)])
            for cut in range(0, len(at), BATCH):
                part = at[cut:cut + BATCH]
                held.append((k1, k2, [ws[i] for i in part.tolist()], part))
                size += len(part)
                if size >= BATCH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    k1, k2 = _keys(docs, id_col, text_col)
    found = _spread(docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("t")), rows, WORDS)
    return checkpoint(found.join(dictionary, "word").select("tid", "k1", "k2", "pos").sortWithinPartitions("tid"))


def _met(postings: DataFrame, found: DataFrame, plans: DataFrame, first: int, last: int, slop: int) -> DataFrame:
    """Candidates of ``found`` (k1, k2, wid, start, exact) that meet their terms ``first`` to ``last``, by rarity; written."""
    need = found.join(plans, "wid").where(F.col("n") > first)
    want = F.least(F.col("n"), F.lit(last)) - first
    need = need.select(*KEY, "wid", "start", "exact", want.alias("want"), F.inline(F.slice("t", first + 1, last - first)))
    need = need.withColumn("place", F.col("start") + F.col("off"))
    wide = 2 * slop + 1
    ranges = F.array_distinct(F.array(F.floor((F.col("place") - slop) / wide), F.floor((F.col("place") + slop) / wide)))
    need = need.withColumn("range", F.explode(ranges))
    # the lists of these terms alone; once the two rarest have met, in the documents that still have a candidate
    asked = plans.where(F.col("n") > first).select(F.explode(F.slice("t", first + 1, last - first)["tid"]).alias("tid")).distinct()
    few = postings.join(checkpoint(asked), "tid", "left_semi").withColumn("range", F.floor(F.col("pos") / wide))
    if first > 1:
        few = few.join(checkpoint(found.select(*KEY).distinct()), KEY, "left_semi")
    hit = need.join(few, [*KEY, "tid", "range"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
    bit = F.expr("shiftleft(1L, off)")
    met = hit.groupBy(*KEY, "wid", "start", "exact", "want").agg(
        F.bit_or(bit).alias("near"), F.bit_or(F.when(F.col("pos") == F.col("place"), bit)).alias("at"))
    met = met.where(F.bit_count("near") == F.col("want"))
    met = met.select(*KEY, "wid", "start", (F.col("exact") & (F.coalesce(F.bit_count("at"), F.lit(0)) == F.col("want"))).alias("exact"))
    done = found.join(plans.where(F.col("n") <= first).select("wid"), "wid", "left_semi").select(met.columns)
    return checkpoint(met.unionByName(done))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(k1, k2, ranges, items, near_items) of every document key with a match: hit word ranges, end exclusive, merged; written."""
    pairs = checkpoint(windows(benchmark, width))
    wins = checkpoint(pairs.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()))
    listed = checkpoint(pairs.join(wins, "window").select("wid", "item"))
    terms = wins.select("wid", F.posexplode(F.split("window", " ")).alias("off", "word"))
    dictionary = checkpoint(terms.select("word").distinct().withColumn("tid", F.monotonically_increasing_id()))
    postings = index(docs, dictionary, id_col, text_col)
    rarity = checkpoint(postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df")))
    known = terms.join(dictionary, "word").join(rarity, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    plans = known.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("df", "off", "tid"))).alias("t"))
    plans = checkpoint(plans.where(F.col("t")[0]["df"] > 0).select("wid", F.size("t").alias("n"), "t"))
    rarest = plans.select("wid", F.col("t")[0]["tid"].alias("tid"), F.col("t")[0]["off"].alias("off"))
    found = postings.join(rarest, "tid").select(*KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), F.lit(True).alias("exact"))
    found = checkpoint((found if slop else found.where(F.col("start") >= 0)).distinct())
    found = _met(postings, found, plans, 1, 2, slop)
    found = _met(postings, found, plans, 2, width, slop)
    named = found.join(listed, "wid").groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sort_array(F.collect_set("item")).alias("near_items"))
    spans = found.where(F.col("exact")).join(plans.select("wid", "n"), "wid").groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    along = Window.partitionBy(*KEY).orderBy("start")
    opens = F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(along))
    spans = spans.groupBy(*KEY, "_run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    ranges = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.array(F.col("a").cast("long"), F.col("b").cast("long")))).alias("ranges"))
    return checkpoint(named.join(ranges, KEY, "left"))


def _attached(docs: DataFrame, found: DataFrame, keys: list[Column], names: dict[str, str]) -> DataFrame:
    """``docs`` with what was found under its key; ``names`` maps ranges, items and near_items to fresh names."""
    k1, k2 = (fresh_name(docs, f"dc_{k}") for k in KEY)
    side = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), *[F.col(c).alias(n) for c, n in names.items()])
    j = docs.withColumns({k1: keys[0], k2: keys[1]}).join(side, [k1, k2], "left").drop(k1, k2)
    return j.withColumns({n: F.coalesce(F.col(n), F.array().cast(side.schema[n].dataType)) for n in names.values()})


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, id_col: str = "doc_id",
         text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n_words, ranges (hit word ranges, end exclusive), items and near_items added.

    Returns the frame and the names the columns got.
    """
    names = {k: fresh_name(docs, f"dc_{k}") for k in ("n_words", "ranges", "items", "near_items")}
    found = matches(docs, benchmark, width, slop, id_col, text_col)
    out = _attached(docs, found, _keys(docs, id_col, text_col), {k: names[k] for k in ("ranges", "items", "near_items")})
    return append_columns(out, [text_col], lambda texts: [[len(words(t)) for t in texts]], [T.StructField(names["n_words"], T.LongType())]), names


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """One row per document: word, hit and item counts, the digest of the items, contaminated."""
    docs = docs.select("doc_id", "text")
    found = matches(docs, benchmark, width, slop)
    k1, k2 = _keys(docs, "doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("k1", T.LongType()),
                           T.StructField("k2", T.LongType()), T.StructField("n_words", T.LongType())])
    counted = map_columns(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text"),
                          lambda i, a, b, t: {"doc_id": i, "k1": a, "k2": b, "n_words": [len(words(x)) for x in t]}, schema)
    names = {k: k for k in ("ranges", "items", "near_items")}
    got = _attached(counted, found, [F.col("k1"), F.col("k2")], names)
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                      F.size("near_items").cast("long").alias("n_near_items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; same columns."""
    found = matches(docs, benchmark, width, 0, id_col, text_col)
    k1, k2 = (fresh_name(docs, f"dc_{k}") for k in KEY)
    a, b = _keys(docs, id_col, text_col)
    hit = found.where(F.size("ranges") > 0).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    return docs.withColumns({k1: a, k2: b}).join(hit, [k1, k2], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
