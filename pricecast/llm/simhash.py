"""SimHash near-duplicates by generalised pigeonhole search (operator 5).

A document's fingerprint is the majority, bit by bit, of the 64-bit hashes of its word shingles.
Fingerprints within ``max_bits`` differing bits link; components of links are groups.

Search (general pigeonhole): the 64 bits are cut into m parts; with thresholds t_1..t_m that sum
to ``max_bits - m + 1``, two fingerprints within ``max_bits`` lie within t_i in some part i
(t_i = -1: the part is not probed).

* Bits are grouped by correlation, from co-occurrence counts over all distinct fingerprints.
* Candidate counts per part and threshold are estimated from all fingerprints' distances to
  ``PIVOTS`` of them; dynamic programming finds the cheapest thresholds for each m, and the
  cheapest m is taken.
* Every fingerprint is filed under its own value of a probed part, and under the values within
  t_i of it; fingerprints that meet under a value are verified on all 64 bits.

Copies are collapsed first: the search sees each distinct fingerprint once. A value under which
many fingerprints meet is cut into blocks of ``BLOCK`` that meet pair by pair in separate tasks,
so no group is gathered whole. Tasks return a spanning forest of the links they verify, never
all pairs.

Defined cases: null and empty texts have no shingle and the fingerprint zero, which links like
any other; fewer words than the shingle length make one shingle; repeated rows share a
fingerprint; a null ``doc_id`` is ignored as a group's name (null if a group has no other);
an empty table gives no rows; other columns are not read, but by ``keep_one`` to tell rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricecast.llm.common import checkpoint, map_columns
from pricecast.llm.components import connected_components, spanning

SEED = 42
PIVOTS = 256
BLOCK = 1024
LAYOUTS = (2, 3, 4)
PROBE_COST = 20.0     # a filed row costs about as much as so many verified candidates

_SHIFT = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().lower().split()   # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        part = h[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << _SHIFT[ones * 2 > len(h)]).sum(dtype=np.uint64)) if (ones * 2 > len(h)).any() else 0


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) and the columns ``also`` for every row; fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()),
                           *(docs.schema[c] for c in also)])
    return map_columns(docs.select(id_col, text_col, *also),
                       lambda ids, texts, *more: {"doc_id": ids, "fp": [_signed(fingerprint(t, width)) for t in texts],
                                                  **dict(zip(also, more, strict=True))},
                       schema)


def _arrays(batches: Iterator[pa.RecordBatch], name: str = "fp") -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64x64 counts of bits set together, over all of them."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("i", "n")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for x in _arrays(batches):
            for at in range(0, len(x), 65536):
                bits = ((x[at:at + 65536, None] >> _SHIFT) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(4097)), "n": [n, *map(int, total.ravel())]}, schema=arrow)

    got = {r["i"]: r["n"] for r in fps.select("fp").mapInArrow(run, schema).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return got.get(0, 0), np.array([got.get(k + 1, 0) for k in range(4096)], dtype=float).reshape(64, 64)


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each grows by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        part = [first]
        left.discard(first)
        while len(part) < size:
            best = max(sorted(left), key=lambda b: corr[b, part].sum())
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def distance_counts(fps: DataFrame, pivots: list[int], masks: list[int], most: int) -> np.ndarray:
    """counts[k, d]: pairs (fingerprint, pivot) whose bits under masks[k] differ in d <= most places."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "n")])
    arrow = to_arrow_schema(schema)
    piv, msk = np.array(pivots, dtype=np.uint64), np.array(masks, dtype=np.uint64)

    def run(batches):
        out = np.zeros((len(msk), most + 1), dtype=np.int64)
        for x in _arrays(batches):
            for at in range(0, len(x), 16384):
                diff = x[at:at + 16384, None] ^ piv
                for k, mask in enumerate(msk):
                    out[k] += np.bincount(np.bitwise_count(diff & mask).ravel(), minlength=65)[:most + 1]
        yield pa.RecordBatch.from_pydict({"k": list(range(out.size)), "n": out.ravel().tolist()}, schema=arrow)

    got = fps.select("fp").mapInArrow(run, schema).groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(masks) * (most + 1))
    for r in got:
        out[r["k"]] = r["n"]
    return out.reshape(len(masks), most + 1)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Cheapest thresholds with the given sum; costs[i][t + 1] is part i's cost at threshold t >= -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for j, x in enumerate(row):
                key = s + j - 1
                if key not in nxt or c + x < nxt[key][0]:
                    nxt[key] = (c + x, [*ts, j - 1])
        best = nxt
    return best[total]


def plan(n: int, together: np.ndarray, counts, max_bits: int) -> tuple[list[int], list[int]]:
    """(masks, thresholds) of the cheapest layout; ``counts(masks)`` gives distance counts and pivots."""
    layouts = [[_mask(p) for p in group_bits(n, together, m)] for m in LAYOUTS if m <= max_bits + 1]
    seen, pivots = counts([x for masks in layouts for x in masks])
    at, best = 0, None
    for masks in layouts:
        costs = []
        for i, mask in enumerate(masks):
            width = mask.bit_count()
            near = (np.cumsum(seen[at + i]) + 0.5) / (max(n, 1) * max(pivots, 1) + 1.0)
            row = [0.0]
            for t in range(max_bits + 1):
                probes = sum(comb(width, d) for d in range(t + 1))
                row.append(PROBE_COST * n * probes + near[t] * n * n)
            costs.append(row)
        at += len(masks)
        cost, ts = allocate(costs, max_bits - len(masks) + 1)
        if best is None or cost < best[0]:
            best = (cost, masks, ts)
    return best[1], best[2]


def _flips(mask: int, most: int) -> list[int]:
    """All xor patterns of 1..most bits under ``mask``."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    out, level = [], [(0, 0)]
    for _ in range(most):
        level = [(v | bits[j], j + 1) for v, start in level for j in range(start, len(bits))]
        out += [v for v, _ in level]
    return out


def _filed(fps: DataFrame, masks: list[int], thresholds: list[int]) -> DataFrame:
    """(part, value, fp, probe): each fingerprint under its own and its probed values."""
    rows = []
    for k, (mask, t) in enumerate(zip(masks, thresholds, strict=True)):
        if t < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))
        rows.append(F.array(_entry(k, own, False)))
        flips = _flips(mask, t)
        if flips:
            rows.append(F.transform(F.array(*(F.lit(_signed(x)).cast("long") for x in flips)), _prober(k, own)))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("x")).select("x.part", "x.value", "fp", "x.probe")


def _entry(part: int, value: Column, probe: bool) -> Column:
    return F.struct(F.lit(part).alias("part"), value.alias("value"), F.lit(probe).alias("probe"))


def _prober(part: int, own: Column):
    # one parameter only: a second one would be given the position in the array
    return lambda flip: _entry(part, own.bitwiseXOR(flip), True)


def _verify(batches: Iterator[pa.RecordBatch], max_bits: int, keys: list[str], arrow: pa.Schema):
    """Spanning links of rows that lie together by ``keys``; rows come sorted by them."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table):
        cols = [t.column(k).to_numpy() for k in keys]
        fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        probe = t.column("probe").to_numpy(zero_copy_only=False).astype(bool)
        n = len(fp)
        new = np.ones(n, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        start = np.flatnonzero(new)
        end = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
        left, found_a, found_b, found = np.flatnonzero(np.arange(n) + 1 < end), [], [], 0
        d = 1
        while len(left):   # compare each row with the d-th after it in its group
            i, j = left, left + d
            ok = (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & ~(probe[i] & probe[j]) & (fp[i] != fp[j])
            if ok.any():
                found_a.append(fp[i[ok]].view(np.int64))
                found_b.append(fp[j[ok]].view(np.int64))
                found += int(ok.sum())
            d += 1
            left = left[left + d < end[left]]
            if found > 1_000_000:
                a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, found = [a], [b], 0
        if found_a:
            a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        last = [t.column(k)[t.num_rows - 1].as_py() for k in keys]
        cut = t.num_rows
        tail = np.logical_and.reduce([t.column(k).to_numpy() == v for k, v in zip(keys, last, strict=True)])
        cut = int(np.argmax(tail))    # the last group may go on in the next batch
        if cut:
            yield from work(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fps(fp)`` within ``max_bits``."""
    n, together = bit_counts(fps)
    pivots = [r["fp"] & ((1 << 64) - 1) for r in
              fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PIVOTS).collect()]
    masks, thresholds = plan(n, together, lambda ms: (distance_counts(fps, pivots, ms, max_bits), len(pivots)), max_bits)
    filed = _filed(fps, masks, thresholds)
    # values under which more than BLOCK rows meet: their rows meet block by block
    hot = (filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
           .select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    both = filed.join(hot, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp", "probe"), F.col("blocks")).cast("int")
    spread = (both.withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("part", "value", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                      "fp", "probe"))
    keys = ["part", "value", "x", "y"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])
    arrow = to_arrow_schema(schema)
    return (spread.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(lambda it: _verify(it, max_bits, keys, arrow), schema))


def _named(own: DataFrame, name: Column, max_bits: int) -> DataFrame:
    """(fp, name) for every distinct fp of ``own``: the smallest ``name`` in the fingerprint's group."""
    fps = checkpoint(own.groupBy("fp").agg(F.min(name).alias("first")))
    comps = connected_components(links(fps.select("fp"), max_bits))
    linked = fps.join(comps, fps["fp"] == comps["node"]).select("fp", "first", "component")
    names = linked.groupBy("component").agg(F.min("first").alias("id"))
    linked = linked.join(names, "component").select("fp", "id")
    return fps.join(linked, "fp", "left").select("fp", F.coalesce("id", "first").alias("name"))


def groups(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    own = checkpoint(fingerprints(docs, width, id_col, text_col))
    named = _named(own, F.col("doc_id"), max_bits)
    return own.join(named, "fp").select("doc_id", "fp", F.col("name").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of the smallest id (null ids last); same columns.

    Rows are told by 128 bits of hashes over all their columns, so equal ids of different texts
    are different documents, and a group without any id keeps a row too. Of one id's rows in a
    group, the one with the smallest hash of its text, then of the whole row, stays. A row with
    neither id nor text is no copy of any other; it stays once.
    """
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]   # a hash skips nulls
    keys = ("__row0", "__row1")
    parts = {"__text": F.xxhash64(F.col(f"`{text_col}`")), **{k: F.xxhash64(F.lit(i), *cells) for i, k in enumerate(keys)},
             "__bare": F.col(f"`{id_col}`").isNull() & F.col(f"`{text_col}`").isNull()}
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col))), *(v.alias(k) for k, v in parts.items()))
    own = checkpoint(fingerprints(rows, width, id_col, text_col, tuple(parts)))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "__bare", "doc_id", "__text", *keys)
    lost = (own.join(_named(own, name, max_bits), "fp")
            .where(~F.col("__bare") & ((F.col("__row0") != F.col("name.__row0")) | (F.col("__row1") != F.col("name.__row1")))))
    gone = checkpoint(lost.select(*(F.col(k).alias(f"__gone{k}") for k in keys)).distinct())
    marked = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(parts[k].alias(k) for k in keys))
    kept = marked.join(gone, [F.col(k) == F.col(f"__gone{k}") for k in keys], "left_anti")
    return kept.dropDuplicates(list(keys)).drop(*keys)
