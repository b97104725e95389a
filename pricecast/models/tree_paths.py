"""M8 on boosted trees: exact path-based Shapley values of any number of rows, no sampling.

A tree is read as its leaves' paths. A path names each feature once, with the range of bins that
leads to the leaf and a weight: the share of the background rows at the path's nodes on that feature
that go the path's way (counted in one pass over the background, however large). A feature set S is
worth what the trees give on average if a row's own values decide at the features of S and the
background's shares at the others; Shapley values share the difference between all features and none.

In a path the worth is a product over its features, so a feature's value is the integral over t in
[0, 1] of the other features' product of ``weight * (1 - t) + own * t``; it is a polynomial in t, and
a Gauss rule of half its degree is exact. Per row the values add up to the prediction less the
background's mean prediction.

A row enters a path's worth only by one bit per feature: whether its own value goes the path's way. So
the values of a leaf are a table over these bits, and those of neighbouring leaves one table over the bits
of their common path and of the decisions below it (``tree_parts``). A row's values are then looked up, a few
hundred numbers a tree, instead of integrated anew; paths of too many features for a table are integrated.

Rows are explained where they lie, in one Arrow pass with the model's paths (bounded by trees and
leaves); a tree's tables last while it explains the rows held, and nothing is shuffled but the leaf counts,
one row per (task, tree, leaf).

Defined cases: a node that no background row reaches halves its weight; a tree without a cut gives
nothing to any feature; null and NaN features go right, as in the model; an empty table explains to
an empty one; repeated rows get equal values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricecast.models.hist_trees import Model, Tree

BLOCK = 128     # rows integrated at a time: bounds the memory of (row, leaf, feature) tables
BITS = 10       # features of a path and decisions below it that index one table, at most
HELD_ROWS = 65_536      # rows explained by a tree's tables before these are dropped
AT_ONCE = 8192  # rows looked up at a time: their codes stay in the processor's cache

LEAVES = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("rows", T.LongType())])


@dataclass
class Paths:
    """The paths of one tree, [leaf, place]: feature (-1: unused place), bins in (low, high], weight; value and node per leaf."""
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray
    value: np.ndarray
    node: np.ndarray

    def of(self, leaves: np.ndarray) -> Paths:
        return Paths(*(getattr(self, f.name)[leaves] for f in fields(self)))


def leaf_counts(model: Model, background: DataFrame, spec: int = 0) -> list[np.ndarray]:
    """Background rows per node of every tree of a spec: leaves counted in one pass, inner nodes their children's sum."""
    trees, arrow = model.trees[spec], to_arrow_schema(LEAVES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(t.size, dtype=np.int64) for t in trees]
        for b in batches:
            x = model.bins([b.column(c).to_numpy(zero_copy_only=False) for c in model.feats])
            for s, t in zip(sums, trees, strict=True):
                s += np.bincount(t.node(x), minlength=t.size)
        hit = [(k, int(n), int(s[n])) for k, s in enumerate(sums) for n in np.flatnonzero(s)]
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], f.type) for i, f in enumerate(arrow)], schema=arrow)

    got = _features(background, model).mapInArrow(count, LEAVES).groupBy("tree", "node").agg(F.sum("rows").alias("rows"))
    out = [np.zeros(t.size) for t in trees]
    for r in got.collect():     # a row per (tree, leaf)
        out[r["tree"]][r["node"]] = r["rows"]
    for c, t in zip(out, trees, strict=True):
        for node in range(t.size - 1, -1, -1):      # children come after their parent
            if t.feature[node] >= 0:
                c[node] = c[t.left[node]] + c[t.left[node] + 1]
    return out


def _features(df: DataFrame, model: Model) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in model.feats))


def tree_paths(tree: Tree, count: np.ndarray, bins: int = 256) -> Paths:
    """All leaves of a tree with their features' ranges and weights."""
    leaves: list[tuple[int, dict[int, tuple[int, int, float]]]] = []
    todo: list[tuple[int, dict[int, tuple[int, int, float]]]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree.feature[node])
        if f < 0:
            leaves.append((node, path))
            continue
        low, high, weight = path.get(f, (-1, bins, 1.0))
        child, cut = int(tree.left[node]), int(tree.cut[node])
        share = count[child] / count[node] if count[node] else 0.5
        todo.append((child, {**path, f: (low, min(high, cut), weight * share)}))
        todo.append((child + 1, {**path, f: (max(low, cut), high, weight * (1 - share))}))
    shape = (len(leaves), max(len(p) for _, p in leaves))
    at = np.array([n for n, _ in leaves])
    out = Paths(np.full(shape, -1), np.full(shape, -1), np.full(shape, bins), np.ones(shape), tree.value[at], at)
    for k, (_, path) in enumerate(leaves):
        for place, (f, (low, high, weight)) in enumerate(path.items()):
            out.feature[k, place], out.low[k, place], out.high[k, place], out.weight[k, place] = f, low, high, weight
    return out


def path_values(paths: Paths, x: np.ndarray, feats: int) -> np.ndarray:
    """[row, feature] Shapley values of one tree for binned rows."""
    out = np.zeros((len(x), feats))
    places = paths.feature.shape[1]
    if not places or not len(x):
        return out
    at = x[:, np.maximum(paths.feature, 0)].astype(np.int64)
    own = (((at > paths.low) & (at <= paths.high)) | (paths.feature < 0)).astype(float)     # [row, leaf, place]
    points, mass = np.polynomial.legendre.leggauss((places + 1) // 2)
    others = np.zeros_like(own)
    for t, m in zip((points + 1) / 2, mass / 2, strict=True):
        factor = paths.weight * (1 - t) + own * t
        before, after = np.ones_like(factor), np.ones_like(factor)
        for k in range(1, places):
            before[..., k] = before[..., k - 1] * factor[..., k - 1]
            after[..., places - 1 - k] = after[..., places - k] * factor[..., places - k]
        others += m * before * after
    gain = others * (own - paths.weight) * paths.value[:, None]
    for k in range(places):
        used = np.flatnonzero(paths.feature[:, k] >= 0)
        switch = np.zeros((len(used), feats))
        switch[np.arange(len(used)), paths.feature[used, k]] = 1.0
        out += gain[:, used, k] @ switch
    return out


@dataclass
class Part:
    """Leaves below one node. A row's code has a bit per feature of the path to the node (1: the row goes
    the path's way), in the order in which they come up, then one per decision below it (1: left);
    ``table`` is [place, code], with the feature of each place."""
    decisions: list[int]
    features: list[int]
    table: np.ndarray


def tables_by_pattern(paths: Paths, leaves: np.ndarray, places: int) -> np.ndarray:
    """[leaf, place, pattern] values of leaves whose paths have ``places`` features; bit k of a pattern tells whether
    a row goes the path's way on the feature at place k."""
    own = (np.arange(2 ** places) >> np.arange(places)[:, None] & 1).astype(float)
    weight = paths.weight[leaves, :places, None]
    points, mass = np.polynomial.legendre.leggauss((places + 1) // 2)
    others = np.zeros((len(leaves), places, 2 ** places))
    for t, m in zip((points + 1) / 2, mass / 2, strict=True):
        factor = weight * (1 - t) + own * t
        before, after = np.ones_like(factor), np.ones_like(factor)
        for k in range(1, places):
            before[:, k] = before[:, k - 1] * factor[:, k - 1]
            after[:, places - 1 - k] = after[:, places - k] * factor[:, places - k]
        others += m * before * after
    return others * (own - weight) * paths.value[leaves, None, None]


def tree_parts(tree: Tree, paths: Paths, at: np.ndarray) -> tuple[dict[int, Part], np.ndarray]:
    """The parts of a tree by their topmost node, and the leaves (rows of ``paths``) whose paths have more features
    than a table holds. ``at`` is the node of each leaf in ``paths``."""
    places = (paths.feature >= 0).sum(axis=1)
    found: dict[int, np.ndarray] = {}
    for n in np.unique(places[(places > 0) & (places <= BITS)]):
        own = np.flatnonzero(places == n)
        found |= zip(own.tolist(), tables_by_pattern(paths, own, int(n)), strict=True)
    leaf, below = {int(node): k for k, node in enumerate(at)}, np.zeros(tree.size, dtype=np.int64)
    for node in range(tree.size - 1, -1, -1):       # children come after their parent
        if tree.feature[node] >= 0:
            below[node] = 1 + below[tree.left[node]] + below[tree.left[node] + 1]
    parts, wide, todo = {}, [], [(0, [])]
    while todo:
        node, above = todo.pop()
        if len(above) + below[node] <= BITS:
            parts[node] = _part(tree, node, above, paths, found, leaf)
        elif tree.feature[node] < 0:
            wide.append(leaf[node])
        else:
            f, child = int(tree.feature[node]), int(tree.left[node])
            todo += [(c, above if f in above else [*above, f]) for c in (child, child + 1)]
    return parts, np.array(sorted(wide), dtype=np.int64)


def _part(tree: Tree, top: int, above: list[int], paths: Paths, found: dict[int, np.ndarray], leaf: dict[int, int]) -> Part:
    decisions, ways, todo = [], [], [(top, [])]     # a way: leaf, (decision, went left) down to it
    while todo:
        node, way = todo.pop()
        if tree.feature[node] < 0:
            ways.append((leaf[node], way))
            continue
        k, child = len(decisions), int(tree.left[node])
        decisions.append(node)
        todo += [(child, [*way, (k, True)]), (child + 1, [*way, (k, False)])]
    features = list(dict.fromkeys([*above, *(int(tree.feature[n]) for n in decisions)]))
    codes = np.arange(2 ** (len(above) + len(decisions)))
    table = np.zeros((len(features), len(codes)))
    for row, way in ways:
        goes: dict[int, np.ndarray] = {f: codes >> k & 1 for k, f in enumerate(above)}
        for k, left in way:
            f, here = int(tree.feature[decisions[k]]), codes >> (len(above) + k) & 1
            here = here if left else 1 - here
            goes[f] = goes[f] & here if f in goes else here
        pattern, own = np.zeros(len(codes), dtype=np.int64), [int(f) for f in paths.feature[row] if f >= 0]
        for k, f in enumerate(own):
            pattern |= goes[f] << k
        if own:
            table[[features.index(f) for f in own]] += found[row][:, pattern]
    return Part(decisions, features, table)


def add_values(tree: Tree, parts: dict[int, Part], x: np.ndarray, out: np.ndarray) -> None:
    """Add a tree's values to ``out`` [feature, row] for binned rows ``x`` [feature, row], by its parts' tables."""
    n = x.shape[1]
    picked, todo = np.empty(n), [(0, np.zeros(n, dtype=np.int64), [])]
    while todo:
        node, code, above = todo.pop()
        part = parts.get(node)
        if part is not None:
            for k, d in enumerate(part.decisions):
                code = code + ((x[tree.feature[d]] <= tree.cut[d]).astype(np.int64) << (len(above) + k))
            for f, values in zip(part.features, part.table, strict=True):
                values.take(code, out=picked, mode="clip")
                out[f] += picked
        elif tree.feature[node] >= 0:       # a leaf without a part is integrated by itself
            f, child = int(tree.feature[node]), int(tree.left[node])
            left = (x[f] <= tree.cut[node]).astype(np.int64)
            for c, own in ((child, left), (child + 1, 1 - left)):
                if f in above:
                    bit = above.index(f)
                    todo.append((c, code & ~((1 - own) << bit), above))
                else:
                    todo.append((c, code + (own << len(above)), [*above, f]))


def explained(trees: list[Tree], paths: list[Paths], step: float, x: np.ndarray, feats: int) -> np.ndarray:
    """[row, feature] values of all trees for binned rows."""
    out, by_feature = np.zeros((feats, len(x))), np.ascontiguousarray(x.T)
    for t, p in zip(trees, paths, strict=True):
        parts, wide = tree_parts(t, p, p.node)
        for part in parts.values():
            part.table *= step
        for k in range(0, len(x), AT_ONCE):
            add_values(t, parts, by_feature[:, k:k + AT_ONCE], out[:, k:k + AT_ONCE])
        if len(wide):
            rest = p.of(wide)
            for k in range(0, len(x), BLOCK):
                out[:, k:k + BLOCK] += step * path_values(rest, x[k:k + BLOCK], feats).T
    return out.T


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``HELD_ROWS`` rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= HELD_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def path_attribution(model: Model, explain: DataFrame, background: DataFrame, id_cols: list[str], spec: int = 0) -> DataFrame:
    """One row per row of ``explain``: ids, ``base`` (the background's mean prediction), ``impacts``
    (map from feature to its value) and ``prediction``; base and impacts add up to the prediction."""
    if background.isEmpty():
        raise ValueError("no background rows")
    s, counts, n = model.specs[spec], leaf_counts(model, background, spec), len(model.feats)
    paths = [tree_paths(t, c) for t, c in zip(model.trees[spec], counts, strict=True)]
    base = model.starts[spec]
    for t, c in zip(model.trees[spec], counts, strict=True):
        leaf = t.feature[:t.size] < 0
        base += s.step * float(np.dot(c[leaf], t.value[:t.size][leaf])) / max(float(c[0]), 1.0)

    own = explain.select(*id_cols, *(F.col(f"`{c}`").cast("double").alias(f"_f{k}") for k, c in enumerate(model.feats)))
    ids = T.StructType(own.schema.fields[:len(id_cols)])
    schema = T.StructType([*ids.fields, T.StructField("base", T.DoubleType()), T.StructField("values", T.ArrayType(T.DoubleType())),
                           T.StructField("prediction", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            x = model.bins([held.column(f"_f{k}").to_numpy() for k in range(n)])
            got, whole = explained(model.trees[spec], paths, s.step, x, n), held.to_batches()[0]
            for start in range(0, len(x), AT_ONCE):
                b, own = whole.slice(start, AT_ONCE), got[start:start + AT_ONCE]
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).cast(arrow.field(k).type) for k in range(len(id_cols))), pa.array(np.full(len(own), base)),
                     pa.ListArray.from_arrays(ends, pa.array(own.ravel())).cast(arrow.field("values").type),
                     pa.array(model.predict(x[start:start + AT_ONCE])[:, spec])], schema=arrow)

    names = F.array(*[F.lit(c) for c in model.feats])
    return own.mapInArrow(run, schema).select(*id_cols, "base", F.map_from_arrays(names, "values").alias("impacts"), "prediction")


def feature_impacts(attributed: DataFrame) -> DataFrame:
    """Per feature: rows, mean absolute and mean signed impact (partial aggregates, a row per feature moves)."""
    long = attributed.select(F.explode("impacts").alias("feature", "impact"))
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("impact")).alias("mean_abs_impact"),
                                       F.avg("impact").alias("mean_impact"))
