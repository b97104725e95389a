"""Path-based Shapley values against enumeration over all feature sets."""
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricecast.models import hist_trees as ht
from pricecast.models import tree_paths as tp

FEATS = ["a", "b", "c", "d", "e", "f"]
SPECS = [ht.Spec("sq", stages=6, step=0.3, depth=4, leaves=12, least=3, l2=1.0), ht.Spec("med", 0.5, stages=4, step=0.3, depth=3, leaves=8, least=3)]


def worth(tree, count, x, known, node=0):
    """What a tree gives if only the features in ``known`` are."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left = tree.left[node]
    if f in known:
        return worth(tree, count, x, known, left + int(x[f] > tree.cut[node]))
    share = count[left] / count[node] if count[node] else 0.5
    return share * worth(tree, count, x, known, left) + (1 - share) * worth(tree, count, x, known, left + 1)


def enumerated(model, counts, x, spec):
    n, out = len(model.feats), np.zeros(len(model.feats))
    total = {s: sum(model.specs[spec].step * worth(t, c, x, set(s)) for t, c in zip(model.trees[spec], counts, strict=True))
             for k in range(n + 1) for s in combinations(range(n), k)}
    for i in range(n):
        for s in total:
            if i not in s:
                out[i] += factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (total[tuple(sorted((*s, i)))] - total[s])
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = np.random.default_rng(3)
    pdf = pd.DataFrame(rnd.normal(size=(400, 6)), columns=FEATS)
    pdf["y"] = 3 * pdf.a * pdf.b + 2 * np.abs(pdf.c) + pdf.d * (pdf.e > 0) + 0.1 * pdf.f
    pdf["id"] = np.arange(400)
    df = spark.createDataFrame(pdf).repartition(3)
    return df, ht.fit(df, FEATS, SPECS, target="y", key=["id"], bins=16)


@pytest.mark.parametrize("spec", [0, 1])
def test_equals_enumeration_over_all_feature_sets(fitted, spec):
    df, model = fitted
    background = df.where("id >= 20")
    counts = tp.leaf_counts(model, background, spec)
    assert all(c[0] == 380 for c in counts)
    got = {r["id"]: r for r in tp.path_attribution(model, df.where("id < 20"), background, ["id"], spec).collect()}
    assert len(got) == 20
    for r in df.where("id < 20").collect():
        x = model.bins([np.array([r[c]]) for c in FEATS])[0]
        mine = np.array([got[r["id"]]["impacts"][c] for c in FEATS])
        np.testing.assert_allclose(mine, enumerated(model, counts, x, spec), atol=1e-9)


def test_adds_up_to_the_prediction_less_the_mean_over_the_background(fitted):
    df, model = fitted
    background = df.where("id < 300")
    got = tp.path_attribution(model, df, background, ["id"])
    off = got.select(F.max(F.abs(F.aggregate(F.map_values("impacts"), F.col("base"), lambda a, v: a + v) - F.col("prediction")))).first()[0]
    assert off < 1e-9
    assert abs(got.first()["base"] - ht.score(model, background).agg(F.avg("sq")).first()[0]) < 1e-9


def test_unreached_nodes_nulls_repeats_and_empty_tables(spark, fitted):
    df, model = fitted
    narrow = df.where("id = 7")         # most nodes are reached by no background row
    odd = df.where("id in (1, 2)").union(df.where("id = 1")).withColumn("a", F.when(F.col("id") == 2, F.lit(None)).otherwise(F.col("a")))
    got = tp.path_attribution(model, odd.withColumn("base", F.lit("x")).withColumn("values", F.lit("y")), narrow, ["id"]).collect()
    assert sorted(r["id"] for r in got) == [1, 1, 2]
    for r in got:
        assert abs(r["base"] + sum(r["impacts"].values()) - r["prediction"]) < 1e-9
    first, second = (r for r in got if r["id"] == 1)
    assert first == second
    assert tp.path_attribution(model, df.where("false"), narrow, ["id"]).count() == 0
    with pytest.raises(ValueError):
        tp.path_attribution(model, df, df.where("false"), ["id"])


def test_trees_without_a_cut_give_nothing(spark):
    df = spark.createDataFrame([(i, 1.0, 5.0) for i in range(10)], "id long, a double, y double")
    model = ht.fit(df, ["a"], [ht.Spec("p", stages=2)], target="y", key=["id"])
    got = tp.path_attribution(model, df, df, ["id"]).collect()
    assert {r["impacts"]["a"] for r in got} == {0.0} and len(got) == 10


def test_rows_are_explained_where_they_lie(fitted):
    df, model = fitted
    plan = tp.path_attribution(model, df.select("*"), df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") <= 1      # the fixture's own repartition
    table = tp.feature_impacts(tp.path_attribution(model, df, df, ["id"])).collect()
    assert {r["feature"] for r in table} == set(FEATS) and {r["n"] for r in table} == {400}
    assert min(table, key=lambda r: r["mean_abs_impact"])["feature"] == "f"      # hardly used by the target


def grown_at_random(rng, depth, leaves, feats):
    tree, open_ = ht.Tree.empty(leaves), [0]
    for _ in range(depth):
        made = []
        for node in open_:
            if tree.size < 2 * leaves - 1:
                child = tree.split(node, int(rng.integers(0, feats)), int(rng.integers(1, 14)))
                made += [child, child + 1]
        open_ = made
    tree.value[:] = rng.normal(size=len(tree.value))
    return tree


@pytest.mark.parametrize(("depth", "leaves", "feats"), [(0, 1, 3), (3, 8, 2), (6, 40, 9), (9, 30, 12)])
def test_values_are_looked_up_and_equal_the_integrals(monkeypatch, depth, leaves, feats):
    """a row's values come from tables over its decisions; only paths of too many features are integrated row by row."""
    rng = np.random.default_rng(depth)
    trees = [grown_at_random(rng, depth, leaves, feats) for _ in range(2)]
    background, x = (rng.integers(0, 16, (n, feats)).astype(np.uint8) for n in (50, 300))
    paths = []
    for t in trees:
        count = np.bincount(t.node(background), minlength=t.size).astype(float)
        for node in range(t.size - 1, -1, -1):
            if t.feature[node] >= 0:
                count[node] = count[t.left[node]] + count[t.left[node] + 1]
        paths.append(tp.tree_paths(t, count))
    want = sum(0.3 * tp.path_values(p, x, feats) for p in paths)
    integrated, whole = [], tp.path_values
    monkeypatch.setattr(tp, "path_values", lambda p, *a: integrated.append(len(p.value)) or whole(p, *a))
    np.testing.assert_allclose(tp.explained(trees, paths, 0.3, x, feats), want, atol=1e-12)
    assert not integrated
    monkeypatch.setattr(tp, "AT_ONCE", 7)
    monkeypatch.setattr(tp, "BITS", 3)
    np.testing.assert_allclose(tp.explained(trees, paths, 0.3, x, feats), want, atol=1e-12)
    assert bool(integrated) == (feats > 3)
