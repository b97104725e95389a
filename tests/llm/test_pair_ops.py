"""Pair operators, mixing and the pipeline against brute force."""
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pricecast.llm import components, decontam, embed_join, mixing, pii, queries, simhash, suffix_dedup, toxicity
from pricecast.llm.common import table
from tests.conftest import SF001, SF01
from tests.llm.test_text_ops import DOCS, docs


def roots(n, edges):
    lab = list(range(n))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (201, 200), (200, 201)]
    edges += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(150)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in
           components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(600, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash

def brute_fingerprint(text, width=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    grams = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("Ab bC é x \x0b zz".split(" ")) for _ in range(n)) for n in (1, 2, 3, 7, 300)] + ["", None, " \n", "A\x1cb c"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def brute_groups(fps, most):
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= most]
    return roots(len(fps), edges), len(edges)


@pytest.mark.parametrize("most", [3, 2])
def test_links_give_the_components_of_brute_force(spark, monkeypatch, most):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0}
    for _ in range(6):    # balls and chains of near fingerprints
        x = rng.getrandbits(64)
        for _ in range(60):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    fps = sorted(fps)
    want, n_edges = brute_groups(fps, most)
    assert n_edges > 100
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for block, layouts in ((1024, (4,)), (2, (3,)), (1024, (2,)), (8, (2, 3, 4))):   # also hot values, and probes
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "LAYOUTS", layouts)
        if max(layouts) > most + 1:
            continue
        at = {simhash._signed(x): i for i, x in enumerate(fps)}
        got = roots(len(fps), [(at[r["a"]], at[r["b"]]) for r in simhash.links(frame, most).collect()])
        assert got == want, (block, layouts)


def test_allocation_is_the_cheapest():
    rng = random.Random(2)
    for m, most in ((2, 3), (3, 3), (4, 3), (3, 5)):
        costs = [[0.0, *(rng.random() * 10 ** t for t in range(most + 1))] for _ in range(m)]
        cost, ts = simhash.allocate(costs, most - m + 1)
        import itertools
        best = min(sum(c[t + 1] for c, t in zip(costs, x, strict=True)) for x in itertools.product(range(-1, most + 1), repeat=m)
                   if sum(x) == most - m + 1)
        assert math.isclose(cost, best) and sum(ts) == most - m + 1


def test_simhash_groups_and_keep_one(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(900))
    texts = [base, base.upper().replace("W", "w"), base + " tail", "", None, "other words entirely here", base]
    frame = docs(spark, texts)
    got = {r["doc_id"]: r for r in simhash.groups(frame).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want, _ = brute_groups(fps, 3)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert got[None]["component_id"] == 3      # no words: linked like any other
    kept = simhash.keep_one(frame.unionByName(frame.where("doc_id in (0, 5)")))
    assert kept.columns == [f.name for f in DOCS]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*(str(i) for i in sorted(set(want))), "None"])
    assert simhash.groups(frame.where("false")).count() == 0


def test_keep_one_decides_by_row(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(3))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(frame(rows)).collect()), key=str)
    # unrelated texts of one id both stay; 5 loses its copy of 3, and still names its other group
    assert kept([(5, a, "", ""), (5, b, "", ""), (7, a, "", ""), (3, b, "", "")]) == sorted([(5, a), (3, b)], key=str)
    assert kept([(5, a, "", ""), (5, b, "", "")]) == sorted([(5, a), (5, b)], key=str)
    # copies without ids: next to an id they go, among themselves one stays
    assert kept([(None, a, "x", "s"), (None, a, "y", "t"), (9, a, "", ""), (None, b, "x", None), (None, b, None, "x"),
                 (None, c, "", "")]) == sorted([(9, a), (None, b), (None, c)], key=str)


# --- embeddings

def test_embedding_join_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(12, 8))
    for i in range(240):
        v = base[i % 12] + rng.normal(size=8) * (0.25 if i % 3 else 0.05)
        rows.append((i, [float(x) for x in v], i % 4 if i % 7 else 9))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(7, rows[7][1], rows[7][2])]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [1.0, None] * 4, 1), (2003, [float("nan")] * 8, 1), (2004, rows[0][1], None),
             (2005, rows[0][1][:4], rows[0][2]), (2006, [], 1), (2007, [1e300] * 8, 5), (2008, [1e-300] * 8, 5), (2009, [float("inf")] * 8, 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or a[1] is None or b[1] is None or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array([np.nan if v is None else v for v in r[1]], dtype=float) for r in (a, b))
        if not len(x) or not (np.isfinite(x).all() and np.isfinite(y).all()) or not x.any() or not y.any():
            return False
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= 0.93

    edges = [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i], rows[j])]
    n = [0] * len(rows)
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    comp = roots(len(rows), edges)
    smallest: dict = {}
    for i, c in enumerate(comp):
        smallest[c] = min(smallest.get(c, 1 << 60), rows[i][0])
    want = sorted((rows[i][0], n[i], smallest[comp[i]], rows[i][0] == smallest[comp[i]]) for i in range(len(rows)))
    for chunk, pivots, lengths in ((2048, 16, 64), (5, 4, 64), (5, 4, 1), (2048, 16, 0)):
        monkeypatch.setattr(embed_join, "LENGTHS", lengths)      # lengths without pivots join as one cell
        monkeypatch.setattr(embed_join, "CHUNK", chunk)
        monkeypatch.setattr(embed_join, "PIVOTS", pivots)
        assert sorted(tuple(r) for r in embed_join.join(frame).select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert embed_join.join(frame.where("false")).count() == 0


# --- repeated substrings

def brute_strip(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for p in range(len(d) - 99):
            if d[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(d[p:p + 100])
        out[i] = (len(d), sum(gone), sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1])),
                  hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "hot", "block"), [(32, 1024, 1 << 20), (2, 4, 300)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, crowd, hot, block):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(1)
    word = lambda n, abc="abcdefgh ": "".join(rng.choice(abc) for _ in range(n))
    base = [word(400, "abcd ") for _ in range(4)]
    texts = ["a" * 500, "a" * 99, "a" * 100, None, "", "ab" * 300, base[0], "xx" + base[0][50:300] + "yy", base[0] + base[1], base[1] * 2,
             base[2][:150] + "Q" + base[2][151:], base[2], "é" * 200, "zé" + "é" * 200, word(30_000), base[0]]
    texts += [word(rng.randint(0, 150)) + base[3] + word(rng.randint(0, 150)) for _ in range(120)]
    frame = docs(spark, texts).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.report(frame).collect()}
    want = brute_strip(list(enumerate(texts)))
    assert got.pop(None)[0] == 0 and got == want
    assert suffix_dedup.report(frame.where("false")).count() == 0


def test_fragments_meet_equal_windows_alike():
    rng = random.Random(9)
    data = bytes(rng.randrange(97, 101) for _ in range(3000))
    num, start, end, h = suffix_dedup.fragments([data, b"xyz" * 20 + data[500:2500]])
    assert sum(end[num == 0] - start[num == 0]) == 2901          # every window lies in one fragment
    anchor = {(int(n), p): int(k) for n, a, b, k in zip(num, start, end, h, strict=True) for p in range(a, b)}
    assert all(anchor[0, 500 + p] == anchor[1, 60 + p] for p in range(1901))


# --- mixing

def test_shares_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 100), ("a", "y", "s3", 5), ("b", "x", "s4", 1000)],
                                   "mix_domain string, mix_lang string, mix_source string, tokens long")
    got = {r["mix_source"]: r["budget"] for r in
           mixing.budgets(leaves, {"domain": {"a": 1, "b": 1}}, 1.0, 0.2, 1).collect()}
    # 223 tokens: 111 each; in a, y is short (5 of 55), so x gets 106; there s1 is short (10), so s2 gets 96
    assert got == {"s1": 10.0, "s2": 96.0, "s3": 5.0, "s4": 111.0}
    got = {r["mix_source"]: r["budget"] for r in mixing.budgets(leaves, {"domain": {"a": 9}}, 1.0, 0.5, 1).collect()}
    assert got == {"s1": 10.0, "s2": 100.0, "s3": 5.0, "s4": 442.0}   # all of a is short, so b makes it up


def test_nothing_is_lost_on_zero_weights(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 100), ("a", "y", "s3", 50), ("b", "x", "s4", 1000), ("c", "x", "s5", 9)],
                                   "mix_domain string, mix_lang string, mix_source string, tokens long")
    weights = {"domain": {"c": 0}, "lang": {"y": -1}, "source": {"s2": 0}}
    got = {r["mix_source"]: r["budget"] for r in mixing.budgets(leaves, weights, 1.0, 0.2, 1).collect()}
    # 233 tokens: of a only s1 has a share, and it is short (10), so b gets the rest
    assert {k: v for k, v in got.items() if v} == {"s1": 10.0, "s4": 223.0}


def test_mixing_edges(spark):
    rows = [(i, "w " * n, lang, src) for i, (n, lang, src) in enumerate([(5, "en", "a"), (0, "en", "a"), (7, None, "a"), (3, "en", None)] * 5)]
    rows += [(None, "null id text", "en", "a"), (None, None, None, None), (0, "w " * 5, "en", "a")]
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, source string, mix_lang double")
    out = mixing.mix(frame, budget_share=1.0, max_epochs=1)
    got = out.collect()
    assert len(got) == sum(1 for r in rows if r[1] and r[1].strip()) and all(r["mix_taken"] == r["mix_tokens"] for r in got)
    assert out.columns[:5] == frame.columns and len(set(out.columns)) == len(out.columns)
    part = mixing.mix(frame, budget_share=0.5, max_epochs=2)
    assert 0 < part.agg(F.sum("mix_taken")).first()[0] <= 0.5 * out.agg(F.sum("mix_taken")).first()[0] + 5
    assert mixing.mix(frame.where("false")).count() == 0
    over = mixing.mix(frame, budget_share=9.0, max_epochs=2)
    assert over.count() == 2 * len(got)


def test_mixing_sql_with_closed_leaves(spark):
    """Weights of zero or less, weights of single levels, shortage and surplus: SQL and operator agree."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    frame = table(spark, SF001, "documents").select("doc_id", "text", "lang", "source")
    for weights, part, epochs, seed in (({"domain": {"code": 0, "web": 5}, "lang": {"de": -1}, "source": {"src1": 0, "src0": 3}}, 0.9, 2, 3),
                                        ({"lang": {"en": 7, "fr": 0}}, 0.5, 1, 4), ({}, 9.0, 2, 5)):
        want = con.execute(queries.mixing_sql(weights, part, epochs, seed)).df()
        got = mixing.mix(frame, weights, part, epochs, seed).drop("text", "lang", "source").toPandas()
        assert sorted(map(str, want[sorted(want.columns)].to_numpy().tolist())) == sorted(map(str, got[sorted(want.columns)].to_numpy().tolist()))
        assert len(got) > 0


def test_mixing_plan_is_native(spark):
    frame = table(spark, SF001, "documents")
    plan = mixing.mix(frame, queries.MIX_WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
    leaves = spark.createDataFrame([("a", "x", "s1", 10)], "mix_domain string, mix_lang string, mix_source string, tokens long")
    plan = mixing.budgets(leaves, {}, 1.0, 0.5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    found = con.sql(queries.ORACLE[name])
    cols = sorted(found.columns)
    got = queries.QUERIES[name](spark, SF001)
    assert sorted(got.columns) == cols
    want = found.select(*cols).fetchall()     # values as Python's own: a null does not turn a column's integers into floats
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


# --- pipeline

def test_pipeline_equals_its_stages_by_brute_force(spark):
    start = table(spark, SF01, "documents")
    rows = {r["doc_id"]: r.asDict() for r in start.collect()}
    field = queries.toxicity_field(spark, start, SF01)
    clean = {i: r for i, r in rows.items() if toxicity.tag(field, r["text"])[0] < toxicity.THRESHOLD}
    ids = sorted(clean)
    comp, _ = brute_groups([brute_fingerprint(clean[i]["text"]) for i in ids], 3)
    single = {ids[c]: clean[ids[c]] for c in set(comp)}
    items = [decontam.words(r["text"]) for r in table(spark, SF01, "benchmark").collect()]
    wins = {tuple(w[i:i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in wins}

    def leaks(text):
        w = decontam.words(text)
        return any(tuple(w[i:i + n]) in wins for n in sizes for i in range(len(w) - n + 1))

    kept = {i: r for i, r in single.items() if not leaks(r["text"])}
    assert len(rows) > len(clean) > len(single) > len(kept) > 0
    stage = corpus_pipeline.drop_contaminated(spark, corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_toxic(spark, start, SF01), SF01), SF01)
    assert stage.schema == start.schema
    assert {r["doc_id"]: r.asDict() for r in stage.collect()} == kept
    weights = pii.fit(stage)
    masked = {i: pii.redacted(r["text"], weights) for i, r in kept.items()}
    out = corpus_pipeline.run(spark, SF01).collect()
    assert out and all(r["text"] == masked[r["doc_id"]] for r in out)
    budget = math.floor(queries.MIX_SHARE * sum(len((t or "").encode().split()) for t in masked.values()))
    assert budget - 200 <= sum(r["mix_taken"] for r in out) <= budget


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, stage, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    odd = docs(spark, ["", None, "plain words", "plain words", "é " * 30_000])
    odd = odd.unionByName(odd)
    fn = corpus_pipeline.STAGES[stage][1]
    out = fn(spark, odd, str(tmp_path))
    got = [r["doc_id"] for r in out.collect()]
    assert fn(spark, odd.where("false"), str(tmp_path)).count() == 0
    if stage < 4:
        assert out.columns == odd.columns
    assert sorted(map(str, got)) == {1: ["0", "2", "4", "None"], 4: sorted(map(str, got))}.get(stage, sorted(["0", "1", "2", "3", "4", "None"] * 2))


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['pricecast.llm'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'top_markets' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
