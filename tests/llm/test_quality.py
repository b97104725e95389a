"""Quality classifier against plain loops: votes, EM, features, scores, and the whole query."""
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.llm import quality, queries
from pricecast.llm.common import table
from tests.conftest import SF001
from tests.llm.test_text_ops import docs


def kind(c):
    return ("a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if c in "0123456789"
            else " " if c in " \t\n\x0b\x0c\r" else c)


def brute_votes(text):
    """The six labellers, over code points; texts here hold ASCII, where bytes are characters."""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]
    if not words:
        return (-1,) * 6
    ks = [kind(c) for c in text]
    solid = [c for c, k in zip(text, ks) if k != " "]
    letters = sum(k in "aA" for k in ks)
    odd = sum(kind(c) not in "aA0" and c not in ".,;:'-()\"?!" for c in solid) / len(solid)
    upper = ks.count("A") / max(letters, 1)
    echo = sum(a == b for a, b in itertools.pairwise(words)) / len(words)
    bare = sum(len(w) == 1 and not w.isalnum() for w in words) / len(words)
    loud = (len(re.findall("!!", text)) + len(re.findall(r"\?\?", text))) / len(words)
    runs = len(re.findall(r"([!-/:-@\[-`{-~])\1\1", text)) / len(words)
    lean = lambda x, bad, good: -1 if x >= bad else 1 if x <= good else 0
    varied = 0 if len(words) < 30 else -1 if len(set(words)) / len(words) < 0.15 * min(1, 300 / len(words)) else 1
    return (lean(odd, 0.05, 0.01), lean(upper, 0.3, 0.1), lean(echo, 0.1, 0.02), lean(bare + loud, 0.05, 0.01), varied, lean(runs, 0.05, 0.01))


def brute_em(counts, rounds=60):
    """EM over patterns with one loop per quantity."""
    total = sum(counts.values())
    post = {p: 0.2 if -1 in p else 0.9 for p in counts}
    for _ in range(rounds):
        weight = {c: {p: n * (post[p] if c else 1 - post[p]) for p, n in counts.items()} for c in (0, 1)}
        prior = {c: (sum(weight[c].values()) + 1) / (total + 2) for c in (0, 1)}
        rate = {}
        for c in (0, 1):
            for k in range(6):
                mass = {v: 0.5 + sum(w for p, w in weight[c].items() if p[k] == v) for v in (-1, 0, 1)}
                rate[c, k] = {v: m / sum(mass.values()) for v, m in mass.items()}
        for p in counts:
            joint = {c: math.log(prior[c]) + sum(math.log(rate[c, k][p[k]]) for k in range(6)) for c in (0, 1)}
            post[p] = 1 / (1 + math.exp(min(500, max(-500, joint[0] - joint[1]))))
    return post


def brute_vector(text):
    ks = [ord(kind(c)) for c in text or ""]
    counts = {}
    for a, b, c in zip(ks, ks[1:], ks[2:]):
        h = (((a * 65599 + b) * 65599 + c) * 2654435761) % 2**32 >> 21
        counts[h] = counts.get(h, 0) + 1
    total = sum(counts.values())
    return {h: math.sqrt(n / total) for h, n in counts.items()}


ASCII = ["Plain words make a sentence, and another one follows it here.", "!!! ### $$$ %%% ^^^ &&&", "BUY NOW BUY NOW BUY NOW", "a a a a a a a a",
         "", " \n", "x", "tab\tand\x0bvertical", "word " * 40, " ".join(f"w{k}" for k in range(60)), "Yes?? No!! -- ** end", "ab"]


def test_votes_features_and_em_equal_plain_loops():
    for t in ASCII:
        assert quality.votes(t) == brute_votes(t), t
        want = brute_vector(t)
        got = quality.vector(t)
        assert {int(k) for k in np.flatnonzero(got)} == set(want)
        assert all(abs(got[h] - v) < 1e-6 for h, v in want.items())
    rng = np.random.default_rng(2)
    some = list(itertools.product((-1, 0, 1), repeat=6))
    counts = {some[k]: int(n) for k, n in zip(rng.choice(len(some), 90, replace=False), rng.integers(1, 500, 90))}
    got, _ = quality.estimate(counts)
    for p, v in brute_em(counts).items():
        assert abs(got[p] - v) < 1e-9
    assert quality.estimate({}) [0] == {}


def brute_scores(texts, weights):
    out = []
    for t in texts:
        z = sum(v * weights[h] for h, v in brute_vector(t).items()) + weights[-1]
        out.append(1 / (1 + math.exp(-z)) if (t or "").strip() else 0.0)
    return out


def test_fit_and_scores_equal_plain_loops(spark):
    """Repeated rows, ties, very long and empty texts, clashing columns; EM posteriors train the scorer."""
    texts = ASCII * 3 + ["long words here " * 20_000, None]
    frame = docs(spark, texts).withColumn("quality_score", F.lit("clash"))
    weights = quality.fit(frame)
    counts = {}
    every = [*texts, None]
    for t in every:
        counts[brute_votes(t)] = counts.get(brute_votes(t), 0) + 1
    post = brute_em(counts)
    # the rows in the operator's order, which is that of their hashes
    order = [r["text"] for r in frame.select("text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).orderBy("h", "t").collect()]
    x = np.zeros((len(order), quality.HASHED), dtype=np.float32)
    for i, t in enumerate(order):
        for h, v in brute_vector(t).items():
            x[i, h] = v
    np.testing.assert_allclose(weights, quality.train(x, np.array([post[brute_votes(t)] for t in order])), atol=1e-3)
    got, names = quality.score(frame, weights)
    assert names["score"] != "quality_score" and got.columns[:len(frame.columns)] == frame.columns
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == len(every)
    for i, s in enumerate(brute_scores(texts, weights)):
        assert found[i][names["score"]] == pytest.approx(s, abs=1e-5)
        assert found[i][names["good"]] == int(found[i][names["score"]] >= 0.5)
    for i in range(len(ASCII)):
        assert found[i][names["score"]] == found[i + len(ASCII)][names["score"]]


def test_query_scores_by_the_weights_of_its_fit(spark):
    frame = table(spark, SF001, "documents").select("doc_id", "text")
    weights = quality.fit(frame)
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    got = queries.QUERIES["op6_quality"](spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        if not texts[r["doc_id"]] or texts[r["doc_id"]].isascii():
            assert r["score"] == pytest.approx(brute_scores([texts[r["doc_id"]]], weights)[0], abs=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["kept"] == (r["predicted"] == 1)
