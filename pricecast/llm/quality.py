"""Quality classifier from weak labels (operator 6).

Overlapping heuristic labellers look at each whole text and vote good (1), bad (-1) or nothing
(0). Expectation-maximisation over the counts of vote patterns (all documents) estimates each
labeller's accuracy and each pattern's posterior probability of good. The posteriors train a
linear scorer on hashed character-class trigrams, which scores every document.

Bounds: the scorer is trained on at most ``SAMPLE`` documents, the first in hash order of their
ids; vote counts and scoring cover everything. Vote patterns are at most 3^6 rows. Texts are
never shuffled.

Defined cases: null and empty texts are bad (score 0); repeated rows get equal results; with no
documents there is nothing to train and no row; equal hashes are ordered by text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import append_columns, checkpoint, fresh_name, map_columns

SAMPLE = 4000
HASHED = 2048
LABELLERS = 6
GOOD = 0.5

#: Character classes of UTF-8 bytes: lower case and non-ASCII, upper case, digit, white space; other bytes stand for themselves.
_CLASS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57
               else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


_RUNS = re.compile(rb"([!-/:-@\[-`{-~])\1\1")    # a sign three times in a row


def votes(text: str | None) -> tuple[int, ...]:
    """The labellers' votes on one whole text."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (-1,) * LABELLERS
    kinds = data.translate(_CLASS)
    letters = kinds.count(b"a") + kinds.count(b"A")
    solid = len(kinds) - kinds.count(b" ")
    plain = sum(kinds.count(c) for c in (b".", b",", b";", b":", b"'", b"-", b"(", b")", b'"', b"?", b"!"))
    odd = (solid - letters - kinds.count(b"0") - plain) / solid
    upper = kinds.count(b"A") / max(letters, 1)
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    bare = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    loud = (data.count(b"!!") + data.count(b"??")) / n
    distinct = len(set(words)) / n
    runs = sum(1 for _ in _RUNS.finditer(data)) / n
    lean = lambda x, bad, good: -1 if x >= bad else 1 if x <= good else 0
    return (lean(odd, 0.05, 0.01), lean(upper, 0.3, 0.1), lean(echo, 0.1, 0.02), lean(bare + loud, 0.05, 0.01),
            0 if n < 30 else -1 if distinct < 0.15 * min(1.0, 300 / n) else 1, lean(runs, 0.05, 0.01))


def vector(text: str | None) -> np.ndarray:
    """Hashed character-class trigram frequencies, square-rooted to unit length."""
    k = np.frombuffer((text or "").encode().translate(_CLASS), dtype=np.uint8).astype(np.uint32)
    if len(k) < 3:
        return np.zeros(HASHED, dtype=np.float32)
    h = ((k[:-2] * np.uint32(65599) + k[1:-1]) * np.uint32(65599) + k[2:]) * np.uint32(2654435761)
    counts = np.bincount(h >> np.uint32(21), minlength=HASHED)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of good per vote pattern, and rates [class, labeller, vote + 1], by EM.

    Votes are independent given the class; the majority vote starts it; pseudo-counts keep rates
    above zero.
    """
    pats = sorted(counts)
    if not pats:
        return {}, np.full((2, LABELLERS, 3), 1 / 3)
    v = np.array(pats) + 1
    n = np.array([counts[p] for p in pats], dtype=float)
    post = np.where((v == 0).any(axis=1), 0.2, 0.9)   # any objection starts as a suspicion
    rates = np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        share = np.stack([n * (1 - post), n * post])
        prior = (share.sum(axis=1) + 1) / (n.sum() + 2)
        for k in range(LABELLERS):
            for c in (0, 1):
                rates[c, k] = np.bincount(v[:, k], weights=share[c], minlength=3) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        logp = np.log(prior)[:, None] + sum(np.log(rates[:, k, v[:, k]]) for k in range(LABELLERS))
        post = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -500, 500)))
    return dict(zip(pats, post.tolist(), strict=True)), rates


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 0.02) -> np.ndarray:
    """Logistic weights (HASHED + bias) on soft labels; full-batch Adam, deterministic."""
    theta = np.zeros(HASHED + 1)
    if not len(y):
        return theta
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        d = y - 1 / (1 + np.exp(-np.clip(x @ theta[:-1].astype(np.float32) + theta[-1], -50, 50)))
        g = np.append(x.T @ d.astype(np.float32), d.sum()) - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += 0.2 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return theta


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The scorer's weights."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("votes", T.ArrayType(T.IntegerType()))])
    keyed = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    seen = checkpoint(map_columns(keyed, lambda h, t: {"h": h, "votes": [list(votes(x)) for x in t]}, schema))
    counts = {tuple(r["votes"]): r["n"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _ = estimate(counts)
    last = seen.orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return train(np.zeros((0, HASHED), dtype=np.float32), np.zeros(0))
    row = T.StructType([*schema.fields, T.StructField("x", T.BinaryType()), T.StructField("t", T.LongType())])
    picked = (map_columns(keyed.where(F.col("h") <= last).withColumn("t", F.xxhash64("text")),
                          lambda h, t, k: {"h": h, "votes": [list(votes(x)) for x in t], "x": [vector(x).tobytes() for x in t], "t": k},
                          row).orderBy("h", "t").limit(SAMPLE).collect())
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in picked])
    return train(x, np.array([post[tuple(r["votes"])] for r in picked]))


def rate(text: str | None, weights: np.ndarray) -> float:
    """Probability of good; 0 for a text without words."""
    if not (text or "").strip():
        return 0.0
    z = float(vector(text) @ weights[:-1]) + float(weights[-1])
    return 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the score and the decision (1 good, 0 bad) added, and the names they got."""
    names = {k: fresh_name(docs, f"quality_{k}") for k in ("score", "good")}
    fields = [T.StructField(names["score"], T.DoubleType()), T.StructField(names["good"], T.IntegerType())]

    def run(texts: list) -> list[list]:
        s = [rate(t, weights) for t in texts]
        return [s, [int(x >= GOOD) for x in s]]

    return append_columns(docs, [text_col], run, fields), names
