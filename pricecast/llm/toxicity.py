"""Toxic spans by a linear-chain conditional random field (operator 10).

``fit`` learns from labelled documents; ``score`` tags every token of every whole text.

* Tokens are white-space runs, lower-cased, with outer punctuation cut. A token's features are
  its word and its first four and five characters; a text line is one chain of tags
  (0 clean, 1 toxic).
* Document labels become token labels: a feature whose document frequency differs between
  toxic and clean training documents by a significant log-likelihood ratio marks the tokens of
  toxic documents that carry it.
* The field's weights (one per feature, a bias, a 2x2 transition matrix) maximise the L2
  penalised conditional log-likelihood; forward-backward gives its gradient.
* A document's score is the largest forward-backward marginal of the toxic tag over all its
  tokens; tokens at or over ``SPAN_MIN`` give the offending spans.

Bounds: training reads at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled documents and at most
``MAX_CHARS`` of their whole texts, in hash order, less the copies among them (``_unlike``). The
learnt weights (at most ``MAX_FEATURES``) are all that travels to the executors. Scoring has no bound and no shuffle.

Defined cases: a null or empty text has no token and gets the score ``EMPTY_SCORE`` (0);
repeated rows get equal scores; without a toxic or a clean training row every score is 0;
null ``doc_id`` or null label is never trained on.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import append_columns, fresh_name

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2000, 4000, 24_000_000
MAX_FEATURES = 20_000
TRAIN_CHAIN = 64      # in training alone, longer lines are cut into chains of so many tokens
MIN_G = 12.0          # least log-likelihood ratio of a marker feature
SKETCH = 16           # smallest shingle hashes by which possible training copies are found
NEAR = 0.4            # least similarity of two sketches for their documents to be compared
COPY = 0.8            # least Jaccard similarity of a training copy, over all shingles
THRESHOLD = 0.3       # predicted = score >= THRESHOLD
SPAN_MIN = 0.5        # marginal of a reported toxic token
EMPTY_SCORE = 0.0
CACHE = 300_000       # remembered raw tokens per task; a miss is only slower

_EDGE = " \t\r\n.,;:!?()[]{}<>\"'`*&%$#|/\\_-+=~^@"
_RUN = re.compile(r"\S+")


def features(word: str) -> tuple[str, ...]:
    """Feature names of a normalised token; empty for a token of punctuation only."""
    if not word:
        return ()
    return ("w=" + word, "4=" + word[:4], "5=" + word[:5])


@dataclass
class Field:
    """Trained field: sparse feature weights, toxic bias, transition scores [from, to]."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray

    def emitter(self) -> _Emit:
        return _Emit(self.weights)


class _Emit(dict):
    """raw token -> summed weight of its features; 0.0 marks a neutral token."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, raw: str) -> float:
        get = self.weights.get
        v = sum(get(f, 0.0) for f in features(raw.lower().strip(_EDGE)))
        if len(self) < CACHE:
            self[raw] = v
        return v


def marginals(scores: np.ndarray, lens: np.ndarray, trans: np.ndarray):
    """Forward-backward over padded chains.

    ``scores``: (chains, longest) score of tag 1 against tag 0. Returns the tag-1 marginals, the
    expected transition counts and the log partition, each by chain. The loop runs over
    positions; each step handles all chains at once.
    """
    n, m = scores.shape
    e = np.stack([np.zeros_like(scores), scores], axis=2)
    alpha = np.zeros((n, m, 2))
    beta = np.zeros((n, m, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, m):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + e[:, t]
    rows = np.arange(n)
    last = alpha[rows, lens - 1]
    logz = np.logaddexp(last[:, 0], last[:, 1])
    for t in range(m - 2, -1, -1):
        nxt = beta[:, t + 1] + e[:, t + 1]
        step = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        beta[:, t] = np.where((t < lens - 1)[:, None], step, 0.0)
    inside = np.arange(m)[None, :] < lens[:, None]
    p = np.where(inside, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - logz[:, None], 0.0)), 0.0)
    pair = np.zeros((n, 2, 2))
    if m > 1:
        both = inside[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                x = alpha[:, :-1, a] + trans[a, b] + e[:, 1:, b] + beta[:, 1:, b] - logz[:, None]
                pair[:, a, b] = np.where(both, np.exp(np.minimum(x, 0.0)), 0.0).sum(axis=1)
    return p, pair, logz


def chain_marginals(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Tag-1 marginals of one chain: the same sums as ``marginals``, scaled at each token.

    A text's lines differ too much in length to be padded together, and a line may be very long;
    plain floats keep a token's cost at about a microsecond and memory at two lists.
    """
    (t00, t01), (t10, t11) = np.exp(np.clip(trans, -50, 50)).tolist()
    w = np.exp(np.clip(scores, -50, 50)).tolist()
    a0, a1 = 1.0 / (1.0 + w[0]), w[0] / (1.0 + w[0])
    fore = [a1]
    for x in w[1:]:
        b0, b1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * x
        z = b0 + b1
        a0, a1 = b0 / z, b1 / z
        fore.append(a1)
    b0 = b1 = 1.0
    p = [fore[-1]]
    for i in range(len(w) - 2, -1, -1):
        x = w[i + 1] * b1
        b0, b1 = t00 * b0 + t01 * x, t10 * b0 + t11 * x
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
        f = fore[i]
        p.append(f * b1 / (f * b1 + (1.0 - f) * b0))
    return np.array(p[::-1])


def _unlike(docs: list[tuple[list[list[str]], int]]) -> list[tuple[list[list[str]], int]]:
    """Documents that are no copy of an earlier kept one with the same label.

    A copy has a Jaccard similarity of at least ``COPY`` over all its 5-word shingles; the sketches
    only say which pairs to compare. Copies are not independent evidence: a rare word of a toxic
    text with twenty near copies would otherwise look like a sign of toxicity. A shared line or
    passage makes no copy, and equal texts with different labels both stay.
    """
    holders: dict[tuple[int, int], list[int]] = {}
    kept, grams_of, sketch_of = [], [], []
    for lines, y in docs:
        words = [w for line in lines for w in line]
        found = {crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4))}
        grams = np.array(sorted(found), dtype=np.uint32)
        sketch = grams[:SKETCH].tolist()
        met: Counter = Counter()
        for h in sketch:
            met.update(holders.get((y, h), ()))
        copy = False
        for k, shared in met.most_common():
            if shared < len(sketch) * NEAR:
                break
            n = min(len(grams), len(grams_of[k]))
            if n < COPY * max(len(grams), len(grams_of[k])):
                continue
            union = heapq.nsmallest(SKETCH, {*sketch, *sketch_of[k]})
            if len({*union} & {*sketch} & {*sketch_of[k]}) < NEAR * len(union):
                continue
            both = len(np.intersect1d(grams, grams_of[k], assume_unique=True))
            if both >= COPY * (len(grams) + len(grams_of[k]) - both):
                copy = True
                break
        if not copy:
            for h in sketch:
                holders.setdefault((y, h), []).append(len(kept))
            kept.append((lines, y))
            grams_of.append(grams)
            sketch_of.append(sketch)
    return kept


def _marker_features(docs: list[tuple[list[list[str]], int]]) -> dict[str, float]:
    """Features of toxic documents with a significant log-likelihood ratio, strongest first.

    The bar rises with the number of features tried, so that about none passes by chance.
    """
    df = (Counter(), Counter())
    n = [0, 0]
    for lines, y in docs:
        n[y] += 1
        df[y].update({f for w in {w for line in lines for w in line} for f in features(w)})
    out = {}
    if not n[0] or not n[1]:
        return out
    total = n[0] + n[1]
    tried = sum(1 for f, b in df[1].items() if b + df[0].get(f, 0) >= 3)
    bar = max(MIN_G, 2 * math.log(max(2, tried)))
    for f, b in df[1].items():
        a = df[0].get(f, 0)
        k = a + b
        if b * n[0] <= 20 * a * n[1]:   # toxic documents carry it over 20 times as often
            continue
        g = 2 * (b * math.log(b * total / (k * n[1])) + (a * math.log(a * total / (k * n[0])) if a else 0))
        if g >= bar:
            out[f] = g
    keep = sorted(out, key=lambda f: (-out[f], f))[:MAX_FEATURES]
    return {f: out[f] for f in keep}


def train(samples: list[tuple[str, int]], rounds: int = 120, l2: float = 0.05) -> Field:
    """Train the field on (text, label) pairs; deterministic."""
    docs = []
    for text, y in samples:
        lines = [[w for raw in line.split() if (w := raw.lower().strip(_EDGE))]
                 for line in (text or "").split("\n")]
        docs.append(([x for x in lines if x], y))
    docs = _unlike(docs)
    marks = _marker_features(docs)
    if not marks:
        return Field({}, -20.0, np.zeros((2, 2)))
    ids = {f: i for i, f in enumerate(marks)}
    known: dict[str, tuple[int, ...]] = {}
    seen_chains: Counter = Counter()   # equal chains (most clean lines of a length) train once, weighted
    for lines, y in docs:
        for line in lines:
            for w in line:
                if w not in known:
                    known[w] = tuple(ids[f] for f in features(w) if f in ids)
            whole = [known[w] for w in line]
            for at in range(0, len(whole), TRAIN_CHAIN):
                feats = tuple(whole[at:at + TRAIN_CHAIN])
                seen_chains[feats, y if any(feats) else 0] += 1
    chains = [c for c, _ in seen_chains]
    tags = [[int(bool(y and x)) for x in c] for c, y in seen_chains]
    times = list(seen_chains.values())
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    groups = []
    at = 0
    while at < len(order):   # chains of like length are padded together
        size = 1
        while at + size < len(order) and size < 512 and \
                len(chains[order[at + size]]) <= 1.3 * len(chains[order[at]]) + 2:
            size += 1
        part = order[at:at + size]
        at += size
        lens = np.array([len(chains[i]) for i in part])
        mult = np.array([times[i] for i in part], dtype=float)
        m = int(lens.max())
        y = np.zeros((len(part), m), dtype=np.int8)
        cell, feat = [], []
        for r, i in enumerate(part):
            y[r, :lens[r]] = tags[i]
            for t, fs in enumerate(chains[i]):
                for f in fs:
                    cell.append(r * m + t)
                    feat.append(f)
        inside = np.arange(m)[None, :] < lens[:, None]
        seen = np.zeros((2, 2))
        if m > 1:
            ok = inside[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    seen[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & ok).sum(axis=1) * mult).sum()
        groups.append((lens, m, y, np.array(cell, dtype=np.int64), np.array(feat, dtype=np.int64), seen, mult))
    k = len(ids)
    theta = np.zeros(k + 5)
    theta[k] = -3.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):   # Adam on the penalised log-likelihood
        grad = np.zeros_like(theta)
        trans = theta[k + 1:].reshape(2, 2)
        for lens, m, y, cell, feat, seen, mult in groups:
            s = np.bincount(cell, weights=theta[feat], minlength=len(lens) * m) + theta[k]
            p, pair, _ = marginals(s.reshape(len(lens), m), lens, trans)
            diff = ((y - p) * mult[:, None]).ravel()
            grad[:k] += np.bincount(feat, weights=diff[cell], minlength=k)
            grad[k] += diff.sum()
            grad[k + 1:] += (seen - (pair * mult[:, None, None]).sum(axis=0)).ravel()
        grad -= l2 * np.concatenate([theta[:k], np.zeros(1), theta[k + 1:]])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta += 0.3 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in ids.items() if abs(theta[i]) > 1e-3}
    return Field(weights, float(theta[k]), theta[k + 1:].reshape(2, 2).copy())


def tag(field: Field, text: str | None, emit: _Emit | None = None) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, [(start, end, marginal)]) of one whole text; code points, end exclusive."""
    emit = field.emitter() if emit is None else emit
    if not text:
        return EMPTY_SCORE, []
    raws = text.split()
    if not raws:
        return EMPTY_SCORE, []
    get = emit.__getitem__
    if not any(map(get, raws)):
        return _base(field), []
    best, spans, offset = _base(field), [], 0
    for line in text.split("\n"):
        toks = line.split()
        s = np.fromiter(map(get, toks), dtype=float, count=len(toks))
        if s.any():
            p = chain_marginals(s + field.bias, field.trans)
            best = max(best, float(p.max()))
            if (p >= SPAN_MIN).any():
                for i, m in enumerate(_RUN.finditer(line)):
                    if i < len(p) and p[i] >= SPAN_MIN:
                        spans.append((offset + m.start(), offset + m.end(), float(p[i])))
        offset += len(line) + 1
    return min(1.0, best), spans


def _base(field: Field) -> float:
    """Marginal of a lone neutral token: what a text without any marker scores."""
    return 1.0 / (1.0 + math.exp(min(700.0, -field.bias))) if field.weights else EMPTY_SCORE


def fit(docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text") -> Field:
    """Train on a bounded hash-ordered sample of the labelled rows that satisfy ``train_rows``.

    ``train_rows``: function from the id column to a boolean column. The chosen ids (at most
    MAX_TOXIC + MAX_CLEAN) are joined to the documents by broadcast, so the documents are not
    shuffled; whole texts are taken in hash order until MAX_CHARS, which is settled by their lengths
    before any text reaches the driver.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
             .where(train_rows(F.col("id")))
             .groupBy("id").agg(F.max("y").alias("y"))
             .withColumn("h", F.xxhash64("id")))
    picked = (known.where("y = 1").orderBy("h", "id").limit(MAX_TOXIC)
              .unionByName(known.where("y = 0").orderBy("h", "id").limit(MAX_CLEAN)))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # an id trains once, by its shortest text; only lengths travel before the texts are chosen
    first = (own.join(F.broadcast(picked), "id").groupBy("h", "id", "y")
             .agg(F.min(F.struct(F.length("text").alias("chars"), F.xxhash64("text").alias("t"))).alias("f")).orderBy("h", "id").collect())
    chosen, chars = [], 0
    for row in first:
        chars += row["f"]["chars"]
        if chars > MAX_CHARS:
            break
        chosen.append((row["h"], row["id"], row["y"], row["f"]["t"]))
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([
        T.StructField("h", T.LongType()), T.StructField("id", own.schema["id"].dataType), T.StructField("y", T.IntegerType()),
        T.StructField("t", T.LongType())]))
    texts = own.join(F.broadcast(wanted), "id").where(F.xxhash64("text") == F.col("t")).dropDuplicates(["id"])
    samples = [(row["text"], row["y"]) for row in texts.orderBy("h", "id").toLocalIterator()]
    return train(samples)


def score(docs: DataFrame, field: Field, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with score, predicted and spans columns added, and the names they got."""
    names = {k: fresh_name(docs, f"tox_{k}") for k in ("score", "predicted", "spans")}
    fields = [T.StructField(names["score"], T.DoubleType()), T.StructField(names["predicted"], T.IntegerType()),
              T.StructField(names["spans"], T.StringType())]
    weights, bias, trans = field.weights, field.bias, field.trans
    state: dict = {}

    def run(texts: list) -> list[list]:
        if not state:
            state["field"] = Field(weights, bias, trans)
            state["emit"] = state["field"].emitter()
        s, p, w = [], [], []
        for text in texts:
            v, spans = tag(state["field"], text, state["emit"])
            s.append(v)
            p.append(int(v >= THRESHOLD))
            w.append(",".join(f"{a}:{b}" for a, b, _ in spans))
        return [s, p, w]

    return append_columns(docs, [text_col], run, fields), names
