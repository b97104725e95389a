"""Personal data by weak supervision (operator 4).

Candidates are spans of the fixed base patterns (email, ip, card, phone) and looser ones
(bracketed "at" addresses, digit groups with separators). Five labelers vote on each: a strict
pattern labeler, a shape labeler, a gazetteer labeler, a context labeler on the words before
the span and a size labeler; each says personal (1), not (-1) or nothing (0).
Expectation-maximisation over the counts of vote patterns (all candidates of the corpus; there
are at most 3^5 patterns) estimates every labeler's reliability and each pattern's posterior. A
hashed logistic span classifier is trained on those posteriors and decides on the loose
candidates. Base spans always stay; loose ones that overlap a base span go.

Bounds: the span classifier is trained on at most ``SAMPLE`` candidates, the first in hash
order; counts and scoring cover everything. No shuffle of texts; two scans.

Defined cases: null and empty texts hold no span; repeated rows get equal results; an empty
table yields an untrained model that adds nothing; positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import append_columns, checkpoint, map_columns

KINDS = ("email", "ip", "card", "phone", "ssn")    # the order in which spans are listed
BASE = KINDS[:4]
SAMPLE = 20_000
HASHED = 4096
LABELERS = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins at the head of a digit run (what matches from inside one matches from its head) and gives no digit back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"[0-9][0-9().\x20-]{4,}[0-9]")
_AT = re.compile(r"[\[(] ?at ?[\])]")
_SPELT = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[(] ?dot ?[\])]|\.)\s?[A-Za-z0-9-]{2,63})+")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")
_DATE = re.compile(r"(?:[0-9]{4}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ][0-9]{4})\Z")
_GROUPS = re.compile(r"\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}\Z")
_WORD = re.compile(r"\w+")

# Word lists of the labelers.
_TRIGGERS = frozenset("email mail e-mail tel telephone phone call mobile cell fax contact card visa mastercard account "
                      "ssn social security ip host address telefon anruf karte correo teléfono tarjeta courriel "
                      "téléphone carte".split())
_AGAINST = frozenset("version page chapter isbn issn figure table section row line year price total score doi "
                     "seite kapitel página capítulo chapitre".split())
_TLDS = frozenset("com org net edu gov info io de fr es uk eu".split())
_CODES = frozenset("1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 52 55 61 81 82 86 91".split())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found at each @ so that long runs cost no retries."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed patterns; a match that fails its test is dropped, without retries."""
    out = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and _luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Further candidates: spelt-out addresses and digit groups."""
    out, free = [], 0
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        start = end
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < end and (right := _SPELT.match(text, m.end())):
            out.append(("email", start, right.end()))
        free = m.start()
    for m in _LOOSE.finditer(text):
        s, n = m.group(), len(_digits(m.group()))
        if _SSN.match(s):
            out.append(("ssn", *m.span()))
        elif 7 <= n <= 19:
            out.append(("card" if n >= 13 else "phone", *m.span()))
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes on one candidate."""
    s = text[start:end]
    before = _WORD.findall(text[max(0, start - 40):start].lower())[-4:]
    strict = 1 if base else 0
    if kind == "email":
        shape = 1 if base else 0
        listed = 1 if s.rsplit(".", 1)[-1].strip().lower() in _TLDS else -1
    elif kind == "ip":
        shape = 1 if s.count(".") == 3 else -1
        listed = -1 if s.startswith(("0.", "127.")) else 1
    else:
        d = _digits(s)
        shape = -1 if _DATE.match(s) or s.count(".") > 2 else 1 if _SSN.match(s) or _GROUPS.match(s) or base else 0
        listed = 0
        if kind == "card":
            listed = 1 if d[:1] in ("3", "4", "5", "6") else -1
        elif kind == "phone":
            listed = 1 if start and text[start - 1] == "+" or s[0] == "+" and any(d[:k] in _CODES for k in (1, 2)) else 0
    context = 1 if any(w in _TRIGGERS for w in before) else -1 if any(w in _AGAINST for w in before) else 0
    n = len(_digits(s))
    size = 1 if kind == "email" or kind == "ip" or n in (9, 10, 11, 12, 15, 16) else -1
    return strict, shape, listed, context, size


def span_features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: kind, its shape, its size and the words around it."""
    s = text[start:end]
    shape = re.sub(r"([9aA])\1+", r"\1", re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_A-Z]", "a", re.sub(r"[0-9]", "9", s))))[:24]
    before = _WORD.findall(text[max(0, start - 30):start].lower())[-2:]
    after = _WORD.findall(text[end:end + 30].lower())[:1]
    names = [f"k={kind}", f"s={kind}:{shape}", f"n={kind}:{len(_digits(s))}", f"l={kind}:{min(len(s) // 4, 12)}",
             *(f"b={w}" for w in before), *(f"a={w}" for w in after)]
    return [crc32(x.encode()) % HASHED for x in names]


def _overlaps(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    return any(span[0] < b and a < span[1] for a, b in others)


def candidates(text: str | None) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of one whole text; loose ones never overlap base ones."""
    if not text:
        return
    base = base_spans(text)
    taken = [x for k in BASE for x in base[k]]
    for k in BASE:
        for a, b in base[k]:
            yield k, a, b, True
    near: list[tuple[int, int]] = sorted(taken)
    at = 0
    for k, a, b in sorted(loose_spans(text), key=lambda x: x[1]):
        while at < len(near) and near[at][1] <= a:
            at += 1
        if not _overlaps((a, b), near[max(0, at - 4):at + 4]):
            yield k, a, b, False


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Expectation-maximisation over vote patterns: posteriors, and reliabilities [class, labeler, vote + 1].

    Votes are taken as independent given the class; pseudo-counts keep every rate above zero.
    """
    pats = sorted(counts)
    if not pats:
        return {}, np.full((2, LABELERS, 3), 1 / 3)
    v = np.array(pats) + 1
    n = np.array([counts[p] for p in pats], dtype=float)
    post = np.clip(0.5 + 0.2 * (v - 1).sum(axis=1), 0.05, 0.95)   # majority vote to begin with
    rates = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        share = np.stack([n * (1 - post), n * post])
        prior = (share.sum(axis=1) + 1) / (n.sum() + 2)
        for k in range(LABELERS):
            for c in (0, 1):
                rates[c, k] = np.bincount(v[:, k], weights=share[c], minlength=3) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        logp = np.log(prior)[:, None] + sum(np.log(rates[:, k, v[:, k]]) for k in range(LABELERS))
        post = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -500, 500)))
    return dict(zip(pats, post.tolist(), strict=True)), rates


def train(rows: list[tuple[list[int], float]], rounds: int = 200) -> np.ndarray:
    """Logistic weights (HASHED + bias) on soft labels; full-batch Adam, deterministic."""
    theta = np.zeros(HASHED + 1)
    if not rows:
        theta[HASHED] = -10.0
        return theta
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feat = np.array([x for f, _ in rows for x in f])
    y = np.array([p for _, p in rows])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(at, weights=theta[feat], minlength=len(rows)) + theta[HASHED]
        d = y - 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.append(np.bincount(feat, weights=d[at], minlength=HASHED), d.sum()) - 0.1 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return theta


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The span classifier's weights, from all candidates' vote counts and a bounded sample of spans."""
    schema = T.StructType([T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("h", T.LongType()),
                           T.StructField("feats", T.ArrayType(T.IntegerType()))])

    def run(texts: list) -> dict[str, list]:
        out: dict[str, list] = {"votes": [], "h": [], "feats": []}
        for t in texts:
            for k, a, b, base in candidates(t):
                out["votes"].append(list(votes(t, k, a, b, base)))
                out["h"].append(crc32(f"{a}:{t[max(0, a - 40):b + 40]}".encode()))
                out["feats"].append(span_features(t, k, a, b))
        return out

    seen = checkpoint(map_columns(docs.select(text_col), run, schema))
    counts = {tuple(r["votes"]): r["n"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    post, _ = estimate(counts)
    picked = seen.orderBy("h", "feats", "votes").limit(SAMPLE).collect()
    return train([(r["feats"], post[tuple(r["votes"])]) for r in picked])


def spans(text: str | None, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """Base spans and the loose ones that the classifier takes, by kind as listed, then start."""
    out = []
    for k, a, b, base in candidates(text):
        if base or weights[span_features(text, k, a, b)].sum() + weights[HASHED] > 0:
            out.append((k, a, b, base))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def report(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in xs)

    def run(ids: list, texts: list) -> dict[str, list]:
        found = [spans(t, weights) for t in texts]
        base = [[x for x in xs if x[3]] for xs in found]
        return {"doc_id": ids, **{f"n_{k}": [sum(x[0] == k for x in xs) for xs in base] for k in BASE},
                "base_sha256": [sha256(join(xs).encode()).hexdigest() for xs in base], "spans": [join(xs) for xs in found]}

    return map_columns(docs.select("doc_id", "text"), run, schema)


def redacted(text: str | None, weights: np.ndarray) -> str | None:
    """``text`` with every span replaced by its kind in brackets; overlapping spans as one."""
    found = sorted(spans(text, weights), key=lambda x: (x[1], -x[2]))
    if not found:
        return text
    out, at, end, kind = [], 0, -1, ""
    for k, a, b, _ in found:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"[{kind.upper()}]")
            at = end
        out.append(text[at:a])
        end, kind = b, k
    return "".join([*out, f"[{kind.upper()}]", text[end:]])


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text, and the length column brought up to date."""
    fields, replace = [T.StructField("__text", T.StringType())], {"__text": text_col}
    sized = size_col in docs.columns
    if sized:
        fields.append(T.StructField("__size", T.LongType()))
        replace["__size"] = size_col

    def run(texts: list, sizes: list | None = None) -> list[list]:
        new = [redacted(t, weights) for t in texts]
        if sizes is None:
            return [new]
        return [new, [s if a == b else len(b) for s, a, b in zip(sizes, texts, new, strict=True)]]

    return append_columns(docs, [text_col] + [size_col] * sized, run, fields, replace)
