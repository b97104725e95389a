"""Secret scans over a trigram inverted index (operator 13).

* ``trigram_query`` reads a rule's parsed pattern and derives a Boolean query: alternatives
  (OR) of trigram sets (AND) of which at least one must occur whole in any text the pattern
  matches. Trigrams are of UTF-8 bytes with A-Z folded, so a query serves either case.
* ``postings`` is the index: one row per (trigram, document key), each document's trigrams once,
  written sorted by trigram, so a search reads the row groups of its own trigrams. ``scan`` restricts
  it to the trigrams that its rules ask for; built without that it serves any later rules.
* ``candidates`` intersects the lists: every posting marks its place in each alternative that
  asks for it, marks are united per (document key, alternative) before and after the shuffle, and
  an alternative with all its places marked makes the document a candidate of the rule.
* ``scan`` runs a rule's pattern over its candidates only; a rule without mandatory trigrams
  (``hex``: a class repeated) scans every text whole.

The document key hashes id and text. Rows that share a key (repeated rows) share their
candidature, and a collision only adds a candidate, as every candidate is verified. The candidates
are a written table of (key, rules), so the planner knows its size: under the broadcast threshold
no text is moved; above it the join on the key moves each text once, and adaptive execution may
split a key that many equal rows share. Rules are a fixed list, so the alternatives, which are
broadcast, are bounded by it.

Patterns are written so that a match cannot start again inside a run it has failed on; scanning is
linear in a text.

Defined cases: null and empty texts have no spans; rows with a null id, ties and repeated rows are
scanned each; very long texts are scanned whole; an empty table gives no rows; extra columns are kept,
and added columns take fresh names. "Either case" is that of ASCII letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import append_columns, checkpoint, fresh_name, map_columns


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group (0: whole match) of a true match."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base kinds; their spans are those of the contract.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),      # what `[0-9a-f]+` matches with 24 characters or more
)
#: Fixed, publicly documented token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{50,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("temporary", r"ASIA[A-Z0-9]{16,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEIcHlwaS[A-Za-z0-9_-]{20,}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    Rule("login_url", r"(?<=://)[^\s:/@]++:[^\s:/@]++@"),
    Rule("bearer", r"(?i:authorization)[\"']?\x20*:\x20*[\"']?(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
)
RULES = BASE + MORE

# --- Boolean trigram queries

#: Bounds of the derivation; beyond them a query asks for less, never for more.
STRINGS, ALTERNATIVES, PLACES = 64, 64, 62

Query = frozenset[frozenset[bytes]]      # any of (all of)
ANY: Query = frozenset([frozenset()])


def fold(text: bytes) -> bytes:
    return text.lower()     # of bytes: A-Z only


def _both(a: Query, b: Query) -> Query:
    """Queries that must both hold; the more selective one alone when the product grows too large."""
    out = {x | y for x in a for y in b}
    out = frozenset(x for x in out if not any(y < x for y in out))
    return out if len(out) <= ALTERNATIVES else max(a, b, key=lambda q: min(map(len, q)))


def _of_strings(strings: set[bytes]) -> Query:
    """At least one of the strings occurs."""
    out = {frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings}
    return ANY if frozenset() in out else frozenset(x for x in out if not any(y < x for y in out))


def _class_strings(members: list) -> set[bytes] | None:
    """The folded characters of a class, or None when they are many."""
    found = set()
    for op, arg in members:
        if op is sre.LITERAL:
            found.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < STRINGS:
            found.update(range(arg[0], arg[1] + 1))
        else:       # negation, categories, wide ranges
            return None
    out = {fold(chr(c).encode("utf-8", "surrogatepass")) for c in found}
    return out if len(out) <= 8 else None


class _Run:
    """A sequence read from the left: the query so far, and the strings that the part since the last gap may be."""

    def __init__(self) -> None:
        self.query, self.strings, self.exact = ANY, {b""}, True

    def add(self, strings: set[bytes]) -> None:
        made = {a + b for a in self.strings for b in strings}
        if len(made) > STRINGS:
            self.gap()
            made = set(strings)
        self.strings = made

    def gap(self) -> None:
        self.query = _both(self.query, _of_strings(self.strings))
        self.strings, self.exact = {b""}, False

    def also(self, query: Query) -> None:
        self.query = _both(self.query, query)


def _read(nodes, run: _Run, caseless: bool) -> None:
    for op, arg in nodes:
        if op is sre.LITERAL:
            c = chr(arg)
            run.add({fold(c.encode("utf-8", "surrogatepass"))}) if not caseless or c.isascii() else run.gap()
        elif op is sre.IN and (got := _class_strings(arg)) is not None and not (caseless and any(max(s) > 127 for s in got)):
            run.add(got)
        elif op is sre.SUBPATTERN:
            _, on, off, body = arg
            _read(body, run, (caseless or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
        elif op is sre.ATOMIC_GROUP:
            _read(arg, run, caseless)
        elif op is sre.BRANCH:
            ways = [_Run() for _ in arg[1]]
            for way, body in zip(ways, arg[1], strict=True):
                _read(body, way, caseless)
            if all(w.exact for w in ways):
                run.add(set().union(*(w.strings for w in ways)))
            else:
                run.gap()
                for w in ways:
                    w.gap()
                joined = frozenset().union(*(w.query for w in ways))
                run.also(ANY if frozenset() in joined or len(joined) > ALTERNATIVES else joined)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            one = _Run()
            _read(body, one, caseless)
            if (low, high) == (0, 1) and one.exact:
                run.add({b"", *one.strings})
            elif one.exact and low:
                for _ in range(min(low, 8)):
                    run.add(one.strings)
                if low != high or low > 8:
                    run.gap()
            else:
                run.gap()
                if low:
                    one.gap()
                    run.also(one.query)
        elif op is sre.ASSERT:          # what a look-around asks for lies outside the sequence
            seen = _Run()
            _read(arg[1], seen, caseless)
            seen.gap()
            run.also(seen.query)
        elif op not in (sre.AT, sre.ASSERT_NOT):
            run.gap()


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigram sets; the set without a trigram means that any text may match."""
    tree = _parser.parse(pattern)
    run = _Run()
    _read(tree, run, bool(tree.state.flags & re.IGNORECASE))
    run.gap()
    return run.query


# --- index

KEY = T.StructField("key", T.LongType())
POSTINGS = T.StructType([T.StructField("trigram", T.IntegerType()), KEY])


def code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


def trigrams(text: str | None) -> np.ndarray:
    """Code of the trigram at every byte."""
    b = np.frombuffer(fold((text or "").encode()), dtype=np.uint8).astype(np.int32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.zeros(0, dtype=np.int32)


@lru_cache(maxsize=1)
def _places(wanted: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The wanted codes, and the place in them (from 1; 0: not wanted) of every code."""
    codes = np.array(wanted, dtype=np.int32)
    place = np.zeros(1 << 24, dtype=np.uint16)
    place[codes] = np.arange(1, len(codes) + 1)
    return codes, place


def _among(codes: np.ndarray, wanted: tuple[int, ...] | None) -> np.ndarray:
    """The distinct codes, those wanted only."""
    if wanted is None:
        return np.unique(codes)
    listed, place = _places(wanted)
    return listed[np.flatnonzero(np.bincount(place[codes], minlength=len(listed) + 1)[1:])]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def postings(docs: DataFrame, only: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a written table (trigram, key); ``only`` restricts it to these trigram codes."""
    wanted = None if only is None else tuple(sorted(set(only)))

    def run(keys: list, texts: list) -> dict[str, list]:
        grams, at = [], []
        for key, text in zip(keys, texts, strict=True):
            found = _among(trigrams(text), wanted)
            grams.append(found)
            at.append(np.full(len(found), key, dtype=np.int64))
        return {"trigram": np.concatenate(grams), "key": np.concatenate(at)}

    own = docs.select(_keyed(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return checkpoint(map_columns(own, run, POSTINGS).sortWithinPartitions("trigram", "key"))


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(key, rules): documents that fulfil a query, and which of the queries as bits."""
    asked, needs = [], []
    for rule, alternatives in enumerate(queries):
        for chosen in sorted(sorted(x)[:PLACES] for x in alternatives):
            needs.append((len(needs), 1 << rule, (1 << len(chosen)) - 1))
            asked += [(code(t), len(needs) - 1, 1 << place) for place, t in enumerate(chosen)]
    spark = index.sparkSession
    marks = F.broadcast(spark.createDataFrame(asked, "trigram int, alternative int, mark long"))
    need = F.broadcast(spark.createDataFrame(needs, "alternative int, rule long, need long"))
    wanted = sorted({t for t, _, _ in asked})
    met = (index.where(F.col("trigram").isin(wanted)).join(marks, "trigram")
           .groupBy("key", "alternative").agg(F.bit_or("mark").alias("marks")))
    return (met.join(need, "alternative").where(F.col("marks") == F.col("need"))
            .groupBy("key").agg(F.bit_or("rule").alias("rules")))


# --- verification

def rule_spans(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, too short ones dropped."""
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
         index: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``docs`` with the spans of all rules added, by start, then rule; and that column's name.

    ``index`` is a table of ``postings`` over the same documents, if one is kept.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    sought = [k for k, q in enumerate(queries) if frozenset() not in q]
    if len(sought) > 62:
        raise ValueError("at most 62 rules with mandatory trigrams in one scan")
    full = sum(1 << k for k, q in enumerate(queries) if frozenset() in q)
    key, mask, spans = (fresh_name(docs, f"secret_{k}") for k in ("key", "rules", "spans"))
    found = docs.withColumn(mask, F.lit(None).cast("long"))
    if sought:
        if index is None:
            index = postings(docs, [code(t) for k in sought for x in queries[k] for t in x], id_col, text_col)
        hits = checkpoint(candidates(index, [queries[k] for k in sought])
                          .select(F.col("key").alias(key), F.col("rules").alias(mask)))
        found = docs.withColumn(key, _keyed(docs, id_col, text_col)).join(hits, key, "left").drop(key)
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]

    def run(texts: list, masks: list) -> list[list]:
        out = []
        for text, m in zip(texts, masks, strict=True):
            own = [k for j, k in enumerate(sought) if (m or 0) >> j & 1] + [k for k in range(len(rules)) if full >> k & 1]
            got = [(a, k, b) for k in own for a, b in rule_spans(rules[k], compiled[k], text or "")]
            out.append([{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(got)])
        return [out]

    got = append_columns(found, [text_col, mask], run, [T.StructField(spans, SPANS)])
    return got.drop(mask), spans


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; overlapping spans are one."""
    got, spans = scan(docs, rules, id_col, text_col)

    def run(texts: list, found: list) -> list[list]:
        out = []
        for text, marked in zip(texts, found, strict=True):
            parts, at = [], 0
            for s in marked:
                if s["start"] >= at:
                    parts += [text[at:s["start"]], "[SECRET]"]
                at = max(at, s["end"])
            out.append("".join(parts) + text[at:] if marked else text)
        return [out]

    return append_columns(got, [text_col, spans], run, [T.StructField("text", T.StringType())], {"text": text_col}).drop(spans)

