"""Conversation structure repair by big-integer weights (operator 11).

Row edits (Keep, Rerole, Delete) and Insert bring a conversation's role initials into the form
``(s?(ua)+)?`` at least cost, ties by the ASCII-least string of edit initials. A way through
rows is one integer: its high digits are the cost, below them stand the edit letters, one
fixed-width digit each, first letter first, zeros to the end. Letters rank as in ASCII and zero
is below all, so the least integer is the cheapest way, and among these the least string, a
string coming before those it begins. A dynamic programme over (row, state of the form) takes
plain integer minima, last row first; to put a letter in front moves the others one digit down.

One Insert at most stands before a row or at the end. More are never cheapest: two in a row pass
from u to u, from a to a, from the start to where the start leads as well, or follow a kept s,
which is cheaper deleted.

No conversation is held whole. Rows are ranked by a range partitioning and cut into segments of
``SEGMENT`` rows. A segment's result is the least integer from every state to every state;
neighbours combine by adding costs and appending letters, ``FAN`` at a time, until one is left.
Equally cheap ways through a segment never begin one another (they hold as many letters for
rows, and an Insert costs), so the least of the parts make the least whole. The letters then go
back to the segments, which are edited separately. Equal rows are counted before they are
ranked, so that many of them are spread as well.

Defined cases: null role or text is one space; a null conversation id is a conversation of its
own; rows are ordered by turn (nulls first), then role, then text, so ties and repeated rows have
one order; a role's initial is its first character, none for an empty role; an empty table
gives no rows; extra columns are not looked at. A conversation's letters are one value of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pricecast.llm.common import checkpoint
from pricecast.operators.order import with_positions

SEGMENT, FAN = 256, 32
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4        # in ASCII order of the initials; zero ends a string
LETTERS = "\0DIKR"
DIGIT = 3                                        # bits
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
#: States of the form: nothing yet, after s, after u, after a.
START, S, U, A = STATES = range(4)
NEXT = {START: U, S: U, U: A, A: U}              # where an Insert or Rerole leads
ON_KEEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ROLE = {U: "user", A: "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
NO_ROLE = "\0"       # stands for the initial of an empty role


# --- weights

def width(n: int) -> int:
    """Bits of the letters of ``n`` rows: each and the end may have an Insert."""
    return DIGIT * (2 * n + 1)


def put_first(letter: int, cost: int, way: int, bits: int) -> int:
    """The way with a letter in front."""
    spent, letters = way >> bits, way & ((1 << bits) - 1)
    return (spent + cost) << bits | letter << (bits - DIGIT) | letters >> DIGIT


def digits(letters: int, bits: int) -> int:
    """How many letters there are."""
    return -(-(bits - ((letters & -letters).bit_length() - 1)) // DIGIT) if letters else 0


def join_ways(a: int, n_a: int, b: int, n_b: int) -> int:
    """One way after the other, as a way through n_a + n_b rows."""
    wa, wb, bits = width(n_a), width(n_b), width(n_a + n_b)
    la, lb = a & ((1 << wa) - 1), b & ((1 << wb) - 1)
    return ((a >> wa) + (b >> wb)) << bits | la << (bits - wa) | lb << (bits - wb - DIGIT * digits(la, wa))


def segment_ways(rows: list[tuple[str, int]]) -> list[int | None]:
    """Least way from each state to each state, at 4 * from + to, through rows of (initial, fault)."""
    bits = width(len(rows))
    out: list[int | None] = [None] * 16
    for end in STATES:
        after: list[int | None] = [0 if q == end else None for q in STATES]
        for initial, fault in reversed(rows):
            dear = TRUNCATED_COST if fault == TRUNCATED else 0
            own: list[int | None] = []
            for q in STATES:
                ways = []
                if after[q] is not None:
                    ways.append(put_first(DELETE, COSTS[DELETE], after[q], bits))
                if fault not in (BLANK, DUPLICATE):
                    to = ON_KEEP.get((q, initial))
                    if to is not None and after[to] is not None:
                        ways.append(put_first(KEEP, COSTS[KEEP] + dear, after[to], bits))
                    if after[NEXT[q]] is not None:
                        ways.append(put_first(REROLE, COSTS[REROLE] + dear, after[NEXT[q]], bits))
                own.append(min(ways, default=None))
            after = []
            for q in STATES:
                ways = [] if own[q] is None else [own[q]]
                if own[NEXT[q]] is not None:
                    ways.append(put_first(INSERT, COSTS[INSERT], own[NEXT[q]], bits))
                after.append(min(ways, default=None))
        for q in STATES:
            out[4 * q + end] = after[q]
    return out


def joined_ways(a: list[int | None], n_a: int, b: list[int | None], n_b: int) -> list[int | None]:
    return [min((join_ways(a[4 * q + m], n_a, b[4 * m + end], n_b) for m in STATES
                 if a[4 * q + m] is not None and b[4 * m + end] is not None), default=None)
            for q in STATES for end in STATES]


def best(ways: list[int | None], n: int) -> tuple[int, str]:
    """(cost, letters) of the least way from the start to an accepted end."""
    bits = width(n)
    done = [ways[q] for q in (START, A) if ways[q] is not None]
    if ways[U] is not None:
        letters = ways[U] & ((1 << bits) - 1)
        done.append(ways[U] + (COSTS[INSERT] << bits) + (INSERT << (bits - DIGIT * (digits(letters, bits) + 1))))
    way = min(done)     # all rows deleted is one
    letters = way & ((1 << bits) - 1)
    count = digits(letters, bits)
    octal = f"{letters >> (bits - DIGIT * count):o}".zfill(count) if count else ""
    return way >> bits, octal.translate(_NAMES)


_NAMES = {ord(str(k)): LETTERS[k] for k in (DELETE, INSERT, KEEP, REROLE)}


def edited(rows: list[tuple[str, str]], letters: str, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what is left of rows of (role, text) and what is put in."""
    out, at = [], 0
    for x in letters:
        if x == "I":
            state = NEXT[state]
            out.append((x, ROLE[state], ""))
            continue
        role, text = rows[at]
        at += 1
        if x == "K":
            state = ON_KEEP[state, role[:1]]
            out.append((x, role, text))
        elif x == "R":
            state = NEXT[state]
            out.append((x, ROLE[state], text))
    return out


# --- Spark

def conversation_key(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _own(rows: DataFrame) -> DataFrame:
    return rows.select(conversation_key(F.col("conv_id")).alias("_k"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))


def ranked(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows in order: _k, conv_id, turn, role, text, _pos, _segment, _fault; written."""
    counted = _own(rows).groupBy("_k", "conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_m"))
    each = counted.select("_k", "conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "_m")).alias("_copy"))
    placed = checkpoint(with_positions(each, ["_k"], ["turn", "role", "text", "_copy"])
                        .select("_k", "conv_id", "turn", "role", "text", "_pos",
                                F.floor(F.col("_pos") / segment).alias("_segment"),
                                F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256).alias("_said")))
    again = checkpoint(placed.groupBy("_k", "_said").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_times"))
                       .where(F.col("_times") > 1).drop("_times"))
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
             .when(F.col("_pos") > F.col("_first"), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(SOUND))
    return checkpoint(placed.join(again, ["_k", "_said"], "left").withColumn("_fault", fault).drop("_said", "_first"))


_LONG = T.LongType()
SEGMENTS = T.StructType([T.StructField("_k", T.StringType()), T.StructField("_segment", _LONG), T.StructField("n", _LONG),
                         *(T.StructField(c, _LONG) for c in ("blank", "duplicate", "truncated", "illegal")),
                         T.StructField("initials", T.StringType()),
                         *(T.StructField(c, _LONG) for c in ("min_turn", "max_turn", "turns")),
                         T.StructField("ways", T.ArrayType(T.BinaryType()))])


def _stored(ways: list[int | None]) -> list[bytes | None]:
    return [None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "big") for w in ways]


def _loaded(ways: list[bytes | None]) -> list[int | None]:
    return [None if w is None else int.from_bytes(w, "big") for w in ways]


def _groups(df: DataFrame, keys: list[str], order: str, fn: Callable[[list[dict]], list[dict]], schema: T.StructType,
            batch_rows: int = 2000) -> DataFrame:
    """``fn`` over the rows of each group, in order; a task holds one group at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if held and now != at:
                    done += fn(held)
                    held = []
                    if len(done) >= batch_rows:
                        yield pa.RecordBatch.from_pylist(done, schema=arrow)
                        done = []
                at = now
                held.append(row)
        if held:
            done += fn(held)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _first_pass(rows: list[dict]) -> list[dict]:
    faults = [r["_fault"] for r in rows]
    initials = [r["role"][:1] or NO_ROLE for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return [{"_k": rows[0]["_k"], "_segment": rows[0]["_segment"], "n": len(rows), "blank": faults.count(BLANK),
             "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
             "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
             "initials": "".join(initials), "min_turn": turns[0] if turns else None,
             "max_turn": turns[-1] if turns else None, "turns": len(set(turns)),
             "ways": _stored(segment_ways(list(zip(initials, faults, strict=True))))}]


def _joined(parts: list[dict]) -> list[dict]:
    out = {**parts[0], "_segment": parts[0]["_up"]}
    ways = _loaded(out["ways"])
    for p in parts[1:]:
        ways = joined_ways(ways, out["n"], _loaded(p["ways"]), p["n"])
        shared = p["min_turn"] is not None and p["min_turn"] == out["max_turn"]
        out["illegal"] += p["illegal"] + (out["initials"][-1] + p["initials"][0] not in LEGAL)
        out["turns"] += p["turns"] - shared
        for c in ("n", "blank", "duplicate", "truncated", "initials"):
            out[c] += p[c]
        out["min_turn"] = p["min_turn"] if out["min_turn"] is None else out["min_turn"]
        out["max_turn"] = out["max_turn"] if p["max_turn"] is None else p["max_turn"]
    return [{**out, "ways": _stored(ways)}]


PLAN = T.StructType([T.StructField("_k", T.StringType()),
                     *(T.StructField(c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     T.StructField("audit", T.StringType()), T.StructField("initials", T.StringType())])


def _finished(parts: list[dict]) -> list[dict]:
    p = parts[0]
    cost, audit = best(_loaded(p["ways"]), p["n"])
    gaps = 0 if p["min_turn"] is None else p["max_turn"] - p["min_turn"] + 1 - p["turns"]
    return [{"_k": p["_k"], "gaps": gaps, "cost": cost, "audit": audit,
             **{c: p[c] for c in ("blank", "duplicate", "truncated", "illegal", "initials")}}]


def plan(placed: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``ranked`` rows: faults, least cost and the letters of its edits; written."""
    lean = placed.select("_k", "_segment", "_pos", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("role"), "_fault")
    parts = checkpoint(_groups(lean, ["_k", "_segment"], "_pos", _first_pass, SEGMENTS))
    while (parts.agg(F.max("_segment")).first()[0] or 0) > 0:
        up = parts.withColumn("_up", F.floor(F.col("_segment") / fan))
        parts = checkpoint(_groups(up, ["_k", "_up"], "_segment", _joined, SEGMENTS, batch_rows=1))
    return checkpoint(_groups(parts, ["_k"], "_segment", _finished, PLAN, batch_rows=100))


PARTS = T.StructType([T.StructField("_k", T.StringType()), T.StructField("_segment", _LONG), T.StructField("_letters", T.StringType()),
                      T.StructField("_state", T.IntegerType()), T.StructField("_before", _LONG)])
TURNS = T.StructType([T.StructField("_k", T.StringType()), T.StructField("seq", _LONG), T.StructField("edit", T.StringType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def cut_letters(audit: str, initials: str, segment: int) -> list[tuple[str, int, int]]:
    """(letters, state before, turns left before) of each segment of a conversation whose rows' initials are given."""
    out, state, left, row, begun = [], START, 0, 0, (0, START, 0)
    for at, x in enumerate(audit):
        if x != "D":
            left += 1
            state = ON_KEEP[state, initials[row]] if x == "K" else NEXT[state]
        if x != "I":
            row += 1
            if row % segment == 0 and row < len(initials):
                out.append((audit[begun[0]:at + 1], *begun[1:]))
                begun = (at + 1, state, left)
    return [*out, (audit[begun[0]:], *begun[1:])]


def _edit(rows: list[dict]) -> list[dict]:
    first, *rows = rows     # the segment's letters stand before its rows
    left = edited([(r["role"], r["text"]) for r in rows], first["_letters"], first["_state"])
    return [{"_k": first["_k"], "seq": first["_before"] + k, "edit": x, "role": role, "text": text}
            for k, (x, role, text) in enumerate(left)]


def repaired(placed: DataFrame, plans: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The turns that are left of ``ranked`` rows by their plans: _k, seq (from 0), edit, role, text."""
    def cut(found: list[dict]) -> list[dict]:
        return [{"_k": p["_k"], "_segment": k, "_letters": letters, "_state": state, "_before": before}
                for p in found for k, (letters, state, before) in enumerate(cut_letters(p["audit"], p["initials"], segment))]

    parts = _groups(plans.select("_k", "audit", "initials"), ["_k"], "audit", cut, PARTS)
    rows = placed.select("_k", "_segment", "_pos", "role", "text")
    both = parts.withColumn("_pos", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True)
    return _groups(both, ["_k", "_segment"], "_pos", _edit, TURNS)


def repair(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """For ``rows(conv_id, turn, role, text)``: (plans, repaired turns), both keyed by ``conversation_key``."""
    placed = ranked(rows, segment)
    plans = plan(placed, fan)
    return plans, repaired(placed, plans, segment)


def digests(turns: DataFrame) -> DataFrame:
    """(_k, repaired_sha256) of ``role:text`` lines; a conversation streams through one task, batch by batch."""
    schema = T.StructType([T.StructField("_k", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("_k", "role", "text")), strict=True):
                if state is not None and k != at:
                    keys.append(at)
                    found.append(state.hexdigest())
                    state = None
                line = f"{role}:{text}"
                state, line = (sha256(), line) if state is None else (state, "\n" + line)
                state.update(line.encode())
                at = k
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], schema=arrow)

    return turns.repartition("_k").sortWithinPartitions("_k", "seq").mapInArrow(run, schema)


# --- damage, to have something to repair

def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` mod 20: 0 drops, 1 empties, 2 takes the stops, 3 repeats, 4 makes a user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hit = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                      (F.crc32(key) % 20).alias("_hit")).where(F.col("_hit") != 0)
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.explode(copies).alias("_c")).drop("_c")
