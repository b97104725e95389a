"""Conversation repair: exhaustive edits, segments, Spark rows against one pass in memory."""
import itertools
import re
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricecast.llm import queries, turn_repair as tr
from pricecast.llm.common import table
from tests.conftest import SF01

WS = " \t\n\x0b\x0c\r"
FORM = re.compile("(s?(ua)+)?")


def faults(rows):
    """Fault of each (role, text), in order."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(WS)
        out.append(tr.BLANK if not bare else tr.DUPLICATE if (role, text) in seen else tr.TRUNCATED if bare[-1] not in ".!?" else tr.SOUND)
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) over all edits with up to two Inserts in each gap."""
    fault, options = faults(rows), []
    gaps = [[]] + [list(x) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    for (role, text), f in zip(rows, fault, strict=True):
        ways = [("D", 2, None)]
        if f not in (tr.BLANK, tr.DUPLICATE):
            dear = 5 * (f == tr.TRUNCATED)
            ways += [("K", dear, (role, text)), ("R", 1 + dear, ("user", text)), ("R", 1 + dear, ("assistant", text))]
        options.append(ways)
    best = None
    for ways in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(w[1] for w in ways) + 5 * sum(map(len, ins))
            if best is not None and cost > best[0]:
                continue
            audit, out = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(ins[k])
                out += [(r, "") for r in ins[k]]
                if k < len(rows):
                    audit += ways[k][0]
                    out += [ways[k][2]] if ways[k][2] else []
            if FORM.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                got = (cost, audit, out)
                best = got if best is None or got[:2] < best[:2] else best
    return best


def in_memory(rows, segment):
    """The operator's own steps without Spark, cut into segments."""
    listed = list(zip([r[:1] or tr.NO_ROLE for r, _ in rows], faults(rows), strict=True))
    parts = [listed[k:k + segment] for k in range(0, len(listed), segment)]
    ways, n = tr.segment_ways(parts[0]), len(parts[0])
    for p in parts[1:]:
        ways, n = tr.joined_ways(ways, n, tr.segment_ways(p), len(p)), n + len(p)
    cost, audit = tr.best(ways, n)
    out = []
    for k, (letters, state, before) in enumerate(tr.cut_letters(audit, "".join(x for x, _ in listed), segment)):
        assert before == len(out)
        out += [(r, t) for _, r, t in tr.edited(rows[k * segment:(k + 1) * segment], letters, state)]
    return cost, audit, out


ROWS = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.sampled_from(["Yes.", "no", " \t", "Go!", "A? "]))


@settings(max_examples=120, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=3))
def test_cheapest_edits_equal_exhaustion(rows):
    assert in_memory(rows, 10) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=40).map(lambda rows: [(r, f"{k % 9} {t}" if t.strip() else t) for k, (r, t) in enumerate(rows)]))
def test_segments_change_nothing(rows):
    whole = in_memory(rows, 100)
    for segment in (1, 2, 3, 7):
        assert in_memory(rows, segment) == whole


def test_order_of_letters_is_that_of_strings():
    bits = tr.width(3)
    words = ["".join(w) for n in range(4) for w in itertools.product("DIKR", repeat=n)]

    def number(word):
        way = 0
        for x in reversed(word):
            way = tr.put_first(tr.LETTERS.index(x), 0, way, bits)
        return way

    assert sorted(words) == sorted(words, key=number)
    assert all(tr.digits(number(w), bits) == len(w) for w in words)


def damaged(rows):
    """The contract's damage of (conv_id, turn, role, text), and its order, in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        said = [(r[2], r[3]) for r in own]
        f, turns = faults(said), [r[1] for r in own if r[1] is not None]
        cost, audit, left = in_memory(said, 10**6) if said else (0, "", [])
        initials = [r[:1] for r, _ in said]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count(1), f.count(2), f.count(3),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                     sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
MANY = [(9, k // 3, ("user", "assistant", "tool")[k % 5 % 3], f"say {k % 40}" + "." * (k % 3 > 0)) for k in range(700)]
ODD = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, None, "assistant", "First."), (1, 5, None, None),
       (2, None, None, None), (None, 3, "user", "Who?"), (None, 4, "assistant", "Me."), (None, None, "", "x" * 100_000), (3, 1, "user", "\x0b \r"),
       (4, 0, "assistant", "Yes."), *[(7, 2, "user", "Same.")] * 300]


@pytest.mark.parametrize(("segment", "fan"), [(256, 32), (3, 4)])
def test_spark_equals_one_pass_in_memory(spark, segment, fan):
    rows = ODD + MANY
    frame = (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
             .withColumn("_k", F.lit("clash")).withColumn("audit", F.lit(1)))
    hurt = tr.damage(frame)
    plans, turns = tr.repair(hurt, segment, fan)
    hashes = {r["_k"]: r["repaired_sha256"] for r in tr.digests(turns).collect()}
    got = {r["_k"]: (*(r[c] for c in NAMES), hashes.get(r["_k"], sha256(b"").hexdigest())) for r in plans.collect()}
    want = {"" if k is None else f"={k}": v for k, v in expected(rows).items() if damaged([r for r in rows if r[0] == k])}
    assert got == want


def test_query_equals_brute_force(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table(spark, SF01, "conversations").collect()]
    got = {r["conv_id"]: (*(r[c] for c in NAMES), r["repaired_sha256"]) for r in queries.QUERIES["op11_turn_repair"](spark, SF01).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    plans, turns = tr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert plans.count() == 0 and turns.count() == 0 and tr.digests(turns).count() == 0
