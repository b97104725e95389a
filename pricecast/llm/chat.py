"""Chat formatting by incremental black-box rendering (operator 7).

A template is any function from a list of (role, text) turns to one string. It is never
inspected: successive prefixes of a conversation are rendered, each output is compared with the
one before it, and what was appended is the new turn's span. Rendering the prefix once more
with a one-character probe in place of the turn's text tells where in that span the text lies.
A prefix whose output does not begin with the previous output has rewritten history; such
conversations are flagged and keep no loss spans.

``chatml`` marks turns with control strings and escapes them inside texts and roles by a
reversible rule, so ``read_back`` recovers every turn from the output alone.

Rows are brought together by conversation and sorted there; a task holds one conversation at a
time. Black-box rendering of every prefix takes time quadratic in a conversation's length.

Defined cases: null text or role is empty; turns are ordered by turn, then role, then text
(nulls first), so ties and repeated rows have one order and all count; rows with a null
conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>"
PROBES = range(0xE000, 0x110000)     # private-use characters first
LOSS_ROLE = "assistant"

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ROLE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""``<|`` becomes ``<\|``; one more backslash where there were some already."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(turns: list[Turn]) -> str:
    return "".join(f"{START}{_role(r)}\n{escape(t)}{END}\n" for r, t in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a ``chatml`` output; raises if anything of it lies outside the turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_unrole(m[1]), unescape(m[2])))
        at = m.end()
    return out


def spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, text span of each turn, whether the template rewrote an earlier turn)."""
    before, found = "", []
    for k in range(1, len(turns) + 1):
        out = render(turns[:k])
        mark = next(chr(c) for c in PROBES if chr(c) not in out)     # also absent from roles
        probe = render([*turns[:k - 1], (turns[k - 1][0], mark)])
        if not out.startswith(before) or not probe.startswith(before):
            return render(turns), [], True
        at = probe.find(mark, len(before))
        tail = len(probe) - at - 1
        if at < 0 or probe[:at] != out[:at] or (tail and out[-tail:] != probe[-tail:]):
            return render(turns), [], True
        found.append((at, len(out) - tail))
        before = out
    return before, found, False


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()),
                       T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                       T.StructField("loss", T.ArrayType(T.ArrayType(T.LongType()))),
                       T.StructField("rewrites", T.BooleanType())])


def format_conversations(rows: DataFrame, render: Callable[[list[Turn]], str] = chatml) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``: conv_id, formatted text, the
    code-point spans of all turns' texts, those under the loss mask, and the rewriting flag."""
    arrow = to_arrow_schema(SCHEMA)

    def finish(conv, turns: list[Turn]) -> dict:
        out, found, rewrites = spans(turns, render)
        return {"conv_id": conv, "formatted": out, "spans": [list(x) for x in found], "rewrites": rewrites,
                "loss": [list(x) for x, (role, _) in zip(found, turns, strict=False) if role == LOSS_ROLE]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, begun, done = None, [], False, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if begun and c != conv:
                    done.append(finish(conv, turns))
                    turns = []
                conv, begun = c, True
                turns.append((role or "", text or ""))
                if len(done) >= 500:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
        if begun:
            done.append(finish(conv, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return (own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, SCHEMA))
