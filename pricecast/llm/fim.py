"""Fill-in-middle transformation by repeated-capture matching (operator 12).

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the group, so
``match.ends(1)`` alone gives the number of units and the offset of either cut; no loop goes over
the text. A unit is any pattern (default: one code point); units are taken left to right and never
given back.

The cuts, the choice of form and its share come from the SHA-256 of ``seed:id``, so a row's result
depends on nothing but the row. There is no shuffle; a task holds a chunk of rows.

The library keeps a few million captures of one match at most, so a text of more than ``REACH``
code points is matched in consecutive stretches of that length; the last unit of a stretch, which
its end may have cut, is matched again at the head of the next one. Results are those of one match.

Defined cases: null and empty texts are plain, with n = 0; so is a text that holds one of the
marks, or that the units do not cover whole (n = 0 then, too); a null id is hashed as an empty one;
repeated rows get equal results; an empty table gives no rows; extra columns are kept, and added
columns take fresh names.
"""

from __future__ import annotations

from array import array
from hashlib import sha256

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import append_columns, fresh_name

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"
REACH = 1_000_000
PLAIN_FROM, SPM_BELOW = 90, 20      # of 100


def unit_ends(text: str, units: regex.Pattern, reach: int = REACH) -> list[int] | array | None:
    """End offset of every unit of ``text``, or None when units do not cover it whole."""
    if len(text) <= reach:
        m = units.fullmatch(text)
        return m.ends(1) if m else None
    found, at, span = array("q"), 0, reach
    while at + span < len(text):
        ends = units.match(text, at, at + span).ends(1)[:-1]
        found.extend(ends)
        span = reach if ends else 2 * span      # a unit longer than the stretch
        at = ends[-1] if ends else at
    last = units.fullmatch(text, at)
    if last is None:
        return None
    found.extend(last.ends(1))
    return found


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row's id."""
    h = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k:k + 4], "big") for k in (0, 4, 8, 12))


def rearrange(doc_id, text: str | None, units: regex.Pattern, seed: int = 1,
              reach: int = REACH) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, code points of the prefix, of the middle, output) of one row."""
    text = text or ""
    ends = unit_ends(text, units, reach)
    n = len(ends or ())
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
              reach: int = REACH) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n, form, prefix_chars, middle_chars and output added, and the names they got."""
    names = {k: fresh_name(docs, f"fim_{k}") for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    fields = [T.StructField(c, t) for c, t in zip(names.values(), kinds, strict=True)]
    units = regex.compile(f"(?:({unit}))*+")

    def run(ids: list, texts: list) -> list[list]:
        got = [rearrange(i, t, units, seed, reach) for i, t in zip(ids, texts, strict=True)]
        return [list(c) for c in zip(*got, strict=True)] or [[] for _ in fields]

    return append_columns(docs, [id_col, text_col], run, fields), names


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone: the marks occur once each in a rearranged output."""
    part = F.split(output, "|".join(MARKS), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
