"""Fill-in-middle: brute force, round trip, stretches."""
from hashlib import sha256

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricecast.llm import fim
from tests.llm.test_text_ops import docs

POINT = regex.compile(f"(?:({fim.CODE_POINT}))*+")
WORD = r"\s*[^\s]++(?:\s++$)?"


def brute(doc_id, text):
    text = text or ""
    hexed = sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="ab\n<PSM>é😀́ \r", max_size=30))
def test_rows_equal_brute_force(doc_id, text):
    assert fim.rearrange(doc_id, text, POINT) == brute(doc_id, text)
    assert fim.rearrange(doc_id, text, POINT, reach=4) == brute(doc_id, text)


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\X", WORD, r"[^\n]*\n|[^\n]+"])
def test_stretches_change_nothing(unit):
    units = regex.compile(f"(?:({unit}))*+")
    for text in ("", "one two  three\nfour é́̂ five ", "x" * 40 + " y", "\n\n a \n"):
        whole = fim.unit_ends(text, units)
        for reach in (1, 2, 3, 7, 16):
            got = fim.unit_ends(text, units, reach)
            assert (got is None) == (whole is None) and list(got or ()) == list(whole or ())


def test_units_must_cover_the_text():
    assert fim.rearrange(1, "ab1", regex.compile("(?:([a-z]))*+")) == (0, "plain", None, None, "ab1")


def test_very_long_text_has_all_its_units():
    text = "aé" * 3_000_000     # more captures than the library keeps in one match
    assert fim.rearrange(7, text, POINT) == brute(7, text)


TEXTS = ["plain words here", None, "", "has <M> inside", "<P", "é😀" * 5, "plain words here", "a\r\nb\n", "x" * 300_000]


def test_transform_and_restore(spark):
    frame = docs(spark, TEXTS * 4).withColumn("fim_output", F.lit("clash"))
    got, names = fim.transform(frame)
    assert got.columns[:len(frame.columns)] == frame.columns and names["output"] != "fim_output"
    back = fim.restore(F.col(names["output"]), F.col(names["form"])).alias("back")
    rows = got.select("*", back).collect()
    assert len(rows) == 4 * len(TEXTS) + 1
    for r in rows:
        want = brute("" if r["doc_id"] is None else r["doc_id"], r["text"])
        assert tuple(r[names[k]] for k in ("n", "form", "prefix_chars", "middle_chars", "output")) == want
        assert r["back"] == (r["text"] or "") and r["fim_output"] == "clash"
    assert {r[names["form"]] for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(docs(spark, []).where("doc_id is not null"))[0].count() == 0
