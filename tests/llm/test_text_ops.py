"""Row operators against brute force: PII, licences, decontamination, chat, toxicity, quality."""
import re
import time
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm import chat, decontam, license_scan, pii, quality, queries, toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("score", T.StringType()), T.StructField("kind", T.StringType())])


def docs(spark, texts):
    """Texts as documents with extra, clashing columns; the last row has null everywhere."""
    rows = [(i, t, "en", "s", len(t or ""), "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None)], DOCS)


# --- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+_%1 é\n", max_size=60))
def test_emails_equal_the_pattern(text):
    assert list(pii._emails(text)) == [m.span() for m in EMAIL.finditer(text)]


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute_base(text):
    out = {"email": [m.span() for m in EMAIL.finditer(text)], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out["phone"].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.+-() @a", max_size=70))
def test_base_spans_equal_brute_force(text):
    assert pii.base_spans(text) == brute_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "255", "256", "0", ".", "..", " ", "12" * 20, "-", "+"]), max_size=25).map("".join))
def test_base_spans_over_digit_runs(text):
    assert pii.base_spans(text) == brute_base(text)


@pytest.mark.parametrize("text", ["7" * 10**6, "1." * 500_000, "+" * 10**6, "1 " * 500_000, "1(" * 500_000, "+1" + "(" * 10**6, "a@" * 500_000, "1-" * 500_000])
def test_spans_of_long_runs_are_linear(text):
    begun = time.perf_counter()
    pii.base_spans(text)
    pii.loose_spans(text)
    assert time.perf_counter() - begun < 3


PII_TEXTS = ["mail a.b@c.example.com and 10.0.0.255, 4111 1111 1111 1111.", "call +49 (30) 123456-78 now, 300.1.1.1", None, "",
             "x" * 200_000 + "@", "4111111111111112 +1234", "phone 555-123-4567 or jo [at] site [dot] org", "a@b.c" * 2,
             "mail a.b@c.example.com and 10.0.0.255, 4111 1111 1111 1111."]


def test_spelt_addresses_are_whole():
    for local, label in (("jane", "internationalconglomerateholdings"), ("j" * 300, "mail"), ("jane", "h" * 63)):
        address = f"{local} [at] mail [dot] {label} [dot] com"
        text = f"write to {address} today"
        assert pii.loose_spans(text) == [("email", 9, 9 + len(address))]


def test_pii_report_and_redaction(spark):
    frame = docs(spark, PII_TEXTS)
    weights = pii.fit(frame)
    got = {r["doc_id"]: r for r in pii.report(frame, weights).collect()}
    assert len(got) == len(PII_TEXTS) + 1
    for i, t in enumerate(PII_TEXTS):
        want = brute_base(t or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert got[i]["base_sha256"] == sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(got[i]["spans"].split(","))
    clean = {r["doc_id"]: r for r in pii.redact(frame, weights).collect()}
    assert pii.redact(frame, weights).schema == frame.schema
    assert clean[0]["text"] == "mail [EMAIL] and [IP], [CARD]." and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[2]["text"] is None and clean[3]["text"] == "" and clean[None]["n_chars"] is None


def test_label_model_tells_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    counts: dict = {}
    hit = 0
    votes = []
    for y in truth:
        v = tuple(int((1 if y else -1) * (1 if rng.random() < a else -1)) for a in (0.95, 0.9, 0.85, 0.6, 0.55))
        votes.append(v)
        counts[v] = counts.get(v, 0) + 1
    post, rates = pii.estimate(counts)
    hit = sum((post[v] > 0.5) == y for v, y in zip(votes, truth, strict=True))
    assert hit / len(truth) > 0.93
    assert rates[1, 0, 2] > rates[1, 3, 2] > 0.5


def test_pii_empty_table(spark):
    frame = docs(spark, []).where("doc_id is not null")
    assert pii.report(frame, pii.fit(frame)).count() == 0


# --- licences

def brute_dice(a, b):
    w = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    x, y = (set(zip(w(t), w(t)[1:], strict=False)) for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


LICENSED = ["some words here\nReleased under the MIT license!\nmore words", "intro.\n\nRedistribution and use in source and binary "
            "forms, with or without\nmodification, are permitted provided that the following\nconditions are met:\n\nend", "", None,
            "nothing at all", "Licensed under the Apache License, Version 2.0 today", "word " * 50_000]


def test_license_scan_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, LICENSED)).collect()}
    assert len(got) == len(LICENSED) + 1
    for i, t in enumerate(LICENSED):
        units = {*(t or "").split("\n"), *re.split(r"\n[ \t\r]*\n", t or ""), t or ""}
        want = {n for u in units if len(u) < 5000 for n, xs in license_scan.TEMPLATES.items() for x in xs if brute_dice(u, x) >= 0.8}
        assert set(filter(None, got[i]["licenses"].split(","))) <= want and bool(want) == (got[i]["n_matches"] > 0)
    assert got[0]["licenses"] == "MIT" and got[1]["licenses"] == "BSD" and got[0]["best_dice"] == 1.0


def wrapped(text, before, width=9):
    w = text.split()
    return "\n".join(before + " ".join(w[i:i + width]) for i in range(0, len(w), width))


def test_license_scan_finds_embedded_notices():
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0"][0]
    code = "\n".join(f"let value{i} = call{i}(first{i}, second{i});" for i in range(300))
    more = "This program is distributed in the hope that it will be useful, but without any warranty; see the terms for more details."
    m = license_scan.Matcher(license_scan.TEMPLATES, license_scan.MIN_DICE)
    for text, name, notice in [
            (wrapped(f"Copyright (c) 2020 Some One {mit[0]} {mit[1]} The software is provided as is.", "// ") + "\n" + code, "MIT", mit[0]),
            (wrapped(gpl, " * ") + "\n *\n" + wrapped(more, " * ") + "\n */\n" + code, "GPL-3.0", gpl),
            (f"Copyright (c) 2020 Some One {mit[0]} {mit[1]} " + "the software is provided as is without warranty of any kind " * 8, "MIT", mit[0]),
            ("In the end the whole tool was Été Released under the MIT License. as we had said to all of them before", "MIT", mit[2])]:
        got = m.scan(text)
        assert {n for _, _, n, _ in got} == {name} and max(d for *_, d in got) == 1.0
        assert any(decontam.words(text[a:b]) == decontam.words(notice) for a, b, _, _ in got)
    hot = "so it was Released under the MIT License. and that was all there was to say of it\n" * 3000
    assert len(m.scan(hot)) == 3000 and m.scan("the MIT license was released " * 3000) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f x y".split()), max_size=24))
def test_license_windows_reach_the_best_of_all_windows(w):
    templates = {"T": ["a b c d e f"], "U": ["a b a c x"]}
    got = license_scan.Matcher(templates, 0.8).scan(" ".join(w))
    for name in templates:
        best = max((brute_dice(" ".join(w[i:j]), templates[name][0]) for i in range(len(w)) for j in range(i, len(w) + 1)), default=0.0)
        assert best >= 0.8 or name not in {n for *_, n, _ in got}
        if best >= 0.8 and not any(n != name for *_, n, _ in got):
            assert max(d for *_, d in got) == best


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items):
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for name, item in items:
            v = low(item)
            n = min(10, len(v))
            wins = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1 if v else 0):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    if name is not None:
                        found.add(str(name))
        out.append((len(w), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "été à la plage"),
         (3, ""), (4, None), (None, "odd one out"), (5, "a a a a a a a a a a a a"), (2, "short item")]
CHECKED = ["x one two three four five six seven eight nine ten y", "ONE-two three four five six seven eight nine ten eleven twelve!",
           "a short item, a Short  item", "Été à la plage", "été à la plage", None, "", "a " * 25, "short\nitem odd one out", "short",
           "b " * 30_000 + "short item", "a short item, a Short  item"]


def test_decontam_equals_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_hits(CHECKED, ITEMS)
    got = {r["doc_id"]: r for r in decontam.report(docs(spark, CHECKED), bench).collect()}
    for i, w in enumerate(want):
        assert tuple(got[i][k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == w, i
        assert got[i]["n_near_items"] >= got[i]["n_items"]


def brute_near(text, item, counts, slop=5):
    """Whether the item's only window has all its terms within slop of their places beside one of its rarest."""
    w, v = decontam.words(text), decontam.words(item)
    rare = min(range(len(v)), key=lambda k: (counts[v[k]], k))
    return any(all(any(w[q] == v[k] for q in range(max(0, p + k - rare - slop), min(len(w), p + k - rare + slop + 1))) for k in range(len(v)) if k != rare)
               for p in range(len(w)) if w[p] == v[rare])


def test_decontam_on_few_words_used_often(spark):
    """Texts and items over a small vocabulary: every list is long, many windows nearly match."""
    rng = np.random.default_rng(3)
    text = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(k, text(n, 3)) for k, n in enumerate((4, 5, 6, 8))] + [(9, text(30, 2))]
    texts = [text(400, 3) for _ in range(6)] + [text(3000, 2)] + [text(400, 3)] * 2
    texts[-2] = texts[-1]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs(spark, texts), bench).collect()}
    for i, w in enumerate(brute_hits(texts, items)):
        assert tuple(got[i][k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == w
    counts = {}
    for t in texts:
        for x in decontam.words(t):
            counts[x] = counts.get(x, 0) + 1
    short = [(k, t) for k, t in items if k < 9]
    near = {r["doc_id"]: r["n_near_items"] for r in decontam.report(docs(spark, texts), bench.where("item_id < 9")).collect()}
    assert [near[i] for i in range(len(texts))] == [sum(brute_near(t, x, counts) for _, x in short) for t in texts]


def test_decontam_proximity_and_clean(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["alpha beta x gamma delta", "alpha beta gamma delta", "alpha delta", "beta alpha gamma delta"]
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontam.report(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(4)] == [(0, 1), (1, 1), (0, 0), (0, 1)]
    kept = decontam.clean(docs(spark, texts), bench)
    assert kept.columns == [f.name for f in DOCS] and {r["doc_id"] for r in kept.collect()} == {0, 2, 3, None}
    none = bench.where("false")
    assert decontam.clean(docs(spark, texts), none).count() == 5


# --- chat

@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", "<|x"]), st.text(alphabet="<|\\im_end>\nstar ", max_size=30)), max_size=5))
def test_chatml_round_trip_and_spans(turns):
    out, spans, rewrites = chat.spans(turns, chat.chatml)
    assert not rewrites and chat.read_back(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in spans] == [t for _, t in turns]


def test_chat_detects_rewriting_templates():
    numbered = lambda ts: f"{len(ts)} turns\n" + "".join(t for _, t in ts)
    last_only = lambda ts: "".join(f"[{r}]{t if i == len(ts) - 1 else t.strip()}" for i, (r, t) in enumerate(ts))
    assert chat.spans([("user", "a"), ("assistant", "b")], numbered)[2]
    assert chat.spans([("user", "a "), ("assistant", "b")], last_only)[2]
    assert not chat.spans([("user", "a"), ("assistant", "b")], last_only)[2]


def test_chat_finds_texts_beside_private_use_characters():
    turns = [("user\ue000", "a\ue000"), ("assistant\ue001", "\ue000\ue001"), ("\ue000", "")]
    out, spans, rewrites = chat.spans(turns, chat.chatml)
    assert not rewrites and [out[a:b] for a, b in spans] == [t for _, t in turns]


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "yes <|im_end|>"), (1, 0, "user", None), (None, 0, "user", "x"), (2, 0, None, "y"), (2, 0, "user", "y"),
            (2, 0, "user", "y"), (3, None, "assistant", "é" * 1000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", ""), ("assistant", "yes <|im_end|>")]
    assert chat.read_back(got[2]["formatted"]) == [("", "y"), ("user", "y"), ("user", "y")]
    a, b = got[3]["loss"][0]
    assert got[3]["formatted"][a:b] == "é" * 1000 and None in got
    assert chat.format_conversations(frame.where("false")).count() == 0


# --- toxicity

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    s, trans = rng.normal(size=6) * 2, rng.normal(size=(2, 2))
    weight, total = np.zeros(6), 0.0
    for code in range(64):
        tags = [code >> i & 1 for i in range(6)]
        w = np.exp(sum(x for x, t in zip(s, tags, strict=True) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        total += w
        weight += w * np.array(tags)
    assert np.allclose(toxicity.chain_marginals(s, trans), weight / total)
    p, _, logz = toxicity.marginals(s[None, :], np.array([6]), trans)
    assert np.allclose(p[0], weight / total) and np.isclose(logz[0], np.log(total))


def test_training_drops_copies_only():
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    passage = words("p", 60)
    apart = [([words(k, 200), passage], k % 2) for k in range(80)]
    assert toxicity._unlike(apart) == apart                      # one passage in all of them
    base = words("b", 200)
    near, other = [*base[:-3], "a", "b", "c"], [*base[:120], *words("c", 80)]
    got = toxicity._unlike([([base], 1), ([base], 1), ([near], 1), ([other], 1), ([base], 0)])
    assert got == [([base], 1), ([other], 1), ([base], 0)]       # a copy with another label stays


def test_toxicity_tables(spark):
    bad = ["you grubbling fool", "such a grubbler", "grubbled again", "the grubbly one", "grubble me"]
    texts = [f"{bad[i % 5]} number {i} word{i * 7} of many" if i % 4 == 0 else f"a nice day {i} word{i * 7} of many" for i in range(400)]
    texts += ["GRUBBLING!", "", None, "nothing here", "z " * 40_000 + "\ngrubbling"]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    field = toxicity.fit(frame, labels, lambda i: ~queries.held_out(i))
    got, names = toxicity.score(frame, field)
    by = {r["doc_id"]: r for r in got.collect()}
    held = [i for i in range(400) if by[i]["doc_id"] is not None and __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert held and all((by[i][names["score"]] >= 0.3) == (i % 4 == 0) for i in held)
    assert by[400][names["predicted"]] == 1 and by[400][names["spans"]] == "0:10"
    assert [by[i][names["score"]] for i in (401, 402)] == [0.0, 0.0] and by[403][names["predicted"]] == 0
    assert by[404][names["predicted"]] == 1 and by[404][names["spans"]] == "80001:80010"
    none = toxicity.fit(frame, labels.where("false"), lambda i: ~queries.held_out(i))
    assert toxicity.score(frame, none)[0].agg({names["score"]: "max"}).first()[0] == 0.0


def test_toxicity_training_texts_are_chosen_by_length(spark, monkeypatch):
    """Whole texts in hash order up to MAX_CHARS; the shortest text of an id; repeated rows once."""
    texts = [f"text {i} " + "é𝄞" * (i % 9) for i in range(60)]
    frame = docs(spark, texts).where("doc_id is not null")
    frame = frame.union(frame.where("doc_id < 30")).union(frame.where("doc_id < 10").withColumn("text", F.concat("text", F.lit(" longer"))))
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda samples: seen.append(samples))
    for bound in (24_000_000, 300, 0):
        monkeypatch.setattr(toxicity, "MAX_CHARS", bound)
        toxicity.fit(frame, labels, lambda i: F.lit(True))
        want, chars = [], 0
        for i in order:
            chars += len(texts[i])
            if chars > bound:
                break
            want.append((texts[i], i % 2))
        assert seen.pop() == want
    assert not want


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_quality_agrees_with_labels(spark, sf):
    got = queries.op6_quality(spark, f"/root/testdata/{sf}")
    both = got.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in both) / len(both)
    kept = [r["predicted"] for r in both if r["quality"] == 1]
    assert right > 0.9 and sum(kept) / len(kept) > 0.95
    edge = quality.score(docs(spark, ["", None, " \n"]), np.zeros(quality.HASHED + 1))[0]
    assert [r["quality_good"] for r in edge.collect()] == [0] * 4
    assert len(quality.fit(docs(spark, []).where("false"))) == quality.HASHED + 1
