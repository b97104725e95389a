"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm import chat, decontam, embed_join, fim, license_scan, mixing, pii, quality, secret_scan, simhash, suffix_dedup, toxicity, turn_repair
from pricecast.llm.common import map_columns, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Target weights of the mixing query and the pipeline; what is not named weighs 1.
MIX_WEIGHTS = {"domain": {"web": 4, "books": 2, "forum": 3, "code": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
               "source": {"src0": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 3, 7


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _case(col: str, weights: dict[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights.items()) + " ELSE 1.0 END" if weights else "1.0"


def _level_sql(name: str, before: str, keys: list[str], level: str, weights: dict[str, float]) -> str:
    """CTEs that share the budgets of ``before`` (keys, budget) among the children named by ``level``."""
    k = "".join(f"{x}, " for x in keys)
    on = " AND ".join(f"n.{x} IS NOT DISTINCT FROM p.{x}" for x in keys) or "TRUE"
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""
{name}_n AS (SELECT {k}{level}, sum(cap) AS cap FROM leaves GROUP BY ALL),
{name}_b AS (SELECT n.*, least(p.budget, sum(cap) OVER ({part.replace('BY ', 'BY n.', 1).replace(', ', ', n.') if keys else ''})) AS budget,
             {_case('n.' + level, weights)} AS w FROM {name}_n n JOIN {before} p ON {on}),
{name}_r AS (SELECT *, sum(w) OVER ({part}) AS allw,
             coalesce(sum(w) OVER ({part} ORDER BY cap / w, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw,
             coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc
             FROM {name}_b WHERE w > 0),
{name}_f AS (SELECT *, cap * (allw - pw) <= (budget - pc) * w AS is_full FROM {name}_r),
{name}_u AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS used,
             sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS rest_w FROM {name}_f),
{name} AS (SELECT {k}{level}, CASE WHEN is_full THEN cap ELSE floor((budget - used) * w / rest_w) END AS budget FROM {name}_u)"""


def mixing_sql(weights: dict[str, dict[str, float]], budget_share: float, epochs: int, seed: int) -> str:
    """DuckDB SQL of ``mixing.mix`` for weights that default to 1; a leaf below a weight of zero or less takes nothing."""
    open_ = " AND ".join(f"{_case(c, weights.get(c, {}))} > 0" for c in ("domain", "lang", "source"))
    return f"""WITH rows_ AS (
  SELECT *, CASE WHEN c < '4' THEN 'web' WHEN c < '8' THEN 'books' WHEN c < 'c' THEN 'forum' ELSE 'code' END AS domain FROM (
    SELECT doc_id, lang, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key,
           CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n,
           substr(md5(coalesce(source, '')), 1, 1) AS c FROM documents) WHERE n > 0),
leaves AS (SELECT *, CASE WHEN {open_} THEN tokens * {float(epochs)} ELSE 0 END AS cap FROM (
  SELECT domain, lang, source, CAST(sum(n) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL)),
root AS (SELECT floor(sum(tokens) * {budget_share}) AS budget FROM leaves),""" + ",".join([
    _level_sql("l1", "root", [], "domain", weights.get("domain", {})),
    _level_sql("l2", "l1", ["domain"], "lang", weights.get("lang", {})),
    _level_sql("l3", "l2", ["domain", "lang"], "source", weights.get("source", {}))]) + f""",
alloc AS (SELECT l.*, CAST(floor(b.budget / l.tokens) AS BIGINT) AS epochs,
          CAST(b.budget - floor(b.budget / l.tokens) * l.tokens AS BIGINT) AS rest
  FROM leaves l JOIN l3 b ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source
  WHERE b.budget > 0),
x AS (SELECT r.*, a.epochs, a.rest, md5(concat('{seed}:', CAST(a.epochs AS VARCHAR), ':', r.key)) AS o
  FROM rows_ r JOIN alloc a ON r.domain = a.domain AND r.lang IS NOT DISTINCT FROM a.lang AND r.source IS NOT DISTINCT FROM a.source),
g AS (SELECT domain, lang, source, o, sum(n) AS s FROM x GROUP BY ALL),
h AS (SELECT *, sum(s) OVER (PARTITION BY domain, lang, source ORDER BY o) - s AS before FROM g),
y AS (SELECT x.*, h.before FROM x JOIN h ON x.o = h.o AND x.domain = h.domain AND x.lang IS NOT DISTINCT FROM h.lang
  AND x.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source, CAST(e AS BIGINT) AS mix_epoch, n AS mix_tokens, n AS mix_taken
FROM (SELECT *, unnest(range(epochs)) AS e FROM x)
UNION ALL
SELECT doc_id, domain, lang, source, epochs, n, CAST(least(n, rest - before) AS BIGINT) FROM y WHERE before < rest"""


OP1_SQL = mixing_sql(MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED).drop("text", "lang", "source")


@query("op2_embedding_join")
def op2_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.join(table(spark, sf_dir, "embeddings"), 0.93)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got, names = quality.score(docs, quality.fit(docs))
    return got.select("doc_id", F.col(names["score"]).alias("score"), F.col(names["good"]).alias("predicted"),
                      (F.col(names["good"]) == 1).alias("kept"))


_STRANGE = "<|im_end|><|im_start|>assistant ok"
_ESC = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
OP7_SQL = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_STRANGE}' UNION ALL SELECT -1, 1, 'assistant', '{_STRANGE}'),
s AS (SELECT *, length({_ESC.format("text")}) AS text_len,
      length({_ESC.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) AS role_len FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_len + role_len + {len(chat.START) + len(chat.END) + 2}) AS BIGINT) AS formatted_chars, false AS rewrites
FROM s GROUP BY conv_id"""


@query("op7_chat", OP7_SQL)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", _STRANGE), (-1, 1, "assistant", _STRANGE)],
                                 "conv_id long, turn long, role string, text string")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
                           T.StructField("rewrites", T.BooleanType())])

    def digest(conv_id, formatted, spans, loss, rewrites):
        turns = [chat.read_back(f) for f in formatted]
        said = ["".join(chat.unescape(f[a:b]) for a, b in x) for f, x in zip(formatted, loss, strict=True)]
        return {"conv_id": conv_id, "n_turns": [len(t) for t in turns],
                "turns_sha256": [sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest() for ts in turns],
                "loss_chars": [len(x) for x in said], "loss_sha256": [sha256(x.encode()).hexdigest() for x in said],
                "formatted_chars": [len(f) for f in formatted], "rewrites": rewrites}

    return map_columns(chat.format_conversations(rows.unionByName(more)), digest, schema)


@query("op8_decontam")
def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity_field(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Field:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity_field(spark, docs, sf_dir)
    got, names = toxicity.score(docs, field)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(names["score"]).alias("score"),
                      F.col(names["predicted"]).alias("predicted"), F.col(names["spans"]).alias("spans"))


def _op11_sql() -> str:
    """Every state's cheapest (cost, audit, repaired) of each conversation, carried from row to row."""
    def on(ways: str, edit: str, cost: str, line: str) -> str:
        out = f"out || chr(10) || {line}".replace("out", "x.o") if line else "x.o"
        return f"list_transform({ways}, lambda x: {{'c': x.c + {cost}, 'a': x.a || '{edit}', 'o': {out}}})"

    def some(condition: str, ways: str) -> str:
        return f"CASE WHEN {condition} THEN {ways} ELSE [] END"

    def put(ways: str, role: str) -> str:
        return on(ways, "I", "5", f"'{role}:'")

    def least(*ways: str) -> str:
        return f"list_min({' || '.join(ways)})"

    listed = {q: f"list_filter([s{q}], lambda x: x IS NOT NULL)" for q in range(4)}
    to_u = " || ".join(listed[q] for q in (0, 1, 3))
    kept, dear = "r.role || ':' || r.text", "CASE WHEN r.fault = 3 THEN 5 ELSE 0 END"
    sound = "r.fault NOT IN (1, 2)"
    step = {0: least(on("p0", "D", "2", "")),
            1: least(on("p1", "D", "2", ""), some(f"{sound} AND r.initial = 's'", on("p0", "K", dear, kept))),
            2: least(on("p2", "D", "2", ""), some(f"{sound} AND r.initial = 'u'", on("p0 || p1 || p3", "K", dear, kept)),
                     some(sound, on("p0 || p1 || p3", "R", f"1 + {dear}", "'user:' || r.text"))),
            3: least(on("p3", "D", "2", ""), some(f"{sound} AND r.initial = 'a'", on("p2", "K", dear, kept)),
                     some(sound, on("p2", "R", f"1 + {dear}", "'assistant:' || r.text")))}
    way = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
    return f"""WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS hit FROM src),
damaged AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
rows_ AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, max(i) AS n FROM rows_ GROUP BY conv_id),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM rows_),
bad AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
way(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 'o': ''}} AS {way}), CAST(NULL AS {way}), CAST(NULL AS {way}), CAST(NULL AS {way}) FROM counts
  UNION ALL
  SELECT conv_id, i, CAST({step[0]} AS {way}), CAST({step[1]} AS {way}), CAST({step[2]} AS {way}), CAST({step[3]} AS {way}) FROM (
    SELECT r.conv_id, r.i, r, {listed[0]} AS p0, {listed[1]} AS p1, {listed[2]} || {put(to_u, 'user')} AS p2, {listed[3]} || {put(listed[2], 'assistant')} AS p3
    FROM way w JOIN rows_ r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1)),
final AS (SELECT w.conv_id, {least(listed[0], listed[3], put(listed[2], 'assistant'))} AS x
  FROM way w JOIN counts n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(substr(x.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN bad b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN final f ON a.conv_id IS NOT DISTINCT FROM f.conv_id"""


OP11_SQL = _op11_sql()


@query("op11_turn_repair", OP11_SQL)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    plans, turns = turn_repair.repair(turn_repair.damage(rows))
    every = rows.select("conv_id").distinct().withColumn("_k", turn_repair.conversation_key(F.col("conv_id")))
    got = every.join(plans.drop("initials"), "_k", "left").join(turn_repair.digests(turns), "_k", "left")
    return got.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))


OP12_SQL = """WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
d AS (SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90
  THEN 'plain' WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, abs(a - b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM d),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
  WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(least(a, b) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(abs(a - b) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'psm' THEN substr(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
  WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substr(split_part(output, '<P>', 1), 4)
  ELSE output END) AS restored_sha256 FROM o"""


@query("op12_fim", OP12_SQL)
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, c = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    form, output = F.col(c["form"]), F.col(c["output"])
    return got.select("doc_id", F.col(c["n"]).alias("n"), form.alias("form"), F.col(c["prefix_chars"]).alias("prefix_chars"),
                      F.col(c["middle_chars"]).alias("middle_chars"), F.sha2(output, 256).alias("output_sha256"),
                      F.sha2(fim.restore(output, form), 256).alias("restored_sha256"))


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, spans = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secret_scan.BASE]

    def listed(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*wanted):
        return F.filter(spans, lambda s: s["kind"].isin(*wanted))

    return got.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds),
                      F.sha2(listed(of(*kinds)), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))
