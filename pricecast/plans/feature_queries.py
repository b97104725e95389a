"""Registered data-preparation queries: J1, S1/P*/F*, W1–W9, O3/O4/A6, E1–E5, W10–W12."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricecast.operators import clean, encode, features, schema, sequence, split
from pricecast.operators.join import merge_sources
from pricecast.plans.catalog import finish, register
from pricecast.plans.oracle import r4, with_fixtures
from pricecast.session import ensure_checkpoint_dir
from pricecast.sources import io
from pricecast.sources import tables as tb

ID = ["market", "arrival_date", "k1", "k2", "k3"]
ORDER = ["arrival_date", "k1", "k2", "k3"]
ID_SQL = "market, arrival_date, k1, CAST(k2 AS BIGINT) AS k2, k3"

_OBS_W = """obs_w AS (
  SELECT o.*, w.t2m, w.t2m_max, w.t2m_min, w.prectotcorr, w.rh2m, w.ws2m
  FROM price_obs o LEFT JOIN weather_daily w
  ON o.district = w.district AND o.arrival_date = w.arrival_date)"""


def _obs_weather(spark, sf_dir):
    obs = tb.price_obs(spark, sf_dir)
    w = tb.weather_daily(spark, sf_dir)
    return obs.join(w, ["district", "arrival_date"], "left")


# --------------------------------------------------------------------- J1
@register("merge_sources", with_fixtures(_OBS_W, select=f"""
SELECT o.market, o.arrival_date, o.k1, CAST(o.k2 AS BIGINT) AS k2, o.k3,
       {r4("o.modal_price")} AS modal_price, {r4("o.t2m")} AS t2m,
       s.season, CAST(s.festival AS BIGINT) AS festival
FROM obs_w o LEFT JOIN seasonal s
  ON o.state IS NOT DISTINCT FROM s.state AND o.district IS NOT DISTINCT FROM s.district
 AND o.market IS NOT DISTINCT FROM s.market AND o.commodity IS NOT DISTINCT FROM s.commodity
 AND o.arrival_date IS NOT DISTINCT FROM s.arrival_date"""))
def q_merge(spark, sf_dir):
    """Weather-enriched observations left-merged with seasonal factors."""
    left = _obs_weather(spark, sf_dir)
    right = tb.seasonal(spark, sf_dir)
    m = merge_sources(left, right, ["state", "district", "market", "commodity", "arrival_date"])
    return finish(m.select(*ID, "modal_price", "t2m", "season", "festival"))


# --------------------------------------------------------------- S1/P/F
_RAW_NAMES = {"state": " State", "district": "District ", "market": "Market",
              "commodity": "Commodity", "arrival_date": "Date", "min_price": "Min Price",
              "max_price": "Max Price", "modal_price": "Modal Price",
              "arrival_quantity": "Arrival Quantity", "k1": "k1", "k2": "k2", "k3": "k3"}


@register("clean_observations", with_fixtures(select=f"""
SELECT state, district, {ID_SQL}, commodity, {r4("min_price")} AS min_price,
       {r4("max_price")} AS max_price, {r4("modal_price")} AS modal_price,
       {r4("arrival_quantity")} AS arrival_quantity
FROM price_obs WHERE modal_price IS NOT NULL AND arrival_date IS NOT NULL"""))
def q_clean(spark, sf_dir):
    """S1 + P1/P3/P4 + F1/F2/F3: the cleaning stage over an all-string,
    messy-header copy of the observations (as a raw CSV read delivers it)."""
    obs = tb.price_obs(spark, sf_dir)
    raw = obs.select(*[F.col(c).cast("string").alias(n) for c, n in _RAW_NAMES.items()],
                     F.lit("x").alias("report.xlsx"))
    df = clean.clean_observations(raw)
    df = df.withColumns({k: F.col(k).cast("bigint") for k in ("k1", "k2", "k3")})
    df = clean.drop_null(df, ["modal_price", "arrival_date"])
    return finish(df.select("state", "district", *ID, "commodity", "min_price", "max_price",
                            "modal_price", "arrival_quantity"))


# The date spellings and missing-value tokens put into the raw file, by line number.
_DATE_SPELLINGS = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd"]


@register("clean_observations_csv", with_fixtures(select=f"""
SELECT state, district, {ID_SQL}, commodity, {r4("CASE WHEN k2 <> 4 THEN min_price END")} AS min_price,
       {r4("max_price")} AS max_price, {r4("modal_price")} AS modal_price,
       {r4("CASE WHEN k2 <> 5 THEN arrival_quantity END")} AS arrival_quantity
FROM price_obs WHERE modal_price IS NOT NULL AND arrival_date IS NOT NULL AND k2 <> 3 AND k1 % 23 <> 0"""))
def q_clean_csv(spark, sf_dir):
    """S1 + S2 + P1/P3/P4 + F1/F2/F3: the observations written as a raw CSV file with messy
    headers, a junk column, dates in three spellings or invalid, missing-value tokens and words
    in number columns, then read back as text and cleaned."""
    day = F.col("arrival_date")
    spelled = F.element_at(F.array(*[F.date_format(day, f) for f in _DATE_SPELLINGS]), (F.col("k2") % 3 + 1).cast("int"))
    cells = {"arrival_date": F.when(F.col("k1") % 23 == 0, F.lit("31/31/1999")).otherwise(spelled),
             "modal_price": F.when(F.col("k2") == 3, F.lit("NA")).otherwise(F.col("modal_price").cast("string")),
             "min_price": F.when(F.col("k2") == 4, F.lit("unknown")).otherwise(F.col("min_price").cast("string")),
             "arrival_quantity": F.when(F.col("k2") == 5, F.lit(" null ")).otherwise(F.col("arrival_quantity").cast("string"))}
    raw = tb.price_obs(spark, sf_dir).select(*[cells.get(c, F.col(c).cast("string")).alias(n) for c, n in _RAW_NAMES.items()],
                                             F.lit("x").alias("report.xlsx"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    io.write_stage(raw, path, fmt="csv", mode="error")
    df = clean.clean_observations(io.read_raw(spark, path, fmt="csv"))
    df = df.withColumns({k: F.col(k).cast("bigint") for k in ("k1", "k2", "k3")})
    return finish(df.select("state", "district", *ID, "commodity", "min_price", "max_price",
                            "modal_price", "arrival_quantity"))


@register("clean_column_names", with_fixtures(select=" UNION ALL ".join(
    f"SELECT '{c}_raw' AS name, count({c}) AS n_values, count(*) AS rows FROM price_obs"
    for c in ("min_price", "max_price", "modal_price", "arrival_quantity"))))
def q_clean_cols(spark, sf_dir):
    """Strict name cleaning, required-column check, pruning."""
    obs = tb.price_obs(spark, sf_dir)
    messy = obs.toDF(*[f"  {c.upper()}--(raw) " for c in obs.columns])
    cleaned = schema.clean_cols(messy)
    schema.require_cols(cleaned, cols=["modal_price_raw", "arrival_date_raw"])
    feats = schema.feature_columns(cleaned, drop=["k1_raw", "k2_raw", "k3_raw"])
    pruned = schema.select_existing(cleaned, [*feats, "not_there"])
    counts = pruned.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in pruned.columns])
    return counts.unpivot(["rows"], pruned.columns, "name", "n_values")


# ------------------------------------------------------------ W1..W6 N2..N5
FEATURES_CTES = _OBS_W + """,
f AS (
  SELECT *,
    month(arrival_date) AS month, isodow(arrival_date) - 1 AS day_of_week,
    weekofyear(arrival_date) AS weekofyear,
    CASE WHEN market IS NULL THEN NULL ELSE count(arrival_date) OVER (PARTITION BY market) END
      AS market_freq,
    ln(1 + coalesce(arrival_quantity, 0)) AS arrival_qty_log1p,
    (arrival_quantity - avg(arrival_quantity) OVER (PARTITION BY commodity, state))
      / (stddev_samp(arrival_quantity) OVER (PARTITION BY commodity, state) + 1e-9) AS arrival_qty_z,
    lag(modal_price, 1) OVER (PARTITION BY commodity, state, district, market
                              ORDER BY arrival_date, k1, k2, k3) AS modal_lag_1,
    lag(modal_price, 3) OVER (PARTITION BY commodity, state, district, market
                              ORDER BY arrival_date, k1, k2, k3) AS modal_lag_3,
    lag(modal_price, 7) OVER (PARTITION BY commodity, state, district, market
                              ORDER BY arrival_date, k1, k2, k3) AS modal_lag_7,
    CASE WHEN count(modal_price) OVER (PARTITION BY commodity, state, district, market
              ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
         THEN avg(modal_price) OVER (PARTITION BY commodity, state, district, market
              ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END
      AS modal_roll_mean_7,
    CASE WHEN count(modal_price) OVER (PARTITION BY commodity, state, district, market
              ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
         THEN stddev_samp(modal_price) OVER (PARTITION BY commodity, state, district, market
              ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END
      AS modal_roll_std_7,
    t2m_max - t2m_min AS temp_range, t2m * rh2m AS temp_x_humidity,
    lag(prectotcorr, 1) OVER (PARTITION BY state, district
                              ORDER BY commodity, market, arrival_date, k1, k2, k3) AS rain_lag_1
  FROM obs_w)"""

_FEATURES_SQL = with_fixtures(FEATURES_CTES, select=f"""
SELECT commodity, state, district, {ID_SQL},
       CAST(month AS BIGINT) AS month, CAST(day_of_week AS BIGINT) AS day_of_week,
       CAST(weekofyear AS BIGINT) AS weekofyear,
       {r4("sin(2 * pi() * month / 12)")} AS month_sin, {r4("cos(2 * pi() * month / 12)")} AS month_cos,
       {r4("sin(2 * pi() * day_of_week / 7)")} AS dow_sin,
       {r4("cos(2 * pi() * day_of_week / 7)")} AS dow_cos,
       market_freq, {r4("arrival_qty_log1p")} AS arrival_qty_log1p, {r4("arrival_qty_z")} AS arrival_qty_z,
       {r4("modal_lag_1")} AS modal_lag_1, {r4("modal_lag_3")} AS modal_lag_3,
       {r4("modal_lag_7")} AS modal_lag_7, {r4("modal_roll_mean_7")} AS modal_roll_mean_7,
       {r4("modal_roll_std_7")} AS modal_roll_std_7, {r4("temp_range")} AS temp_range,
       {r4("temp_x_humidity")} AS temp_x_humidity, {r4("rain_lag_1")} AS rain_lag_1
FROM f WHERE modal_lag_7 IS NOT NULL""")

_FEATURE_OUT = ["commodity", "state", "district", *ID, "month", "day_of_week", "weekofyear",
                "month_sin", "month_cos", "dow_sin", "dow_cos", "market_freq",
                "arrival_qty_log1p", "arrival_qty_z", "modal_lag_1", "modal_lag_3", "modal_lag_7",
                "modal_roll_mean_7", "modal_roll_std_7", "temp_range", "temp_x_humidity",
                "rain_lag_1"]


@register("feature_table", _FEATURES_SQL)
def q_features(spark, sf_dir):
    """N2–N5 + W1–W6: the full feature stage over weather-enriched observations."""
    ft = features.feature_table(tb.price_obs(spark, sf_dir), tb.SERIES_KEY, tb.TIEBREAK,
                                weather=tb.weather_daily(spark, sf_dir))
    return finish(ft.select(*_FEATURE_OUT))


# ------------------------------------------------------------------ O3/A6
_SPLIT_CTE = """pos AS (
  SELECT *, row_number() OVER (ORDER BY arrival_date, k1, k2, k3, market) - 1 AS p,
         count(*) OVER () AS n FROM price_obs WHERE arrival_date IS NOT NULL),
splitted AS (
  SELECT *, CASE WHEN p < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                 WHEN p < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
                 ELSE 'test' END AS split
  FROM pos)"""

SPLIT_ORDER = ["arrival_date", "k1", "k2", "k3", "market"]


def _split(spark, sf_dir):
    return split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)


@register("time_split_summary", with_fixtures(_SPLIT_CTE, select="""
SELECT split, count(*) AS rows, min(arrival_date) AS min_date, max(arrival_date) AS max_date
FROM splitted GROUP BY split"""))
def q_split_summary(spark, sf_dir):
    """O3 + A6: positional 70/15/15 split and its report."""
    from pricecast.operators.meta import split_summary
    return split_summary(_split(spark, sf_dir))


@register("time_split_rows", with_fixtures(_SPLIT_CTE, select=f"""
SELECT {ID_SQL}, split FROM splitted"""))
def q_split_rows(spark, sf_dir):
    """O3: the split label of every observation."""
    return finish(_split(spark, sf_dir).select(*ID, "split"))


@register("time_split_by_date", with_fixtures("""d AS (
  SELECT arrival_date, row_number() OVER (ORDER BY arrival_date) - 1 AS i, count(*) OVER () AS nd
  FROM (SELECT DISTINCT arrival_date FROM price_obs WHERE arrival_date IS NOT NULL)),
cut AS (
  SELECT max(CASE WHEN i = floor(nd * CAST(0.7 AS DOUBLE)) THEN arrival_date END) AS train_end,
         max(CASE WHEN i = floor(nd * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN arrival_date END) AS val_end
  FROM d)""", select="""
SELECT split, count(*) AS rows, min(arrival_date) AS min_date, max(arrival_date) AS max_date
FROM (SELECT o.arrival_date, CASE WHEN o.arrival_date <= c.train_end THEN 'train'
                                  WHEN o.arrival_date <= c.val_end THEN 'val' ELSE 'test' END AS split
      FROM price_obs o, cut c WHERE o.arrival_date IS NOT NULL) GROUP BY split"""))
def q_split_by_date(spark, sf_dir):
    """O4 + A6: split at distinct-date quantiles."""
    from pricecast.operators.meta import split_summary
    return split_summary(split.time_split_by_date(tb.price_obs(spark, sf_dir)))


# ---------------------------------------------------------------- E1..E5
_CAT_COLS = ["commodity_group", "commodity", "variety", "grade"]


@register("category_index", with_fixtures(_SPLIT_CTE, """train AS (SELECT * FROM splitted WHERE split = 'train'),
vals AS (
  SELECT DISTINCT 'commodity_group' AS "column", coalesce(CAST(commodity_group AS VARCHAR), 'nan') AS value FROM train
  UNION ALL SELECT DISTINCT 'commodity', coalesce(CAST(commodity AS VARCHAR), 'nan') FROM train
  UNION ALL SELECT DISTINCT 'variety', coalesce(CAST(variety AS VARCHAR), 'nan') FROM train
  UNION ALL SELECT DISTINCT 'grade', coalesce(CAST(grade AS VARCHAR), 'nan') FROM train)""", select="""
SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS idx FROM vals"""))
def q_cat_index(spark, sf_dir):
    """Category mapping fitted on the train split only."""
    train = _split(spark, sf_dir).where(F.col("split") == "train")
    return finish(encode.fit_category_index(train, _CAT_COLS))


@register("category_apply", with_fixtures(_SPLIT_CTE, """train AS (SELECT * FROM splitted WHERE split = 'train'),
mv AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx
       FROM (SELECT DISTINCT coalesce(CAST(variety AS VARCHAR), 'nan') AS value FROM train)),
mg AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx
       FROM (SELECT DISTINCT coalesce(CAST(grade AS VARCHAR), 'nan') AS value FROM train))""", select=f"""
SELECT {ID_SQL}, coalesce(mv.idx, -1) AS variety, coalesce(mg.idx, -1) AS grade,
       CAST(-1 AS BIGINT) AS season
FROM splitted s LEFT JOIN mv ON coalesce(CAST(s.variety AS VARCHAR), 'nan') = mv.value
LEFT JOIN mg ON coalesce(CAST(s.grade AS VARCHAR), 'nan') = mg.value
WHERE s.split <> 'train'"""))
def q_cat_apply(spark, sf_dir):
    """Apply the train mapping to val+test; unseen or missing column -> -1."""
    sp = _split(spark, sf_dir)
    mapping = encode.fit_category_index(sp.where(F.col("split") == "train"), ["variety", "grade"])
    rest = sp.where(F.col("split") != "train")
    out = encode.apply_category_index(rest, mapping, ["variety", "grade", "season"])
    return finish(out.select(*ID, "variety", "grade", "season"))


@register("category_codes", with_fixtures("""m AS (
  SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx
  FROM (SELECT DISTINCT coalesce(CAST(variety AS VARCHAR), 'nan') AS value FROM price_obs))""",
                                          select=f"""
SELECT {ID_SQL}, m.idx AS variety_code FROM price_obs o
JOIN m ON coalesce(CAST(o.variety AS VARCHAR), 'nan') = m.value"""))
def q_cat_codes(spark, sf_dir):
    """Self-coded categories (rank among the frame's own values)."""
    out = encode.category_codes(tb.price_obs(spark, sf_dir), "variety", out="variety_code")
    return finish(out.select(*ID, "variety_code"))


_SCALE_COLS = ["modal_price", "arrival_quantity", "min_price"]


@register("fit_scaler", with_fixtures(_SPLIT_CTE, select=f"""
SELECT {r4("avg(modal_price)")} AS modal_price__mean,
       {r4("CASE WHEN stddev_pop(modal_price) = 0 THEN 1 ELSE stddev_pop(modal_price) END")} AS modal_price__std,
       {r4("avg(arrival_quantity)")} AS arrival_quantity__mean,
       {r4("CASE WHEN stddev_pop(arrival_quantity) = 0 THEN 1 ELSE stddev_pop(arrival_quantity) END")} AS arrival_quantity__std,
       {r4("avg(min_price)")} AS min_price__mean,
       {r4("CASE WHEN stddev_pop(min_price) = 0 THEN 1 ELSE stddev_pop(min_price) END")} AS min_price__std
FROM splitted WHERE split = 'train'"""))
def q_fit_scaler(spark, sf_dir):
    """Standard scaler fitted on train (population std, 0 -> 1)."""
    train = _split(spark, sf_dir).where(F.col("split") == "train")
    return finish(encode.fit_scaler(train, _SCALE_COLS))


@register("scaled_features", with_fixtures(_SPLIT_CTE, """st AS (
  SELECT avg(modal_price) AS m1, stddev_pop(modal_price) AS s1,
         avg(arrival_quantity) AS m2, stddev_pop(arrival_quantity) AS s2,
         avg(min_price) AS m3, stddev_pop(min_price) AS s3
  FROM splitted WHERE split = 'train')""", select=f"""
SELECT {ID_SQL}, split,
       {r4("(modal_price - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END")} AS modal_price,
       {r4("(arrival_quantity - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END")} AS arrival_quantity,
       {r4("(min_price - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END")} AS min_price
FROM splitted, st"""))
def q_scaled(spark, sf_dir):
    """Apply the train-fitted scaler to every row."""
    sp = _split(spark, sf_dir)
    stats = encode.fit_scaler(sp.where(F.col("split") == "train"), _SCALE_COLS)
    out = encode.apply_scaler(sp, stats, _SCALE_COLS)
    return finish(out.select(*ID, "split", *_SCALE_COLS))


# -------------------------------------------------------------- W10..W12
_SEQ_KEY = ["commodity", "state", "market"]


@register("sequence_windows", with_fixtures(f"""s AS (
  SELECT *,
    count(*) OVER w30 AS k,
    lag(modal_price, 30) OVER w AS first_price,
    lag(modal_price, 1) OVER w AS last_price,
    sum(modal_price + arrival_quantity) OVER w30 AS seq_sum,
    list(CAST(floor(modal_price * 100 + 0.5) AS BIGINT)) OVER w30 AS prices,
    list(CAST(floor(arrival_quantity * 100 + 0.5) AS BIGINT)) OVER w30 AS quantities
  FROM price_obs
  WINDOW w AS (PARTITION BY commodity, state, market ORDER BY arrival_date, k1, k2, k3),
         w30 AS (PARTITION BY commodity, state, market ORDER BY arrival_date, k1, k2, k3
                 ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""", select=f"""
SELECT commodity, state, {ID_SQL}, {r4("modal_price")} AS modal_price, CAST(k AS BIGINT) AS seq_len,
       {r4("first_price")} AS seq_first, {r4("last_price")} AS seq_last, {r4("seq_sum")} AS seq_sum,
       md5(array_to_string(prices, ',') || ';' || array_to_string(quantities, ',')) AS seq_digest
FROM s WHERE k = 30"""))
def q_sequences(spark, sf_dir):
    """30-row sequence windows per (commodity, state, market) series."""
    obs = tb.price_obs(spark, sf_dir)
    seq = sequence.sequences(obs, _SEQ_KEY, ORDER, ["modal_price", "arrival_quantity"],
                             "modal_price", n=30)
    return finish(seq.select(
        "commodity", "state", *ID, "modal_price",
        F.size("seq").cast("bigint").alias("seq_len"),
        F.col("seq")[0][0].alias("seq_first"), F.element_at("seq", -1)[0].alias("seq_last"),
        F.aggregate("seq", F.lit(0.0), lambda acc, x: acc + x[0] + x[1]).alias("seq_sum"),
        F.md5(F.concat_ws(";", _cents(0), _cents(1))).alias("seq_digest")))


def _cents(channel: int):
    """One channel of a window, oldest first, in hundredths, as text."""
    return F.concat_ws(",", F.transform("seq", lambda x: F.floor(x[channel] * 100 + 0.5).cast("string")))


@register("log_delta", with_fixtures("""s AS (
  SELECT *, ln(1 + modal_price) AS log_p,
         lag(ln(1 + modal_price), 1) OVER (PARTITION BY commodity, state, market
                                           ORDER BY arrival_date, k1, k2, k3) AS log_p_lag1,
         lag(modal_price, 1) OVER (PARTITION BY commodity, state, market
                                   ORDER BY arrival_date, k1, k2, k3) AS prev_price
  FROM price_obs)""", select=f"""
SELECT commodity, state, {ID_SQL}, {r4("log_p")} AS log_p, {r4("log_p_lag1")} AS log_p_lag1,
       {r4("log_p - log_p_lag1")} AS delta,
       {r4("exp(log_p_lag1 + 0.25) - 1")} AS pred_price,
       {r4("exp(log_p_lag1) - 1 - prev_price")} AS pred_roundtrip_err,
       {r4("exp(log_p_lag1 + (log_p - log_p_lag1)) - 1 - modal_price")} AS true_roundtrip_err
FROM s WHERE log_p_lag1 IS NOT NULL AND log_p IS NOT NULL"""))
def q_log_delta(spark, sf_dir):
    """W11 + W12: log-delta target and the price reconstruction: for a
    predicted delta of 0.25 as a price, else as the round-trip error against
    the observed prices (exactly representable, tie-free)."""
    obs = tb.price_obs(spark, sf_dir)
    d = sequence.log_delta(obs, _SEQ_KEY, ORDER).withColumn("pred_delta", F.lit(0.25))
    r = sequence.reconstruct(d).withColumn("prev_back", F.expm1("log_p_lag1"))
    return finish(r.select(
        "commodity", "state", *ID, "log_p", "log_p_lag1", "delta",
        "pred_price", (F.col("prev_back") - F.col("prev_price")).alias("pred_roundtrip_err"),
        (F.col("true_price") - F.col("modal_price")).alias("true_roundtrip_err")))


# ------------------------------------------------------------ W7..W9, F*
def _with_gaps(df):
    """Deterministic missing reports: line 3 of every order has no price."""
    return df.withColumn("modal_price", F.when(F.col("k2") == 3, F.lit(None))
                         .otherwise(F.col("modal_price")))


@register("ffill_price", with_fixtures(select=f"""
SELECT commodity, state, district, {ID_SQL},
       {r4('''last_value(CASE WHEN k2 = 3 THEN NULL ELSE modal_price END IGNORE NULLS) OVER (
            PARTITION BY commodity, state, district, market ORDER BY arrival_date, k1, k2, k3
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS modal_price
FROM price_obs"""))
def q_ffill(spark, sf_dir):
    """Forward fill of missing prices within each series."""
    obs = _with_gaps(tb.price_obs(spark, sf_dir))
    out = clean.ffill(obs, tb.SERIES_KEY, ORDER, "modal_price")
    return finish(out.select("commodity", "state", "district", *ID, "modal_price"))


_WEATHER = ["t2m", "t2m_max", "t2m_min", "prectotcorr", "rh2m", "ws2m"]


@register("fill_group_median", with_fixtures(_OBS_W, f"""g AS (
  SELECT * REPLACE ({", ".join(f"CASE WHEN k2 <> {i} THEN {c} END AS {c}" for i, c in enumerate(_WEATHER, 1))}) FROM obs_w),
med AS (SELECT state, arrival_date, {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _WEATHER)} FROM g
        GROUP BY state, arrival_date),
f1 AS (SELECT g.* REPLACE ({", ".join(f"coalesce(g.{c}, m_{c}) AS {c}" for c in _WEATHER)}) FROM g LEFT JOIN med
       ON g.state = med.state AND g.arrival_date = med.arrival_date),
allm AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS a_{c}" for c in _WEATHER)} FROM f1)""", select=f"""
SELECT {ID_SQL}, {", ".join(f"{r4(f'coalesce({c}, a_{c})')} AS {c}" for c in _WEATHER)} FROM f1, allm"""))
def q_fill_median(spark, sf_dir):
    """Gaps of the six weather columns filled by the (state, date) median, then the global median."""
    obs = _obs_weather(spark, sf_dir)
    obs = obs.withColumns({c: F.when(F.col("k2") != i, F.col(c)) for i, c in enumerate(_WEATHER, 1)})
    out = clean.fill_group_median(obs, ["state", "arrival_date"], _WEATHER)
    return finish(out.select(*ID, *_WEATHER))


@register("iqr_cap", with_fixtures("""q AS (
  SELECT commodity, state, district, market,
         quantile_cont(modal_price, 0.25) AS q1, quantile_cont(modal_price, 0.75) AS q3
  FROM price_obs GROUP BY commodity, state, district, market)""", select=f"""
SELECT o.commodity, o.state, o.district, {ID_SQL.replace("market,", "o.market,")},
       {r4("least(greatest(o.modal_price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))")} AS modal_price
FROM price_obs o JOIN q ON o.commodity = q.commodity AND o.state = q.state
 AND o.district = q.district AND o.market = q.market"""))
def q_iqr(spark, sf_dir):
    """Per-series IQR capping with exact quartiles."""
    out = clean.iqr_cap(tb.price_obs(spark, sf_dir), tb.SERIES_KEY, "modal_price")
    return finish(out.select("commodity", "state", "district", *ID, "modal_price"))


@register("min_group_rows", with_fixtures("""c AS (
  SELECT commodity, state, district, market FROM price_obs
  GROUP BY commodity, state, district, market HAVING count(*) >= 100)""", select=f"""
SELECT {ID_SQL.replace("market,", "o.market,")} FROM price_obs o
JOIN c ON o.commodity = c.commodity AND o.state = c.state AND o.district = c.district
 AND o.market = c.market"""))
def q_min_rows(spark, sf_dir):
    """keep only series with at least 100 observations."""
    out = clean.min_group_rows(tb.price_obs(spark, sf_dir), tb.SERIES_KEY, 100)
    return finish(out.select(*ID))


@register("fill_and_flag", with_fixtures("""s AS (
  SELECT *, lag(modal_price, 1) OVER (PARTITION BY commodity, state, district, market
                                      ORDER BY arrival_date, k1, k2, k3) AS prev_price
  FROM price_obs WHERE modal_price > 0)""", select=f"""
SELECT {ID_SQL}, {r4("coalesce(prev_price, min_price)")} AS prev_price,
       CAST(prev_price IS NOT NULL AS BIGINT) AS has_prev, {r4("coalesce(prev_price, 0)")} AS prev_or_zero
FROM s"""))
def q_fill_flag(spark, sf_dir):
    """F8 + F9 + F6: positive prices, previous price filled from min_price with a flag,
    and the zero-filled variant."""
    obs = clean.filter_positive(tb.price_obs(spark, sf_dir))
    obs = features.add_series_windows(obs, tb.SERIES_KEY, ORDER, "modal_price", lags=(1,),
                                      roll=None, lag_prefix="prev")
    obs = obs.withColumn("prev_or_zero", F.col("prev_lag_1"))
    obs = clean.fill_zero(obs, ["prev_or_zero"])
    out = clean.fill_from(obs.withColumnRenamed("prev_lag_1", "prev_price"),
                          "prev_price", "min_price", "has_prev")
    return finish(out.select(*ID, "prev_price", "has_prev", "prev_or_zero"))


# ----------------------------------------------------- timestamp-grained source
@register("event_value_windows", with_fixtures(select=f"""
SELECT event_type, event_id, ts,
       {r4("lag(value, 1) OVER w")} AS value_lag_1, {r4("lag(value, 3) OVER w")} AS value_lag_3,
       {r4('''CASE WHEN count(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
                ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
           THEN avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
                ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END''')} AS value_roll_mean_7
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""))
def q_event_windows(spark, sf_dir):
    """W1/W2 on the timestamp-grained events table: lags and shifted rolling mean
    per event type. The five types are long series, so they are cut into chunks of
    whole days that begin within 1,000 rows of each other (a day each in a large table)."""
    ev = tb.events(spark, sf_dir).select("event_type", "event_id", "ts", "value",
                                         F.to_date("ts").alias("day"))
    out = features.add_series_windows(ev, ["event_type"], ["day", "ts", "event_id"], "value",
                                      lags=(1, 3), roll=7, roll_fns=("mean",),
                                      lag_prefix="value", chunk_rows=1000)
    return finish(out.select("event_type", "event_id", "ts", "value_lag_1", "value_lag_3",
                             "value_roll_mean_7"))
