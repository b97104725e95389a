"""DuckDB oracle SQL: the fixture mapping as CTEs plus one query per operator.

DuckDB sees only the raw driver tables, so every oracle string inlines the
mapping (FIXTURES.md part B). The Spark side builds the same mapping with
the DataFrame API (``pricecast.sources.tables``); the two are independent.
"""

from __future__ import annotations

PRICE_OBS = """price_obs AS (
  SELECT r.r_name AS state, n.n_name AS district, s.s_name AS market,
         substr(p.p_brand, 1, 7) AS commodity_group, p.p_type AS commodity,
         p.p_brand AS variety, l.l_returnflag AS grade,
         CAST(l.l_shipdate AS DATE) AS arrival_date,
         (l.l_extendedprice / l.l_quantity) * (1 - l.l_discount) AS min_price,
         (l.l_extendedprice / l.l_quantity) * (1 + l.l_tax) AS max_price,
         l.l_extendedprice / l.l_quantity AS modal_price,
         l.l_quantity AS arrival_quantity,
         l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_partkey AS k3
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

WEATHER_DAILY = """weather_daily AS (
  SELECT n.n_name AS district, CAST(l.l_shipdate AS DATE) AS arrival_date,
         20 + 100 * avg(l.l_tax) AS t2m, 22 + 100 * max(l.l_tax) AS t2m_max,
         18 + 100 * min(l.l_tax) AS t2m_min, 100 * avg(l.l_discount) AS prectotcorr,
         avg(l.l_quantity) AS rh2m, avg(l.l_linenumber) AS ws2m
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY n.n_name, CAST(l.l_shipdate AS DATE))"""

SEASONAL = """seasonal AS (
  SELECT state, district, market, commodity, arrival_date,
         max(modal_price) AS modal_price,
         CASE WHEN month(arrival_date) IN (6,7,8,9) THEN 'Kharif'
              WHEN month(arrival_date) IN (10,11,12,1) THEN 'Rabi' ELSE 'Zaid' END AS season,
         CASE WHEN month(arrival_date) IN (10,11) THEN 1 ELSE 0 END AS festival
  FROM price_obs WHERE day(arrival_date) <= 20
  GROUP BY state, district, market, commodity, arrival_date)"""

REQUESTS = """requests AS (
  SELECT c.c_custkey AS request_id,
         CASE WHEN c.c_custkey % 11 = 0 THEN 'Atlantis' ELSE concat('  ', lower(r.r_name), ' ') END AS state,
         concat('SUPPLIER#', lpad(CAST(c.c_custkey % 150 AS VARCHAR(9)), 9, '0')) AS market,
         CASE c.c_custkey % 7 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'medium' WHEN 2 THEN 'Promo'
              WHEN 3 THEN 'SMALL' WHEN 4 THEN ' Large' WHEN 5 THEN 'STANDARD' ELSE 'unknown' END AS commodity,
         DATE '1994-06-01' + CAST((c.c_custkey * 37) % 2800 AS INT) AS arrival_date
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

FIXTURE_CTES = [PRICE_OBS, WEATHER_DAILY, SEASONAL, REQUESTS]


def norm_sql(expr: str) -> str:
    """N1 in DuckDB: same steps as ``pricecast.functions.keys.norm_key``."""
    s = f"trim(regexp_replace(lower({expr}), '\\s+', ' ', 'g'))"
    s = f"replace(replace({s}, '&', 'and'), '/', ' ')"
    s = f"regexp_replace({s}, '[^\\w\\s\\-\\(\\)]', '', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def r4(expr: str) -> str:
    """SQL twin of ``catalog.round_fixed``: 4-dp rounding in IEEE doubles."""
    return f"(round_even(CAST({expr} AS DOUBLE) * 10000, 0) / 10000)"


def with_fixtures(*ctes: str, select: str) -> str:
    """Full oracle statement: fixture CTEs, extra CTEs, final SELECT."""
    return "WITH " + ",\n".join(FIXTURE_CTES + list(ctes)) + "\n" + select
