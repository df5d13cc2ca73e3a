"""SQL twins of the views in ``gridloom.tables`` and a helper that assembles WITH clauses."""

from __future__ import annotations

import re

CTE: dict[str, str] = {}


def tail_sql(z: str) -> str:
    """Two-sided normal p-value by a rational approximation of the error function, good to 1.5e-7."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    # fixed values: coefficients of the approximation
    return f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))"

CTE["lines"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, s_nationkey AS entity,
       CAST(l_shipdate AS DATE) AS date,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
       CAST(round(l_quantity) AS BIGINT) AS qty
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""

_PANEL = """
SELECT entity, {d} AS date,
       CAST(sum(cents) AS DOUBLE) / 100.0 / CAST(sum(qty) AS DOUBLE) AS price,
       CAST(sum(qty) AS DOUBLE) AS volume, count(*) AS n
FROM lines GROUP BY 1, 2"""
CTE["panel"] = _PANEL.format(d="date")
CTE["panel_m"] = _PANEL.format(d="CAST(date_trunc('month', date) AS DATE)")

_PR = """
SELECT *, ln(price) AS logp, date - lag(date) OVER we AS gap,
       ln(price) - lag(ln(price)) OVER we AS ret_row,
       {ret} AS ret
FROM {p} WINDOW we AS (PARTITION BY entity ORDER BY date)"""
CTE["pr"] = _PR.format(
    p="panel",
    ret="CASE WHEN date - lag(date) OVER we = 1 THEN ln(price) - lag(ln(price)) OVER we END")
CTE["prm"] = _PR.format(p="panel_m", ret="ln(price) - lag(ln(price)) OVER we")
_DEV = """
SELECT *, CASE WHEN count(*) OVER (PARTITION BY date) >= {k}
               THEN logp - avg(logp) OVER (PARTITION BY date) END AS dev
FROM {p}"""
CTE["dev"] = _DEV.format(p="pr", k=10)
CTE["devm"] = _DEV.format(p="prm", k=5)

CTE["sides"] = """
SELECT entity, date,
  CAST(sum(cents) FILTER (l_returnflag = 'A') AS DOUBLE) / 100.0 / CAST(sum(qty) FILTER (l_returnflag = 'A') AS DOUBLE) AS sell_price,
  CAST(coalesce(sum(qty) FILTER (l_returnflag = 'A'), 0) AS DOUBLE) AS sell_qty,
  CAST(sum(cents) FILTER (l_returnflag = 'N') AS DOUBLE) / 100.0 / CAST(sum(qty) FILTER (l_returnflag = 'N') AS DOUBLE) AS buy_price,
  CAST(coalesce(sum(qty) FILTER (l_returnflag = 'N'), 0) AS DOUBLE) AS buy_qty,
  CAST(sum(cents) FILTER (l_returnflag = 'R') AS DOUBLE) / 100.0 / CAST(sum(qty) FILTER (l_returnflag = 'R') AS DOUBLE) AS book_price,
  CAST(coalesce(sum(qty) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS book_qty
FROM lines GROUP BY 1, 2"""

CTE["fundamentals"] = """
SELECT entity, date, CAST(sum(c) AS DOUBLE) / 100.0 / CAST(sum(q) AS DOUBLE) AS price, CAST(sum(q) AS DOUBLE) AS volume, CAST(sum(c) AS DOUBLE) / 100.0 AS value,
  CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS suppliers, CAST(sum(q * q) AS DOUBLE) / (CAST(sum(q) AS DOUBLE) * CAST(sum(q) AS DOUBLE)) AS supplier_hhi,
  CAST(max(q) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS top_share, CAST(sum(a) AS DOUBLE) AS sell_qty, CAST(sum(b) AS DOUBLE) AS buy_qty, CAST(coalesce(sum(rr), 0) AS DOUBLE) AS returned
FROM (SELECT entity, date, l_suppkey, sum(cents) AS c, sum(qty) AS q, count(*) AS n, sum(qty) FILTER (l_returnflag = 'A') AS a,
        sum(qty) FILTER (l_returnflag = 'N') AS b, sum(qty) FILTER (l_returnflag = 'R') AS rr FROM lines GROUP BY 1, 2, 3) GROUP BY 1, 2"""

CTE["dim"] = """
SELECT n_nationkey AS entity, n_name AS name, r_name AS region,
  CASE WHEN n_nationkey % 3 = 0 THEN 'optional' ELSE 'open' END AS kind,
  CASE WHEN n_nationkey % 2 = 0 THEN 'green' ELSE 'yellow' END AS tier,
  DATE '1994-06-01' + n_nationkey * 13 AS created,
  coalesce(population, 0) AS population,
  CAST(bal AS DOUBLE) / 100.0 / population AS mean_balance,
  CAST(premium AS DOUBLE) / population AS premium_share
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS population,
             sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS bal,
             count(*) FILTER (c_mktsegment = 'BUILDING') AS premium
           FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey"""

CTE["calendar"] = """
SELECT date, n_orders, n_urgent,
  CAST(date = last_day(date) AS INTEGER) AS ev_month_end,
  CAST(n_urgent * 2 >= n_orders AS INTEGER) AS ev_urgent
FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders,
        count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders GROUP BY 1)"""

CTE["book"] = """
SELECT o_orderkey AS offer_id, c_nationkey AS entity,
  CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
  c_mktsegment AS name, amount,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100.0 / CAST(amount AS DOUBLE) AS price,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100.0 AS value,
  CAST(o_orderdate AS DATE) AS time
FROM orders
JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS amount
      FROM lineitem GROUP BY 1) q ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus IN ('F', 'O')"""

CTE["counts"] = """
SELECT user_id AS entity, CAST(ts AS DATE) AS date, event_type AS category, count(*) AS n,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM events GROUP BY 1, 2, 3"""

CTE["hourly"] = """
SELECT event_type AS category, date_trunc('hour', ts) AS hour_ts, count(*) AS n,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS value
FROM events GROUP BY 1, 2"""


def define(name: str, text: str) -> None:
    CTE[name] = text


def with_(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the CTEs it names, dependencies first; ``extra`` are local CTEs."""
    local = dict(extra)
    text = {**CTE, **local}
    order: list[str] = []

    def need(sql: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", sql))
        for name in text:
            if name in words and name not in order and text[name] is not sql:
                need(text[name])
                if name not in order:
                    order.append(name)

    for _, t in extra:
        need(t)
    need(body)
    for name, _ in extra:
        if name not in order:
            order.append(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({text[n]})" for n in order) + "\n" + body


def r(expr: str, digits: int = 6) -> str:
    """Same rounding as ``functions.num.rnd``."""
    return f"(round(CAST({expr} AS DOUBLE) * 1e{digits}) / 1e{digits} + 0.0)"
