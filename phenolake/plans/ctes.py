"""Shared table expressions of the check SQL; ``{name}`` in a body refers to another expression."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def variant(root: str, base: str, body: str, suffix: str) -> str:
    """Copies of ``root`` and of all it is made of where that goes back to ``base``, with ``body`` in place of the base; returns the copy's name."""
    def touched(name: str) -> bool:
        return name == base or any(touched(ref) for ref in re.findall(r"\{(\w+)\}", CTES[name]))

    def copy(name: str) -> str:
        if not touched(name):
            return name
        if name + suffix not in CTES:
            CTES[name + suffix] = body if name == base else re.sub(r"\{(\w+)\}", lambda m: "{" + copy(m[1]) + "}", CTES[name])
        return name + suffix
    return copy(root)


def with_clause(sql: str) -> tuple[str, str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for ref in re.findall(r"\{(\w+)\}", text):
            if ref not in order:
                visit(CTES[ref])
                if ref not in order:
                    order.append(ref)
    visit(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    clause = "WITH RECURSIVE " if any("RECURSIVE" in CTES[n] for n in order) else "WITH "
    parts = ", ".join(f"{n} AS MATERIALIZED ({plain(CTES[n])})" for n in order)
    return plain(sql), (clause + parts) if order else ""


def _mean(value: str, when: str, scale: int, divisor: str) -> str:
    return (f"CAST(sum(CASE WHEN {when} THEN CAST(round({value} * {scale}) AS BIGINT) END) AS DOUBLE) "
            f"/ ({divisor} * count(CASE WHEN {when} THEN 1 END))")


cte("panel", f"""
SELECT *, coalesce(s1, s2, s3) AS value,
  CASE WHEN s1 IS NOT NULL THEN 0 WHEN s2 IS NOT NULL THEN 1 WHEN s3 IS NOT NULL THEN 2 ELSE -1 END AS source,
  year(date) AS year, dayofyear(date) AS doy, month(date) AS month, datediff('day', DATE '2000-01-01', date) AS day
FROM (SELECT l_suppkey AS pid, CAST(l_shipdate AS DATE) AS date,
  {_mean('l_extendedprice', "l_returnflag = 'N'", 100, '1e7')} AS s1,
  {_mean('l_extendedprice', "l_returnflag = 'A'", 100, '1e7')} AS s2,
  {_mean('l_extendedprice', "l_returnflag = 'R'", 100, '1e7')} AS s3,
  {_mean('l_discount', "l_returnflag = 'N'", 100, '1e2')} AS x1,
  {_mean('l_discount', "l_returnflag = 'A'", 100, '1e2')} AS x2,
  min(l_linestatus) AS status_flag
  FROM lineitem GROUP BY 1, 2)""")
cte("panel_cat", "SELECT p.*, s_nationkey AS category FROM {panel} p LEFT JOIN supplier ON pid = s_suppkey")
cte("season", "SELECT * FROM {panel} WHERE doy BETWEEN 91 AND 304")
cte("marked", """SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 'gap', pid, date)))
  <= round(count(*) OVER () * 0.15) AS is_gap FROM {panel}""")
cte("known", "SELECT * FROM {marked} WHERE NOT is_gap")
cte("targets", "SELECT * FROM {marked} WHERE is_gap")
cte("drivers", f"""
SELECT c_nationkey AS region, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS precip,
  {_mean('o_totalprice', 'true', 100, '1e6')} AS temp, datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS day
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(o_orderdate AS DATE)""")
cte("stations", f"""
SELECT concat(l_returnflag, l_linestatus) AS region, CAST(l_shipdate AS DATE) AS date,
  {_mean('l_tax', 'true', 100, '1e0')} AS rain, {_mean('l_quantity', 'true', 1, '1e0')} AS temp,
  min(l_quantity) AS tmin, max(l_quantity) AS tmax, {_mean('l_discount', 'true', 100, '2e0')} AS et0,
  datediff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)) AS day
FROM lineitem GROUP BY concat(l_returnflag, l_linestatus), CAST(l_shipdate AS DATE)""")
cte("pixels", f"""
SELECT l_suppkey AS zone, CAST(date_trunc('month', l_shipdate) AS DATE) AS scene, l_linenumber AS px,
  {_mean('l_tax', 'true', 100, '1e2')} AS nir, {_mean('l_discount', 'true', 100, '1e2')} AS red,
  {_mean('l_quantity', 'true', 1, '1e3')} AS swir, max(CAST(l_quantity AS INTEGER)) AS qa
FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE), l_linenumber""")
