"""Registry of the queries and of the SQL that checks them, plus shared SQL fragments.

Every query reads the given tables whole. Its SQL states the same result for another engine;
where rounding appears it is there in both, because logarithms and running sums of doubles may
differ in the last place between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def at(array: str, i: int) -> Column:
    return F.get(F.col(array), F.lit(i))


NET = "(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"
FACT = f"""CAST(l_shipdate AS DATE) AS date, CAST(epoch(l_shipdate) AS BIGINT) AS txn_ts,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS direction,
  CASE WHEN l_tax = 0 THEN 0 ELSE 1 END AS status,
  {NET} AS amount, CAST(l_discount AS DECIMAL(4,2)) AS yield_rate"""
SEGMENT_CODE = ("(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 "
                "WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END)")
TYPE_CODE = ("(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 "
             "WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 5 END)")
TIE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

# l: by product type; lk: by part key; lg: by product type with customer group; e: events
L = f"l AS (SELECT p_type AS product_id, {FACT}, {TIE_COLUMNS} FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"
LK = f"lk AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, {FACT}, {TIE_COLUMNS} FROM lineitem)"
LG = f"""lg AS (SELECT p_type AS product_id, {FACT}, o_custkey AS cust_id, {SEGMENT_CODE} AS group_id,
  c_mktsegment AS group_name, {TYPE_CODE} AS product_type, {TIE_COLUMNS}
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey)"""
E = """e AS (SELECT event_id, user_id AS cust_id, event_type AS product_id, ts,
  CAST(floor(epoch(ts)) AS BIGINT) AS txn_ts, CAST(ts AS DATE) AS date,
  CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END AS direction,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status,
  CAST(value AS DECIMAL(12,2)) AS amount FROM events)"""
META = f"""meta AS (SELECT p_type AS product_id, min({TYPE_CODE}) AS product_type,
  CAST(min(p_size) % 5 + 1 AS INTEGER) AS risk_level FROM part GROUP BY p_type)"""


def md5_bucket(key: str, n: int, salt: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT) % {n} AS INTEGER)"


def is_month_end(d: str) -> str:
    return f"CAST({d} = last_day({d}) AS INTEGER)"


def is_quarter_end(d: str) -> str:
    return f"CAST({d} = last_day({d}) AND month({d}) % 3 = 0 AS INTEGER)"


def calendar(d: str) -> str:
    return (f"CAST(isodow({d}) - 1 AS INTEGER) AS dow, CAST(day({d}) AS INTEGER) AS dom, "
            f"{is_month_end(d)} AS is_month_end, {is_quarter_end(d)} AS is_quarter_end")


def log_amount(x: str) -> str:
    return f"round(ln(1 + greatest(CAST({x} AS DOUBLE), 0)), 9)"


def fit_edges(source: str, by: str, value: str, bins: int) -> str:
    """SELECT by..., edges, n: quantiles at i/bins, rounded, sorted, without duplicates."""
    probs = ", ".join(f"{i}.0::DOUBLE / {bins}" for i in range(bins + 1))
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (f"SELECT {keys}list_sort(list_distinct(list_transform(quantile_cont({value}, [{probs}]), "
            f"lambda edge_: round(edge_, 9)))) AS edges, count({value}) AS n FROM {source} {group}")


def bin_of(value: str, edges: str, missing: int = -1, offset: int = 0) -> str:
    number = (f"CASE WHEN {edges} IS NULL OR {value} IS NULL OR len({edges}) < 2 OR {value} < {edges}[1] "
              f"OR {value} > {edges}[len({edges})] THEN {missing} "
              f"ELSE greatest(len(list_filter({edges}, lambda edge_: edge_ < {value})) - 1, 0) END")
    return f"CAST({number} + {offset} AS INTEGER)"


def total(direction: int, amount: str = "amount", only: str = "TRUE") -> str:
    return (f"CAST(coalesce(sum(CASE WHEN direction = {direction} AND {only} THEN {amount} END), 0) AS DOUBLE)")
