"""Registered queries: each applies library operators to the benchmark tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SITES = """sites AS (SELECT * FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice) AS callee, l_suppkey AS file, l_orderkey AS function, CAST(l_linenumber AS BIGINT) AS place, l_quantity AS weight
  FROM lineitem) WHERE callee IS NOT NULL)"""
_VIEWS = {
    "sites": _SITES,
    "hop": "hop AS (SELECT DISTINCT caller AS src, callee AS dst FROM sites)",
    "sym": "sym AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file_path, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part)",
    "ver": "ver AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS snapshot_id, user_id AS stable_id, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, value FROM events)",
    "blk": """blk AS (SELECT conv_id AS function_id, turn AS block, role AS kind, text,
      CAST(coalesce(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS start_line,
      CAST(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_line FROM conversations)""",
}


def with_views(sql: str) -> str:
    """The SQL with the views it names put before it."""
    used = [k for k in _VIEWS if f" {k}" in sql or f"({k}" in sql]
    if any(k.startswith("hop") for k in used) and "sites" not in used:
        used.insert(0, "sites")
    head = ", ".join(_VIEWS[k] for k in used)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return run

    return register
