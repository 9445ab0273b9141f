"""Named queries over the driver's tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def counted(sql: str) -> str:
    """count_if(x) as count(*) filter (where x), which is a bigint and 0 where x is always null."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) filter (where {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with SQL that must give the same rows."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _oracles[name] = counted(oracle)
        return f

    return add


def oracle(name: str) -> str:
    """The SQL of a query, for another that must give the same rows."""
    return _oracles[name]


def _load() -> None:
    from kerbline.plans import queries_detections, queries_extra, queries_files, queries_joins, queries_media, queries_more, queries_orders, queries_rules, queries_small, queries_streams  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
