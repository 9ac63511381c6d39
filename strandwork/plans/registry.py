"""Named queries: a callable over (spark, sf_dir) and, where SQL can express it, the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def values(rows: list[tuple]) -> str:
    """Rows as the inside of a VALUES list."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x00", "' || chr(0) || '") + "'" if isinstance(x, str) else repr(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def spread_sql(rows: list[tuple], columns: str) -> str:
    """SQL of sources.tables.spread: the rows for every supplier, its number in place of {n} and in integer ids."""
    names = [c.strip() for c in columns.split(",")]
    out = []
    for i, c in enumerate(names):
        kinds = {type(r[i]) for r in rows if r[i] is not None}
        if kinds == {int} and c.strip('"').endswith("id"):
            out.append(f"(s_suppkey * 100 + {c})::INT AS {c}")
        elif str in kinds:
            out.append(f"replace({c}, '{{n}}', s_suppkey::VARCHAR) AS {c}")
        elif list in kinds:
            out.append(f"list_transform({c}, lambda x: replace(x, '{{n}}', s_suppkey::VARCHAR)) AS {c}")
        else:
            out.append(c)
    return f"(SELECT {', '.join(out)} FROM supplier, (VALUES {values(rows)}) v({columns}))"
