"""Registered queries: one per operator row of SURVEY §2, with the DuckDB
oracle SQL where the semantics are SQL-expressible.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and reads the driver's
tables (or views derived from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import (  # noqa: F401
        q_bias,
        q_clean,
        q_stats,
        q_text,
        q_authors,
        q_sections,
        q_topics,
        q_models,
        q_sources,
    )


#: Decimals to which the queries named in ROUNDED (and their oracles) report
#: doubles. Their sums and means are taken in another order than the oracle's
#: and differ in the last bits; all other queries return the library's result.
REPORT_DIGITS = 9
from .rounded import ROUNDED  # noqa: E402


def _rounded(fn):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        cols = [F.round(F.col(f"`{f.name}`"), REPORT_DIGITS).alias(f.name)
                if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                for f in df.schema.fields]
        return df.select(*cols)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable]:
    load_all()
    return {k: _rounded(v) if k in ROUNDED else v for k, v in QUERIES.items()}


#: Columns of the input tables, to bind an oracle's SQL without data.
TABLE_COLUMNS = {
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
              "o_orderpriority VARCHAR",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, "
                "l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
}


def _round_sql(sqls: dict[str, str]) -> dict[str, str]:
    """Wrap each oracle so DOUBLE/FLOAT columns are rounded like the Spark
    side. Column types come from binding the SQL in DuckDB (no execution)."""
    import duckdb
    con = duckdb.connect()
    for name, columns in TABLE_COLUMNS.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
    out = {}
    for name, sql in sqls.items():
        rel = con.sql(sql)
        reps = []
        for c, ty in zip(rel.columns, rel.types):
            if str(ty) in ("DOUBLE", "FLOAT"):
                q = '"' + c.replace('"', '""') + '"'
                reps.append(f"round({q}, {REPORT_DIGITS}) AS {q}")
        # only the double columns are named, so data-dependent columns (pivot) pass through
        out[name] = f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) AS q" if reps else sql
    con.close()
    return out


def oracle_sql() -> dict[str, str]:
    load_all()
    sql = {k: (v() if callable(v) else v) for k, v in ORACLE.items()}
    return sql | _round_sql({k: v for k, v in sql.items() if k in ROUNDED})
