"""Compare a Spark result with a DuckDB result, order aside."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from decimal import Decimal

STAR_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    for name in STAR_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value) if value else 0.0
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, datetime):
        return value.date() if value.time().isoformat() == "00:00:00" else value
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_bag(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), bag(df.columns, df.collect())


def duck_bag(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return sorted(columns), bag(columns, cursor.fetchall())
