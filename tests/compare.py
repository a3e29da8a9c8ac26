"""Run named queries and their SQL side by side and compare rows and values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return con


def _plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, str):
        return value
    number = float(value)
    return None if math.isnan(number) else number


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_df, con, sql: str, exact: bool = True) -> list[str]:
    """What differs between a Spark result and an SQL result; empty if nothing does."""
    rows = spark_df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    other = found.fetchall()
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    if len(rows) != len(other):
        return [f"rows {len(rows)} vs {len(other)}"]
    ours = _sorted_rows(spark_df.columns, rows)
    theirs = _sorted_rows(names, other)
    for a, b in zip(ours, theirs):
        if a != b:
            problems.append(f"{a} vs {b}")
    return problems


def run(spark, entries, oracle, sf_dir: str, names=None) -> dict[str, tuple[int, float, list[str]]]:
    con = open_tables(sf_dir)
    report = {}
    for name, build in entries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problems = differences(build(spark, sf_dir), con, oracle[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        report[name] = (len(problems), time.time() - start, problems[:3])
    return report
