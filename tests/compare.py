"""Run a query and its SQL on the same tables and compare the rows as multisets."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _counted(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = _counted(found.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    actual = _counted(df.collect(), df.columns)
    missing, surplus = expected - actual, actual - expected
    report = [f"missing {r}" for r in list(missing)[:3]] + [f"surplus {r}" for r in list(surplus)[:3]]
    if report:
        report.append(f"{missing.total()} missing, {surplus.total()} surplus of {expected.total()}")
    if not expected:
        report.append("no rows to compare")
    return report
