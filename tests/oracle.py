"""Compare a query with its SQL in DuckDB: same column names, same rows regardless of order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def rows_of(records: list[dict]) -> Counter:
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    return Counter(tuple((k, plain(r[k])) for k in sorted(r)) for r in records)


def sql_rows(sf_dir: str, sql: str) -> list[dict]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def difference(spark, query, sql: str, sf_dir: str) -> str:
    mine = [r.asDict(recursive=True) for r in query(spark, sf_dir).collect()]
    other = sql_rows(sf_dir, sql)
    if mine and other and sorted(mine[0]) != sorted(other[0]):
        return f"columns {sorted(mine[0])} and {sorted(other[0])}"
    a, b = rows_of(mine), rows_of(other)
    if a == b:
        return ""
    return f"{len(mine)} and {len(other)} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
