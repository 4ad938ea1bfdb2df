"""Comparison of a query with its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(frame: pd.DataFrame) -> list[str]:
    cols = sorted(frame.columns)
    return sorted(repr(tuple(map(_plain, r))) for r in frame[cols].itertuples(index=False))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y), (len(x), len(y))
    assert x == y, [p for p in zip(x, y, strict=True) if p[0] != p[1]][:3]
