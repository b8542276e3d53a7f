"""Holds Spark results against DuckDB results of the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, reals to five places, in a stable order."""

    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        if isinstance(v, float):
            return 0.0 if abs(v) < 5e-6 else round(v, 5)
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def alike(a: list[tuple], b: list[tuple], tolerance: float = 3e-5) -> bool:
    """Equal up to the last place of reals, relative for large ones."""
    same = lambda x, y: x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= tolerance * max(1.0, abs(x)))
    return len(a) == len(b) and all(len(r) == len(s) and all(map(same, r, s)) for r, s in zip(a, b, strict=True))
