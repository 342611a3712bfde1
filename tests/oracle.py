"""Hold queries against their SQL on the small tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """What differs, or ''."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    cols = sorted(got.columns)

    def norm(df):
        rows = [tuple(None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r) for r in df[cols].itertuples(index=False)]
        return sorted(rows, key=lambda r: tuple((x is None, str(type(x).__name__ in ("int", "float")), x if isinstance(x, (int, float)) else 0, str(x)) for x in r))

    bad = [(a, b) for a, b in zip(norm(got), norm(want)) if any(x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-5 * max(1, abs(x))) for x, y in zip(a, b))]
    return f"{len(bad)} rows, as {bad[0]}" if bad else ""
