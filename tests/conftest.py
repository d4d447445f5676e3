import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_duckdb(sql: str, sf: str = SF):
    import os

    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.sql(sql).df()


def same(a, b) -> None:
    cols = sorted(a.columns)
    import pandas as pd

    assert cols == sorted(b.columns)
    assert len(a) == len(b)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, float) or hasattr(v, "is_integer") else v
    rows = lambda d: sorted([tuple(plain(v) for v in r) for r in d[cols].astype(object).itertuples(index=False)], key=key)
    for x, y in zip(rows(a), rows(b)):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-6 * max(1, abs(u))), (x, y)
