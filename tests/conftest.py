import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for the Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.streaming.stateStore.stateSchemaCheck", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
ORACLE = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ORACLE}/{t}.parquet'")
    return con


def same_rows(spark_df, con, sql: str) -> None:
    """Rows of a query and of its SQL are equal, in any order; doubles to 1e-5."""
    import pandas as pd

    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns)
    for df in (got, want):
        for c in columns:
            if df[c].dtype == object or str(df[c].dtype).startswith(("str", "boolean", "bool")):
                df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
    by = [c for c in columns if str(got[c].dtype) != "float64"] + [c for c in columns if str(got[c].dtype) == "float64"]
    got, want = (df[columns].sort_values(by, kind="stable", na_position="first").reset_index(drop=True) for df in (got, want))
    for c in columns:
        if got[c].dtype == object or str(got[c].dtype).startswith("str"):
            assert got[c].fillna("").tolist() == want[c].fillna("").tolist(), c
        else:
            a, b = got[c].astype(float), want[c].astype(float)
            assert ((a - b).abs().fillna(0) <= 1e-5 * (1 + b.abs().fillna(0))).all() and (a.isna() == b.isna()).all(), c
