from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from veilspark.plans.texts import TABLES

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ORACLE}/{t}.parquet'")
    return con


def normal(rows):
    """Sorted rows with floats rounded, for comparison across engines."""
    fixed = [tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(fixed, key=repr)


@pytest.fixture(scope="session")
def against_oracle(spark, duck):
    def check(query, sql):
        df = query(spark, ORACLE)
        names = sorted(df.columns)
        mine = normal(df.select(*(f"`{c}`" for c in names)).collect())
        theirs = normal(duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall())
        assert mine == theirs
        return mine

    return check
