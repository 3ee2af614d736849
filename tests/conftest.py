from __future__ import annotations

import math
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata")) / "sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Asserts that a query over the small tables has the rows that its SQL has."""

    def check(run, sql: str) -> int:
        df = run(spark, str(DATA))
        names = sorted(df.columns)
        ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        result = con.execute(sql)
        there = [d[0] for d in result.description]
        assert sorted(there) == names
        theirs = Counter(tuple(plain(r[there.index(c)]) for c in names) for r in result.fetchall())
        assert ours == theirs
        return sum(ours.values())

    return check
