import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(table, columns):
    """Rows as sorted texts, columns in the given order."""
    return sorted(repr(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in (r[c] for c in columns))) for r in table)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Asserts that a query gives what its SQL gives."""

    def check(query, sql):
        df = query(spark, data)
        columns = sorted(df.columns)
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows(df.collect(), columns) == rows([dict(zip(names, r, strict=True)) for r in got.fetchall()], columns)

    return check
