import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a folder and returns (columns, rows)."""
    import duckdb

    def run(folder: str, sql: str):
        c = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            at = f"{p}/*.parquet" if p.is_dir() else str(p)
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
        r = c.execute(sql)
        return [x[0] for x in r.description], r.fetchall()

    return run


def same(df, columns, rows):
    """Equal as multisets, columns by name, doubles to nine digits."""
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(fix(r[n]) for n in names) for r in df.collect()), key=key)
    at = [columns.index(n) for n in names]
    b = sorted((tuple(fix(r[i]) for i in at) for r in rows), key=key)
    assert a == b
