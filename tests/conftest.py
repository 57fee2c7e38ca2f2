import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC"}
    s = SparkSession.builder.master("local[8]").config(map=conf | {"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


def canonical(rows, columns):
    """Rows with columns by name, as sorted text; whole doubles read as integers."""

    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if hasattr(v, "as_tuple"):
            v = float(v)
        if isinstance(v, float):
            return repr(int(v)) if v == int(v) else f"{v:.5g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(one(r[i]) for i in order) for r in rows), [columns[i] for i in order]
