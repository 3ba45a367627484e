import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def same_as_sql():
    """Compare a DataFrame with DuckDB SQL over the tables of a folder, or over given pandas tables."""
    import duckdb

    def norm(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float) and v == int(v):
            return int(v)
        if hasattr(v, "item"):
            return norm(v.item())
        if type(v).__name__ in ("NAType", "NaTType"):
            return None
        return v

    def check(df, sql, folder=None, **tables):
        con = duckdb.connect()
        if folder:
            for p in sorted(Path(folder).glob("*.parquet")):
                con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        for name, table in tables.items():
            con.register(name, table)
        rel = con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(rel.columns) == cols
        order = [rel.columns.index(c) for c in cols]
        want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
        got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        assert got == want
        return got

    return check
