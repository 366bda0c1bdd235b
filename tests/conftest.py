import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows(spark):
    """Compare a query with its SQL in DuckDB on the small tables."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")

    def cell(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, SMALL)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(map(cell, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        found = con.sql(sql)
        assert sorted(found.columns) == cols
        quoted = ", ".join(f'"{c}"' for c in cols)
        want = sorted(repr(tuple(map(cell, r))) for r in con.sql(f"select {quoted} from ({sql})").fetchall())
        assert got == want

    return check
