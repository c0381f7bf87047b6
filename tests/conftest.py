import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false")  # tables are tiny; compiling would take most of the time
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the driver's tables at the small scale."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'").fetchall()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'").fetchall()
    return con


def plain(rows, columns):
    """Rows as sorted tuples of text, whatever engine they came from."""

    def cell(v):
        if v is None or v != v:
            return "<null>"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Assert that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, SF)
        got = plain([tuple(r) for r in df.collect()], df.columns)
        rows = duck.execute(sql).fetchdf().astype(object)
        rows = rows.where(rows.notna(), None)
        assert sorted(df.columns) == sorted(rows.columns)
        want = plain(rows.itertuples(index=False, name=None), list(rows.columns))
        ints = [tuple(x.removesuffix(".0") for x in r) for r in got], [tuple(x.removesuffix(".0") for x in r) for r in want]
        assert ints[0] == ints[1]

    return check
