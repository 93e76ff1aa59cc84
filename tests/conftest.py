import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Compares a query with its SQL: names of columns, number of rows, values."""

    def check(query, sql):
        got = query(spark, sf_dir)
        told = duck.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(told.columns)
        mine = got.select(*names).collect()
        theirs = told.df()[names].astype(object)
        theirs = theirs.where(theirs.notna(), None).itertuples(index=False)
        assert plain(mine) == plain(theirs)

    return check
