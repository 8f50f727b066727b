import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same(spark, sf, query, sql):
    """Are a query's rows those of its SQL?"""
    import duckdb

    c = duckdb.connect()
    for t in "documents embeddings benchmark conversations events labels".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = c.sql(sql)
    assert sorted(got.columns) == cols
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    a = sorted(([value(r[x]) for x in cols] for r in df.collect()), key=repr)
    b = sorted(([value(x) for x in r] for r in got.select(*[f'"{x}"' for x in cols]).fetchall()), key=repr)
    return a == b and len(a) > 0
