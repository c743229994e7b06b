"""Every registered page query against its SQL in another engine, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from pagelens.plans import registry
from pagelens.sources import snapshots

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    def plain(v):
        if isinstance(v, list) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(map(plain, v))
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["thin_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = registry.QUERIES["visited_anti"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan
    plan = registry.QUERIES["url_host_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan


def test_binary_snapshots(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    shots = snapshots.from_files(spark, str(tmp_path), "https://e.com/docs/")
    asked = spark.createDataFrame([("https://E.com/docs/a.pdf#x",), ("https://e.com/none",)], "url string")
    got = {r.url: r for r in snapshots.look_up(asked, shots).collect()}
    assert got["https://E.com/docs/a.pdf#x"].content_length == 4 and got["https://E.com/docs/a.pdf#x"].is_document and got["https://e.com/none"].status is None
