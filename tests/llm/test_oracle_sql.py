"""The registered queries against their SQL, in another engine."""

from numbers import Number
from pathlib import Path

import duckdb
import pytest

from pagelens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    with duckdb.connect() as duck:
        for path in Path(SF).glob("*.parquet"):
            duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        plain = [["" if missing else float(v) if isinstance(v, Number) else str(v) for v, missing in zip(r, m, strict=True)] for r, m in zip(frame.to_numpy(object), frame.isna().to_numpy(), strict=True)]
        return sorted(plain, key=str)

    got, want = got[sorted(got.columns)], want[sorted(want.columns)]
    assert rows(got) == rows(want)
