"""The queries against their SQL, as the driver compares them."""

import duckdb
import pytest

from quillon.llm import registry


@pytest.mark.parametrize("name", registry.ORACLES)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    out = con.execute(registry.ORACLES[name])
    want = [dict(zip([d[0] for d in out.description], r)) for r in out.fetchall()]
    got = [r.asDict() for r in registry.QUERIES[name](spark, f"/root/testdata/{sf}").collect()]
    assert sorted(map(repr, (sorted(x.items()) for x in got))) == sorted(map(repr, (sorted(x.items()) for x in want)))
