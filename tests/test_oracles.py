"""Every registered query against its SQL oracle (DuckDB) at sf0.001, like the driver's gate."""

import duckdb
import pytest

from talentlake.plans.catalog import ORACLES, QUERIES
from talentlake.sources.driver_tables import DRIVER_TABLES
from tests.test_plans import STREAMING, check_plan
from tools.compare import table_hash, type_diff


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in STREAMING:
        check_plan(name, df)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert not type_diff(df, res.description)
    assert len(rows) == len(orows)
    assert table_hash(df.columns, rows)[0] == table_hash(ocols, orows)[0]
