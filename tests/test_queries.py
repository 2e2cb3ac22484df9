"""Every registered query of the raster, vector and evidence operators against its SQL, on the first rows of the driver's smallest tables."""

import os

import duckdb
import pytest

from tessera import catalog

SOURCE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"COPY (SELECT * FROM '{SOURCE}/{t}.parquet' LIMIT 120) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, base


def normal(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(round(v, 4) if isinstance(v, float) and v == v else str(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    folder, base = tables
    got = catalog.queries()[name](spark, folder).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = base.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
