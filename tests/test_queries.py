"""Every query of the engine proper against its SQL twin."""

import duckdb
import pytest

from docflow.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "orders", "lineitem", "part", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(catalogue.ORACLES[name])
    names = ", ".join(f'"{c}"' for c in columns)
    assert sorted(want.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(con.sql(f"SELECT {names} FROM ({catalogue.ORACLES[name]})").fetchall())
