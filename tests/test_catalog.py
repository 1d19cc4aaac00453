"""Every registered query of the analyses against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from geomart.plans import catalog, catalog_models, catalog_more, catalog_rules, catalog_sources  # noqa: F401

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    cur = db.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall()), key=repr)
    found = sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=repr)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert all(x == pytest.approx(y, abs=2e-5) if isinstance(x, float) and y is not None else x == y for x, y in zip(a, b)), (a, b)
