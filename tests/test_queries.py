"""Every query of the catalogue against its SQL, on the same tables."""

import math
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from meshquarry.plans import audits_catalog, catalog, picks_catalog, plans_catalog, rules_catalog, volume_catalog, work_catalog  # noqa: F401  adds its queries to the catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime) else v if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_like_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF_DIR)
    told = duck.execute(catalog.SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0
