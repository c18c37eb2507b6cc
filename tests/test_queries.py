"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stemmata.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        held.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return held


def _plain(value):
    if hasattr(value, "asDict"):
        return tuple(_plain(x) for x in value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    made = registry.QUERIES[name](spark, SF)
    got = rows(made.columns, [tuple(r) for r in made.collect()])
    if name in registry.ORACLE:
        asked = duck.sql(registry.ORACLE[name])
        assert sorted(made.columns) == sorted(asked.columns)
        assert got == rows(asked.columns, asked.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "item_id", "run"]
