"""Every query of the document engine against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from quillmill.plans.oracles import ORACLES
from quillmill.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert got == sorted([plain(r[c]) for c in columns] for r in rows)
    if name not in ("fts_phrase_prefix", "fts_single", "suggest"):
        assert got
