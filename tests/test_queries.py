"""Every catalogued query against the SQL that DuckDB answers it by, on the smallest tables."""

import math
import os

import duckdb
import pytest

from ratelens.plans import analogue_queries, constraint_queries, event_queries, extraction_queries, finance_queries, market_queries, page_queries, product_queries, report_queries, snapshot_queries, text_queries  # noqa: F401 (they register)
from ratelens.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>", "None"):
        return ""
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x.item() if hasattr(x, "item") else x)


def rows(frame):
    """Rows as tuples of text; columns of whole numbers compare as integers, whatever type holds them."""
    columns = []
    for c in sorted(frame.columns):
        values = frame[c].tolist()
        whole = frame[c].dtype.kind == "f" and all(v is None or v != v or float(v).is_integer() for v in values)
        columns.append([int(v) if whole and v is not None and v == v else v for v in values])
    return sorted(tuple(map(value, r)) for r in zip(*columns))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
