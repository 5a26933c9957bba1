"""Every registered reference query against DuckDB on the smallest tables."""

import os

import pytest

from octavo.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("OCTAVO_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object)
    return names, sorted(tuple(map(str, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


def whole(frame, schema, other):
    """Spark's pandas frame shows integers beside nulls as floats, DuckDB's as Int64: take them from the former as integers too."""
    for f in schema:
        if f.dataType.typeName() in ("integer", "long") and frame[f.name].dtype.kind == "f" and str(other[f.name].dtype).startswith("Int"):
            frame[f.name] = frame[f.name].astype("Int64")
    return frame


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.execute(ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(whole(df.toPandas(), df.schema, want)) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name == "wide_integers":
        assert (got["again"].str.upper() == got["was"]).all()
