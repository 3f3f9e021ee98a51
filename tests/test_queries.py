"""Every query runs on the smallest test data, and those with SQL give the rows of the SQL."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("PARLANCE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _registry():
    """The queries of the core; those of the subpackage are tested beside it."""
    from parlance.plans import registry

    return registry


#: Reports whose rows the smallest test data lack.
EMPTY = {"short_prompt_alerts", "patterns_by_category", "snapshot_history"}


def same(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(_registry().SQL))
def test_sql(spark, db, name):
    df = _registry().QUERIES[name](spark, DATA)
    found = db.sql(_registry().SQL[name])
    names = found.columns
    columns = sorted(df.columns)
    assert sorted(names) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=key)
    want = sorted((tuple(same(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=key)
    assert got == want and (got or name in EMPTY)


@pytest.mark.parametrize("name", sorted(set(_registry().QUERIES) - set(_registry().SQL)))
def test_rows(spark, name):
    # Loops and groups may be none in the smallest data.
    assert _registry().QUERIES[name](spark, DATA).count() >= (0 if name in ("agent_loops", "step_loops", "recurring_topics", "similar_groups", "similar_components") else 1)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(_registry().QUERIES) <= set(__spark_entry__.queries())


def test_core_stands_alone():
    """Nothing outside the subpackage imports it, but the driver's entry, which does without."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "parlance")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "parlance.llm" not in text.read(), f
