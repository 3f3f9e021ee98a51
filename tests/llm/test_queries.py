"""The subpackage's queries on the smallest test data: those with SQL give its rows, the others their stated columns."""

import os

import pytest

from parlance.llm import registry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("PARLANCE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p4_found": ["tbl", "rec_id", "msg_no", "kind", "val"], "p4_redacted": ["tbl", "rec_id", "msg_no", "text"], "p5_found": ["tbl", "id_a", "id_b"], "p8_containers": ["container_id", "doc_id", "piece_no", "tokens"],
    "p9_edited": ["doc_id", "item_id"],
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, db, name):
    df, found = registry.QUERIES[name](spark, DATA), db.sql(registry.SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    want = sorted(tuple(dict(zip(found.columns, r, strict=True))[c] for c in sorted(df.columns)) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name] and df.count() > 0


def test_pairs_of_vectors_against_all(spark):
    """p5_found against all pairs: nine tenths of those that count, and none that does not."""
    import numpy as np

    want = set()
    for table, key, vector, dim, least in (("prompts", "id", "embedding", 64, 0.95), ("telemetry_event", "queue_id", "dna_vector", 36, 0.99)):
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key, vector).collect() if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
        v = np.array([x for _, x in rows], dtype=np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sim = v @ v.T
        np.fill_diagonal(sim, -2)
        for i, j in zip(*np.nonzero((sim >= least) & ((sim >= np.sort(sim, axis=1)[:, -5][:, None] - 1e-12) | (sim >= np.sort(sim, axis=1)[:, -5][None, :] - 1e-12))), strict=True):
            want.add((table, *sorted((rows[i][0], rows[j][0]))))
    got = {tuple(r) for r in registry.QUERIES["p5_found"](spark, DATA).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0
