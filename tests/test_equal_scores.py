"""Vectors of few different values, many of whose scores are equal but for the order of their sums."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from causeway.plans import registry
from tests.test_queries import plain


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """1,500 vectors of -1, 0 and 1 eighths; variables share one of 16 factors half of the time."""
    rng, n = np.random.default_rng(1), 1500
    factors = rng.integers(-1, 2, (n, 16))
    x = np.where(rng.random((n, 64)) < 0.5, factors[:, np.arange(64) % 16], rng.integers(-1, 2, (n, 64))) * 0.125
    out = tmp_path_factory.mktemp("equal-scores")
    pq.write_table(pa.table({"vec_id": range(n), "embedding": list(x.astype(np.float32)), "label": pa.array([k % 10 for k in range(n)], pa.int32())}), f"{out}/embeddings.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["dual_reference", "audit_deletions"])
def test_equal_scores_are_ties(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(map(plain, row)) for row in con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall())
