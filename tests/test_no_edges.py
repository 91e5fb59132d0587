"""Queries on vectors whose variables have no correlation at all, so that their graph has no edge."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from causeway.functions import arrays
from causeway.operators import attribution
from causeway.plans import registry
from tests.test_queries import plain


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """256 vectors of 64 components: columns of a Hadamard matrix are orthogonal to each other and to the constant."""
    h = np.ones((1, 1))
    while len(h) < 256:
        h = np.block([[h, h], [h, -h]])
    out = tmp_path_factory.mktemp("no-edges")
    x = (h[:, 1:65] * (1 + np.arange(256)[:, None] // 128)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": range(256), "embedding": list(x), "label": pa.array([k % 3 for k in range(256)], pa.int32())}), f"{out}/embeddings.parquet")
    return str(out)


def agree(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    assert con.execute("select count(*) from embeddings").fetchone() == (256,)
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert ours == sorted(tuple(map(plain, row)) for row in result)
    return ours


def test_gates_of_no_edge(spark, folder):
    assert agree(spark, folder, "graa_gate_variants") == [("0.1", "None", "None", "None", "None")]
    w = spark.createDataFrame([(0.4,), (0.2,), (0.6,)], "w double")
    for n in (0, 1, 2):
        few = w.limit(n)
        assert few.agg(arrays.trimmed_mean(F.collect_list("w")).alias("m")).first().m is None
        assert attribution.graa_gate(few, how="trimmed").first().gate == 0
    assert attribution.graa_gate(w, how="trimmed").first().gate == pytest.approx(0.4)


def test_precision_and_recall_of_nothing_true(spark, folder):
    assert agree(spark, folder, "edge_prf") == [("1.0", "1.0", "1.0")]


def test_deletions_tell_instances_without_edges(spark, folder):
    assert len(agree(spark, folder, "audit_deletions")) == 8


def test_two_references_tell_instances_without_edges(spark, folder):
    assert len(agree(spark, folder, "dual_reference")) == 4
