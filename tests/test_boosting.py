"""Boosted models are fitted on all labelled rows: by passes the same trees as by one task, whatever the rows' order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import boosting

COLUMNS = ["many", "ties", "few", "hot", "same", "again", "none"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 3000
    many, ties = rng.normal(size=n), np.round(rng.normal(size=n), 2)
    many[rng.random(n) < 0.1] = np.nan
    hot = np.where(rng.random(n) < 0.9, -0.0, rng.normal(size=n))
    few = rng.integers(0, 5, n) / 4
    y = np.where(np.isnan(many), ties > 0, (many > 0.3) ^ (few > 0.5)) ^ (rng.random(n) < 0.1)
    table = [(str(k), f"f{k % 3}", f"w{k % 2}", None if k % 50 == 0 else float(y[k]), *(None if np.isnan(v[k]) else float(v[k]) for v in (many, ties, few, hot)), 1.0, float(few[k]), None) for k in range(n)]
    return spark.createDataFrame(table, "key string, fold string, side string, label double, many double, ties double, few double, hot double, same double, again double, none double").cache()


def alike(a, b):
    assert a.base == b.base and len(a.trees) == len(b.trees)
    assert all(np.array_equal(c, d) for c, d in zip(a.cuts, b.cuts, strict=True))
    assert all(np.array_equal(p, q) for s, t in zip(a.trees, b.trees, strict=True) for p, q in zip(s, t, strict=True))


def test_passes_grow_the_trees_of_one_task(rows):
    training = {"not f0": F.col("fold") != "f0", "w1": F.col("side") == "w1", "all": F.lit(True), "nothing": F.col("fold") == "f9"}
    got = boosting.fitted(rows, COLUMNS, training, at_once=0, rounds=12)
    sample = boosting.labelled(rows, COLUMNS, ["fold", "side"])
    assert len(sample) == 2940 and list(got) == list(training)
    for name, mask in (("not f0", sample["fold"] != "f0"), ("w1", sample["side"] == "w1"), ("all", sample["key"] != "")):
        part = sample[mask]
        alike(got[name], boosting.Boosted(part[COLUMNS].to_numpy(float), part["label"].to_numpy(float), rounds=12))
    few = boosting.fitted(rows, COLUMNS, {"all": F.lit(True)}, rounds=12)
    alike(got["all"], few["all"])


def test_no_labelled_row_is_left_out(spark):
    n = 200_500  # above 200,000 rows were cut before
    df = spark.range(n).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("a"))
    assert len(boosting.labelled(df, ["a"], [])) == n
    model = boosting.fitted(df, ["a"], {"all": F.lit(True)}, rounds=1)["all"]
    known = np.unique(np.quantile(np.arange(n, dtype=float), np.linspace(0, 1, 255)))
    assert np.array_equal(model.cuts[0], (known[1:] + known[:-1]) / 2)


def test_trees_hang_on_no_order(rows):
    sample = boosting.labelled(rows, COLUMNS, [])
    x, y = sample[COLUMNS].to_numpy(float), sample["label"].to_numpy(float)
    turned = np.random.default_rng(1).permutation(len(y))
    alike(boosting.Boosted(x, y, rounds=30, least=2), boosting.Boosted(x[turned], y[turned], rounds=30, least=2))


@pytest.mark.parametrize("at_once", [0, boosting.AT_ONCE])
def test_models_within_a_group_see_that_group_alone(rows, at_once):
    own = rows.withColumn("own", F.concat("side", F.lit("|"), "fold"))
    got = {r.key: r.p for r in boosting.held_out(own, COLUMNS, "own", within="side", at_once=at_once, rounds=3).collect()}
    assert len(got) == 2940
    for side in ("w0", "w1"):
        want = boosting.held_out(rows.where(F.col("side") == side), COLUMNS, "fold", rounds=3).collect()
        assert {r.key: r.p for r in want} == {r.key: got[r.key] for r in want}


def test_only_some_rows_are_trained_on(rows):
    parts = rows.withColumn("part", F.when(F.col("side") == "w0", "train").otherwise("test"))
    got = {r.key: r.p for r in boosting.held_out(parts, COLUMNS, "fold", only=F.col("part") == "train", rounds=3).collect()}
    sample = boosting.labelled(rows, COLUMNS, ["fold", "side"])
    assert set(got) == set(sample["key"][sample["side"] == "w1"])
    train, tested = sample[(sample["side"] == "w0") & (sample["fold"] != "f1")], sample[(sample["side"] == "w1") & (sample["fold"] == "f1")]
    p = boosting.Boosted(train[COLUMNS].to_numpy(float), train["label"].to_numpy(float), rounds=3).probability(tested[COLUMNS].to_numpy(float))
    assert [got[k] for k in tested["key"]] == p.tolist()
