"""The stateful stream on weeks of many files, and on rows that come between two watermarks."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.plans import registry
from causeway.streaming import series
from tests.test_queries import DATA, plain


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_weeks_of_many_files(spark, tmp_path):
    import duckdb

    spark.read.parquet(f"{DATA}/events.parquet").repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "32768b")  # a partition a file
    try:
        rows = registry.QUERIES["stream_attribution"](spark, str(tmp_path)).collect()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    columns = ["unit", "w", "var", "n", "phi"]
    want = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES['stream_attribution']})").fetchall()
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_rows_between_two_watermarks(spark, tmp_path):
    """A row that is in time by the last micro-batch's watermark, of a window whose end this one's has passed."""
    for k, hours in enumerate(([1], [100], [70, 101], [300])):
        pdf = pd.DataFrame({"unit": 0, "ts": pd.to_datetime([h * 3_600_000_000 for h in hours], unit="us"), "hour": hours, "var": 0, "value": 1.0})
        rows = spark.createDataFrame(pdf).select(F.col("unit").cast("int"), "ts", F.col("hour").cast("long"), F.col("var").cast("int"), "value")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        os.utime(next(p.path for p in sorted(os.scandir(f"{tmp_path}/in"), key=lambda p: -p.stat().st_mtime) if p.name.endswith(".parquet")), (1e9 + k, 1e9 + k))
    source = spark.readStream.schema("unit int, ts timestamp, hour long, var int, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = series.run_available(series.attributed_windows(source, [0.0], [1.0], 24, "25 hours"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {(r.w, r.n) for r in found.collect()} == {(0, 1), (2, 1), (4, 2)}
    assert found.count() == 3
