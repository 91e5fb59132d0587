"""The test tables as series, windows and cells; Parquet scans with the columns that are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import hashing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-step windows: window_id, label, values (array of double)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("window_id"), "label", F.col("embedding").cast("array<double>").alias("values")
    )


def cells(windows: DataFrame, keep: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Long form: a row per window and variable."""
    return windows.select(*keep, F.posexplode("values").alias("var", "x"))


def injected(windows: DataFrame, strength: float = 0.35, seed: int = 0) -> DataFrame:
    """Every window with a step added to one variable, drawn by hash; roots holds that variable."""
    root = F.floor(hashing.uniform(seed, F.col("window_id"), "root") * F.size("values")).cast("int")
    rows = windows.withColumn("root", root)
    values = F.transform("values", lambda x, i: x + F.when(i == F.col("root"), F.lit(strength)).otherwise(0.0))
    return rows.withColumn("values", values).withColumn("roots", F.array("root")).drop("root")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations (unit, t, var, x): hourly sums of value by event type, gaps as 0; unit = user_id % 4, t = hour of the month."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("int").alias("unit"),
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000)).cast("long").alias("t"),
        "event_type",
        "value",
    )
    kinds = events.select("event_type").distinct().groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    sums = events.groupBy("unit", "t", "event_type").agg(F.sum("value").alias("x"))
    grid = events.groupBy("unit").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = grid.withColumn("t", F.explode(F.sequence("a", "b"))).join(F.broadcast(kinds))  # one row
    grid = grid.select("unit", "t", F.posexplode("kinds").alias("var", "event_type"))
    return grid.join(sums, ["unit", "t", "event_type"], "left").select("unit", "t", "var", F.coalesce("x", F.lit(0.0)).alias("x"))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations (unit, t, var, x): order value by day and nation; unit = region."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("t"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "t").agg(F.sum("o_totalprice").alias("x"))
    return rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("unit"), "t", F.col("c_nationkey").alias("var"), "x"
    )
