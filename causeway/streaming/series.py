"""Structured Streaming forms of the series operators. With availableNow they give what the batch forms give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, names: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A chunked file source: the files of a folder whose names match a glob, at most so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(folder)


def tumbling_sums(events: DataFrame, width: str, late: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Sums by event-time window; rows later than the watermark are dropped, windows close when it passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", *keys, "n", "total")


def sliding_means(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.avg("value").alias("mean")).select("window.start", "window.end", "event_type", "mean")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    """Gaps and islands as session windows."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, "session_window.start", "session_window.end", "n")


HOUR_MS = 3_600_000


def attributed_windows(events: DataFrame, med: list[float], mad: list[float], hours: int, late: str) -> DataFrame:
    """(unit, w, n, phi): the robust deviation of each variable over windows of `hours`, kept up in state and told once.

    events: a stream of unit, ts, hour (since the epoch), var and value; an hour's values are summed, an hour without any is 0. The
    state of a window is its sums so far. Rows may come in any order within `late`: they correct the sums of the window that they
    belong to, which stays open until the watermark has passed its end; then a timer tells it and its state goes.
    """
    med_, mad_, size = np.array(med), np.array(mad), len(med)

    def told(unit: int, w: int, n: int, sums: np.ndarray) -> pd.DataFrame:
        phi = (np.abs(sums.reshape(hours, size) - med_) / mad_).mean(0)
        return pd.DataFrame({"unit": [unit], "w": [w], "n": [n], "phi": [phi.tolist()]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, w = map(int, key)
        n, sums = (int(state.get[0]), np.array(state.get[1])) if state.exists else (0, np.zeros(hours * size))
        if state.hasTimedOut:
            state.remove()
            yield told(unit, w, n, sums)
            return
        end = (w + 1) * hours * HOUR_MS
        for pdf in batches:
            np.add.at(sums, (pdf["hour"] % hours * size + pdf["var"]).to_numpy(), pdf["value"].to_numpy())
            n += len(pdf)
        if end < state.getCurrentWatermarkMs():
            # The watermark passed the window's end at the end of the last micro-batch: these rows, which were not late then, are its last.
            if state.exists:
                state.remove()
            yield told(unit, w, n, sums)
            return
        state.update((n, sums.tolist()))
        state.setTimeoutTimestamp(end)

    keyed = events.withWatermark("ts", late).withColumn("w", F.floor(F.col("hour") / hours).cast("long"))
    out, kept = "unit int, w long, n long, phi array<double>", "n long, sums array<double>"
    return keyed.groupBy("unit", "w").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Everything there is, once, into Parquet; the checkpoint makes a second call go on from there."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
