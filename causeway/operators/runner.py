"""Runs queries by name: from one on, or only some; failures are logged and do not stop the rest."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run(
    spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], only: list[str] | None = None, since: str | None = None, repeats: int = 1, timeout: float | None = None
) -> list[tuple[str, str, float]]:
    """(name, status, median seconds) of each query in order. A query over `timeout` seconds has its jobs cancelled and counts as
    failed."""
    names = list(queries)
    if since:
        names = names[names.index(since) :]
    out = []
    for name in names:
        if only and name not in only:
            continue
        times, status = [], "ok"
        for _ in range(repeats):
            began = time.perf_counter()
            spark.addTag("causeway-run")
            watch = threading.Timer(timeout, spark.interruptTag, ["causeway-run"]) if timeout else None
            if watch:
                watch.start()
            try:
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as error:
                status = f"failed: {type(error).__name__}"
                break
            finally:
                if watch:
                    watch.cancel()
                spark.removeTag("causeway-run")
            times.append(time.perf_counter() - began)
        out.append((name, status, sorted(times)[len(times) // 2] if times else 0.0))
    return out
