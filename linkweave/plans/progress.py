"""Progress of a build: rows by Spark's own observation of a plan, and lines on what is done while it runs."""

from __future__ import annotations

import resource
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20


def clock(seconds: float | None) -> str:
    """Hours, minutes and seconds; N/A where there is no telling."""
    if seconds is None:
        return "N/A"
    minutes, s = divmod(int(max(0, seconds)), 60)
    return "{:02}h{:02}m{:02}s".format(*divmod(minutes, 60), s)


def remaining(done: int, whole: int, seconds: float) -> float | None:
    """Seconds left at the rate so far."""
    return None if not done or seconds <= 0 else max(0, whole - done) * seconds / done


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], dict]]:
    """df, and a function that tells, after an action on it, its rows, seconds and rows a second."""
    seen, began = Observation(name), time.perf_counter()

    def report() -> dict:
        rows, spent = seen.get["rows"], time.perf_counter() - began
        return {"name": name, "rows": rows, "seconds": spent, "rows_per_second": rows / spent if spent else 0.0}

    return df.observe(seen, F.count(F.lit(1)).alias("rows")), report


def progress_line(name: str, done: float, size: int, seconds: float) -> str:
    """done: the share of size bytes that has been read."""
    read = int(done * size)
    rate = read / seconds / MIB if seconds > 0 else 0.0
    memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    return f"{name}: {read / MIB:.1f} of {size / MIB:.1f} MiB, {rate:.1f} MiB/s, driver {memory:.0f} MiB, {clock(remaining(read, size, seconds))} left"


class Watch:
    """Says every few seconds what share of the running stages' tasks is done, as bytes of an input of known size."""

    def __init__(self, spark: SparkSession, name: str, size: int, say: Callable[[str], None] = print, every: float = 10.0):
        self.tracker, self.name, self.size, self.say, self.every = spark.sparkContext.statusTracker(), name, size, say, every
        self.ended, self.thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def share(self) -> float:
        stages = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s]
        tasks = sum(s.numTasks for s in stages)
        return sum(s.numCompletedTasks for s in stages) / tasks if tasks else 0.0

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            self.say(progress_line(self.name, self.share(), self.size, time.perf_counter() - self.began))

    def __enter__(self) -> Watch:
        self.began = time.perf_counter()
        self.thread.start()
        return self

    def __exit__(self, failed: type | None, *_: object) -> None:
        self.ended.set()
        self.thread.join()
        if failed is None:
            self.say(progress_line(self.name, 1.0, self.size, time.perf_counter() - self.began))
