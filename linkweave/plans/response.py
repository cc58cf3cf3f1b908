"""The answer to a request for all shortest paths."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import LinkGraph
from ..operators.paths import all_shortest_paths


def path_summary(paths: DataFrame) -> DataFrame:
    """One row: num_paths, and the number of nodes of a path (0 if there is none)."""
    return paths.agg(F.count("*").alias("num_paths"), F.coalesce(F.min(F.size("path")), F.lit(0)).cast("long").alias("shortest_path_length"))


def path_response(graph: LinkGraph, start: int, goal: int) -> DataFrame:
    """One row, response: JSON of paths, num_paths, shortest_path_length and time_spent_ms."""
    began = time.perf_counter()
    paths = all_shortest_paths(graph, start, goal)
    body = paths.agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("num_paths"), F.coalesce(F.min(F.size("path")), F.lit(0)).alias("shortest_path_length"))
    spent = int((time.perf_counter() - began) * 1000)
    return body.select(F.to_json(F.struct("paths", "num_paths", "shortest_path_length", F.lit(spent).alias("time_spent_ms"))).alias("response"))
