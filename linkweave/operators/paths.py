"""All shortest paths between two pages, by a search from both ends.

The graph's links lie staged in ranges of their source, and again of their target. Each round expands the side whose
frontier has fewer links by one whole level: a join of the frontier with the links, an anti join with the levels that
the side has seen, and a table in the shared folder. A frontier of at most FILTER_IDS nodes is a filter of the scan,
which skips ranges without them; one of at most BROADCAST_ROWS is broadcast, so links aren't shuffled. Beyond such small
frontiers the driver sees counts only. Paths are then read off the levels' parent tables, a join a level. Which side is
expanded never changes the result; links that occur twice and self-loops don't either.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import LinkGraph
from .store import stage

#: Nodes of a frontier, 8 bytes each, that are put into the scan's filter, and that are sent to all tasks.
FILTER_IDS, BROADCAST_ROWS = 500, 1_000_000
#: Levels that are put into one table.
TOGETHER = 8


def _unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select(F.col("node").alias("child")), "child", "left_anti")


def expand(frontier: DataFrame, links: DataFrame, seen: DataFrame, reverse: bool = False) -> DataFrame:
    """child, parent: what the frontier's nodes link to (or are linked from) and the side hasn't seen."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    found = frontier.select(F.col("node").alias("parent")).join(links.select(F.col(near).alias("parent"), F.col(far).alias("child")), "parent")
    return _unseen(found.select("child", "parent").distinct(), seen)


def frontier_links(frontier: DataFrame, links: DataFrame, reverse: bool = False) -> DataFrame:
    """One row, links: how many links the frontier's nodes have, duplicates counted."""
    key = "dst" if reverse else "src"
    return frontier.select("node").join(links.select(F.col(key).alias("node")), "node").agg(F.count("*").alias("links"))


def meet(frontier: DataFrame, depth: int, other: DataFrame) -> DataFrame:
    """node, length: frontier nodes that the other side has seen, with the shortest path that goes through each."""
    return frontier.select("node").join(other, "node").select("node", (F.col("dist") + depth).alias("length"))


@dataclass
class Side:
    """One end's search: its frontier (of size nodes and links links), levels of (child, parent), and what it has seen."""

    graph: LinkGraph
    start: int
    reverse: bool = False
    depth: int = 0
    size: int = 1
    links: int = 0
    levels: list[DataFrame] = field(default_factory=list)
    seen_levels: list[DataFrame] = field(default_factory=list)
    #: The frontier's nodes, where they are few.
    few: list[int] | None = None

    def __post_init__(self) -> None:
        self.pairs = self.graph.pairs(self.reverse)
        self.frontier, self.few = _ids(self.graph.nodes, self.start), [self.start]
        self.seen_levels.append(self.frontier.select("node", F.lit(0).alias("dist")))

    @property
    def visited(self) -> DataFrame:
        """node, dist of all levels, a row for each way in from the level before."""
        return reduce(DataFrame.unionByName, self.seen_levels)

    @property
    def seen(self) -> DataFrame:
        """node, dist of all levels."""
        return self.visited.distinct()

    def advance(self) -> None:
        if self.few is not None:
            found = self.pairs.where(F.col("near").isin(self.few))
        else:
            some = F.broadcast(self.frontier) if self.size <= BROADCAST_ROWS else self.frontier
            found = self.pairs.join(some.select(F.col("node").alias("near")), "near")
        step = stage(_unseen(found.select(F.col("far").alias("child"), F.col("near").alias("parent"), "links"), self.visited), "level")
        self.depth += 1
        self.levels.append(step)
        self.frontier = step.select(F.col("child").alias("node")).distinct()
        self.seen_levels.append(step.select(F.col("child").alias("node"), F.lit(self.depth).alias("dist")))
        if len(self.seen_levels) > TOGETHER:
            self.seen_levels = [stage(self.seen, "seen")]

    def weigh(self, other: Side | None = None) -> int | None:
        """Counts the frontier's nodes and links; the length of the shortest path through a node that the other has seen."""
        rows = self.levels[-1].withColumnRenamed("child", "node")
        rows = rows.withColumn("dist", F.lit(None).cast("int")) if other is None else rows.join(other.visited, "node", "left")
        rows = rows.groupBy("node").agg(F.max("links").alias("links"), F.min("dist").alias("dist"))
        some = rows.limit(FILTER_IDS + 1).collect()
        if len(some) <= FILTER_IDS:
            self.few = [r["node"] for r in some]
            self.size, self.links = len(some), sum(r["links"] for r in some)
            near = min((r["dist"] for r in some if r["dist"] is not None), default=None)
        else:
            self.few = None
            self.size, self.links, near = rows.agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0)), F.min("dist")).first()
        return None if near is None else near + self.depth


def _ids(df: DataFrame, *values: int) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "node long")


def all_shortest_paths(graph: LinkGraph, start: int, goal: int) -> DataFrame:
    """path: an array of page ids from start to goal for each shortest path; no rows if there is none or an id is unknown."""
    nodes = graph.nodes
    nothing = nodes.sparkSession.createDataFrame([], "path array<bigint>")
    known = {r["page_id"] for r in nodes.where(F.col("page_id").isin(start, goal)).select("page_id").distinct().collect()}
    if not {start, goal} <= known:
        return nothing
    if start == goal:
        return nodes.sparkSession.createDataFrame([([start],)], "path array<bigint>")
    sides = [Side(graph, start), Side(graph, goal, True)]
    length: int | None = None
    while length is None and all(s.size for s in sides):
        at = 0 if sides[0].links <= sides[1].links else 1
        side, other = sides[at], sides[1 - at]
        side.advance()
        length = side.weigh(other)
    if length is None:
        return nothing
    found = meet(side.frontier, side.depth, other.seen).where(F.col("length") == length).select("node")
    reach = {at: side.depth, 1 - at: length - side.depth}
    paths = found.select("node", F.array("node").alias("path"))
    for k, s in enumerate(sides):
        ends = paths.withColumn("_end", F.col("node"))
        for level in range(reach[k], 0, -1):
            step = s.levels[level - 1].select(F.col("child").alias("_end"), F.col("parent").alias("_next"))
            longer = F.concat("path", F.array("_next")) if s.reverse else F.concat(F.array("_next"), F.col("path"))
            ends = ends.join(step, "_end").select("node", longer.alias("path"), F.col("_next").alias("_end"))
        paths = ends.select("node", "path")
    return stage(paths.select("path").distinct(), "paths")
