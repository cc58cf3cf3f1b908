"""The link graph: edges keyed by page ids, dense vertex numbers, and compressed sparse row arrays as tables.

What several operators need (the vertex numbers, the edges by them, the links by either end) is staged once for a graph
and read by all of them, however many requests it answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stage

#: Bits of monotonically_increasing_id() below those of the partition.
_ROW_BITS = 33


def _bases(rows: DataFrame, amount: Column) -> DataFrame:
    """_part, _base, _end: the sums of all parts before each part, and with it; a row a part."""
    totals = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    upto = F.sum("_sum").over(Window.orderBy("_part"))
    return totals.select("_part", (upto - F.col("_sum")).alias("_base"), upto.alias("_end"))


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Adds before (how many rows come before each in the order of the keys) and _part (the range that a row is in).

    Rows are dealt by ranges of the keys and sorted; a row's place in its range is known as it is written, and only the
    ranges' numbers of rows meet. Ranges are as many as the session's shuffles have parts.
    """
    rows = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.join(F.broadcast(_bases(rows, F.lit(1))), "_part").select(*df.columns, "_part", (F.col("_base") + place).alias("before"))


@dataclass
class LinkGraph:
    """nodes(page_id) and links(src, dst) by page id; links keep duplicates and self-loops."""

    nodes: DataFrame
    links: DataFrame
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is staged the first time that it is asked for."""
        if name not in self._kept:
            self._kept[name] = stage(make(), name)
        return self._kept[name]

    def _index(self) -> DataFrame:
        return self._once("index", lambda: numbered(self.nodes.select("page_id"), "page_id").withColumnRenamed("before", "idx"))

    def vertex_index(self) -> DataFrame:
        """page_id, idx: dense numbers from 0 in the order of page_id."""
        return self._index().select("page_id", "idx")

    def indexed_edges(self) -> DataFrame:
        """src_idx, dst_idx of every link whose ends are both vertices."""

        def make() -> DataFrame:
            index = self.vertex_index()
            out = self.links.join(index.select(F.col("page_id").alias("src"), F.col("idx").alias("src_idx")), "src")
            return out.join(index.select(F.col("page_id").alias("dst"), F.col("idx").alias("dst_idx")), "dst").select("src_idx", "dst_idx")

        return self._once("indexed-edges", make)

    def pairs(self, reverse: bool = False) -> DataFrame:
        """near, far, links: each pair of linked pages, and how many links a search would follow from far, duplicates
        counted; in ranges of the end that the search comes from."""
        near, far = ("dst", "src") if reverse else ("src", "dst")

        def make() -> DataFrame:
            pairs = stage(self.links.select(F.col(near).alias("near"), F.col(far).alias("far")).distinct(), "distinct-links")
            onward = stage(self.links.groupBy(F.col(near).alias("far")).agg(F.count("*").alias("links")), "link-counts")
            rows = pairs.join(onward, "far", "left").select("near", "far", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
            return rows.repartitionByRange("near", "far").sortWithinPartitions("near", "far")

        return self._once(f"pairs-{reverse}", make)

    def adjacency(self, reverse: bool = False) -> DataFrame:
        """Each vertex that has any with its neighbours, ascending, duplicates included."""
        key, other = ("dst", "src") if reverse else ("src", "dst")
        return self.links.groupBy(key).agg(F.array_sort(F.collect_list(other)).alias("neighbours"))

    def degrees(self, reverse: bool = False) -> DataFrame:
        """page_id, degree of every vertex, 0 included."""
        key = "dst" if reverse else "src"
        counts = self.links.groupBy(F.col(key).alias("page_id")).agg(F.count("*").alias("degree"))
        return self.nodes.join(counts, "page_id", "left").select("page_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def _runs(self, reverse: bool) -> DataFrame:
        """idx, _part, off, degree, _end of every vertex: where its run of edges begins, and where that of its range ends."""

        def make() -> DataFrame:
            rows = stage(self._index().join(self.degrees(reverse), "page_id").select("idx", "_part", "degree"), "degrees")
            own = F.sum("degree").over(Window.partitionBy("_part").orderBy("idx")) - F.col("degree")
            return rows.withColumn("_own", own).join(F.broadcast(_bases(rows, F.col("degree"))), "_part").select("idx", "_part", (F.col("_base") + F.col("_own")).alias("off"), "_end")

        return self._once(f"runs-{reverse}", make)

    def offsets(self, reverse: bool = False) -> DataFrame:
        """idx, off: where each vertex's run of edges begins; the last row, idx = number of vertices, has their number."""
        rows = self._runs(reverse)
        end = rows.agg(F.count("*").alias("idx"), F.coalesce(F.max("_end"), F.lit(0)).cast("long").alias("off"))
        return rows.select("idx", "off").union(end)

    def degrees_from_offsets(self, reverse: bool = False) -> DataFrame:
        """idx, degree: the difference of neighbouring offsets, within ranges of vertices."""
        after = F.coalesce(F.lead("off").over(Window.partitionBy("_part").orderBy("idx")), F.col("_end"))
        return self._runs(reverse).select("idx", (after - F.col("off")).alias("degree"))

    def csr_edges(self, reverse: bool = False) -> DataFrame:
        """pos, idx: the array of neighbours, by vertex and neighbour ascending (a multiset's order is free).

        Ranges are of both, so a vertex of many links is in many of them.
        """
        key, other = ("dst_idx", "src_idx") if reverse else ("src_idx", "dst_idx")
        rows = self.indexed_edges().select(F.col(key).alias("v"), F.col(other).alias("idx"))
        return numbered(rows, "v", "idx").select(F.col("before").alias("pos"), "idx")

    def stats(self) -> DataFrame:
        """One row: vertices, the lengths of the offset and edge arrays, and their last elements, both ways."""
        pairs = self.indexed_edges()
        ways = (("", False, "src_idx", "dst_idx"), ("reverse_", True, "dst_idx", "src_idx"))
        sides = [self.vertex_index().agg(F.count("*").alias("vertices"), (F.count("*") + 1).alias("offsets_len"), (F.count("*") + 1).alias("reverse_offsets_len"))]
        last = [F.max(F.struct(v, w))[w].alias(f"last_{name}edge") for name, _, v, w in ways]
        sides.append(pairs.agg(F.count("*").alias("edges_len"), F.count("*").alias("reverse_edges_len"), *last))
        sides += [self.offsets(reverse).agg(F.max_by("off", "idx").alias(f"last_{name}offset")) for name, reverse, *_ in ways]
        rows = sides[0]
        for side in sides[1:]:
            rows = rows.unionByName(side, allowMissingColumns=True)
        return rows.agg(*[F.max(c).alias(c) for c in ("vertices", *(f"{name}{c}" if c.endswith("len") else c for name, *_ in ways for c in ("offsets_len", "edges_len", f"last_{name}offset", f"last_{name}edge")))])

    def offsets_tail(self, n: int = 10) -> DataFrame:
        return self.offsets().orderBy(F.col("idx").desc()).limit(n)

    def save(self, path: str) -> None:
        """Two Parquet tables; links are in ranges of source and target, so what a source has lies together."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.links.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/links")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinkGraph:
        """What save() wrote; columns that aren't those of a graph are an error."""
        nodes, links = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links")
        if set(nodes.columns) != {"page_id"} or set(links.columns) != {"src", "dst"}:
            raise ValueError(f"{path} doesn't hold a link graph")
        return cls(nodes, links)
