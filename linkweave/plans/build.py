"""From dumps or dump tables to a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import LinkGraph
from ..operators.resolve import edges, vertices
from ..operators.store import stage
from ..sources.dump import dump_path, read_dump, read_plain_dump

# The columns that are read of each dump.
COLUMNS = {
    "page": ["page_id", "page_title", "page_namespace", "page_is_redirect"],
    "redirect": ["rd_from", "rd_namespace", "rd_title"],
    "linktarget": ["lt_id", "lt_namespace", "lt_title"],
    "pagelinks": ["pl_from", "pl_from_namespace", "pl_target_id"],
}


def graph_from_tables(pages: DataFrame, redirects: DataFrame, targets: DataFrame, links: DataFrame, mode: str = "reference", staged: bool = False) -> LinkGraph:
    """staged: links and nodes are computed at once and kept, for a graph that is used more than once."""
    found = edges(pages, redirects, targets, links, mode)
    if staged:
        found = stage(found, "links")
        return LinkGraph(stage(vertices(pages, found), "nodes"), found)
    return LinkGraph(vertices(pages, found), found)


def graph_from_dumps(spark: SparkSession, folder: str, language: str, mode: str = "reference", compressed: bool = True, plain_pagelinks: bool = False, staged: bool = True) -> LinkGraph:
    """plain_pagelinks reads that dump by position, which is enough where its tuples hold numbers only."""
    tables = []
    for table, columns in COLUMNS.items():
        read = read_plain_dump if plain_pagelinks and table == "pagelinks" else read_dump
        tables.append(read(spark, dump_path(folder, language, table, compressed), table, columns))
    return graph_from_tables(*tables, mode=mode, staged=staged)
