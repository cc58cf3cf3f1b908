"""python -m linkweave build DUMPS GRAPH | path GRAPH FROM TO | stats GRAPH; settings come from the environment."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .operators.graph import LinkGraph
from .plans.build import COLUMNS, graph_from_dumps
from .plans.progress import Watch
from .plans.response import path_response
from .sources import Settings, fetch_plain


def build(spark: SparkSession, settings: Settings, dumps: str, graph: str, say=print) -> None:
    """Fetches the dumps that aren't there, builds the graph and saves it."""
    size = sum(os.path.getsize(fetch_plain(settings.language, table, dumps)) for table in COLUMNS)
    with Watch(spark, "build", size, say):
        graph_from_dumps(spark, dumps, settings.language, compressed=False, plain_pagelinks=settings.plain_pagelinks).save(graph)


def main(words: list[str]) -> int:
    commands = {"build": 2, "path": 3, "stats": 1}
    if not words or len(words) - 1 != commands.get(words[0]):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("linkweave").getOrCreate()
    if words[0] == "build":
        build(spark, Settings.of(os.environ), *words[1:])
    else:
        graph = LinkGraph.load(spark, words[1])
        row = path_response(graph, int(words[2]), int(words[3])).first().response if words[0] == "path" else graph.stats().toJSON().first()
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
