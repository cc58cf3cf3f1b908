"""Relational steps from dump tables to a link graph, and the graph's own operators."""

from .graph import LinkGraph
from .paths import all_shortest_paths, expand, frontier_links, meet
from .resolve import edges, keep_last, linktarget_rows, page_rows, redirect_rows, resolved_links, vertices

__all__ = ["LinkGraph", "all_shortest_paths", "edges", "expand", "frontier_links", "keep_last", "linktarget_rows", "meet", "page_rows", "redirect_rows", "resolved_links", "vertices"]
