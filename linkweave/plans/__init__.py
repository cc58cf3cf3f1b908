"""Whole queries: what a request for all shortest paths answers, and the build from dumps to a graph."""

from .build import graph_from_dumps, graph_from_tables
from .response import path_response, path_summary

__all__ = ["graph_from_dumps", "graph_from_tables", "path_response", "path_summary"]
