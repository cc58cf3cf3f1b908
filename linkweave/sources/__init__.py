"""Readers of dumps and of saved graphs, and the plain functions that name and fetch dump files."""

from .config import Settings
from .dump import dump_path, dump_url, fetch, fetch_plain, gunzip, header_columns, read_dump, read_plain_dump

__all__ = ["Settings", "dump_path", "dump_url", "fetch", "fetch_plain", "gunzip", "header_columns", "read_dump", "read_plain_dump"]
