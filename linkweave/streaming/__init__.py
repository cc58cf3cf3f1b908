"""Dumps that come in as files of a folder, read as a stream."""

from .dumps import append_new, stream_dump

__all__ = ["append_new", "stream_dump"]
