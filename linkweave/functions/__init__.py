"""Column functions for dump text and casts."""

from .dump_text import insert_rows, quoted_fields, strict_unsigned, unescape, unquoted_fields

__all__ = ["insert_rows", "quoted_fields", "strict_unsigned", "unescape", "unquoted_fields"]
