"""Column functions that take apart the INSERT lines of a MySQL dump, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A value is a run of bare characters or of quoted strings; a backslash hides the next character inside of a string.
_STRING = r"'(?:[^'\\]++|\\.)*+'"
TUPLE = rf"(?s)\(((?:[^')]++|{_STRING})*+)\)"
FIELD = rf"(?s),((?:[^',]++|{_STRING})*+)"
PLAIN_TUPLE = r"\(([^()]*)\)"
MOST_UNSIGNED = 4_294_967_295


def unescape(value: Column) -> Column:
    """Drops quotes and, inside of the value, each backslash but not what it hides."""
    return F.regexp_replace(value, r"(?s)\\(.)|'", "$1")


def quoted_fields(tuple_body: Column) -> Column:
    """The fields of a tuple's inside, as text: blanks stay, NULL and 'NULL' look the same, '' leaves nothing."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), tuple_body), F.lit(FIELD), F.lit(1)), unescape)


def unquoted_fields(tuple_body: Column) -> Column:
    """The fields of a tuple that has no strings."""
    return F.split(tuple_body, ",", -1)


def insert_rows(line: Column, quoted: bool = True) -> Column:
    """The insides of an INSERT line's tuples; a truncated last one isn't among them."""
    return F.regexp_extract_all(line, F.lit(TUPLE if quoted else PLAIN_TUPLE), F.lit(1))


def strict_unsigned(text: Column, name: str) -> Column:
    """An unsigned 32-bit number as a long; anything else, blanks included, is an error."""
    good = text.rlike(r"\A\+?0*[0-9]{1,10}\z")
    value = F.when(good, F.regexp_replace(text, r"^\+", "").cast("bigint"))
    return F.when(good & (value <= MOST_UNSIGNED), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} isn't an unsigned 32-bit number: "), F.coalesce(text, F.lit("NULL")))).cast("bigint"))
