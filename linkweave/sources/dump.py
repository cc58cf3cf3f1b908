"""MySQL dumps as DataFrames of text columns.

A dump is read by Spark's text source (a .gz file is decoded on the way, as one partition, so its lines are dealt out
again at once; a plain file is split between lines by Spark). Columns are found by the names in the dump's own CREATE
TABLE, and a name that isn't there is an error. Every row has _pos, its place in the file, for keep-last rules. Bytes
that aren't UTF-8 come out as the replacement character and spoil nothing else.
"""

from __future__ import annotations

import gzip
import os
import re
import shutil
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dump_text import insert_rows, quoted_fields, unquoted_fields

# Where dumps are published, and their names.
URL = "https://dumps.wikimedia.org/{language}wiki/latest/{language}wiki-latest-{table}.sql.gz"
TABLES = ("page", "redirect", "linktarget", "pagelinks")


def dump_url(language: str, table: str) -> str:
    return URL.format(language=language, table=table)


def dump_path(folder: str, language: str, table: str, compressed: bool = True) -> str:
    return os.path.join(folder, f"{language}wiki-latest-{table}.sql" + ".gz" * compressed)


def fetch(language: str, table: str, folder: str, opener: Callable = urllib.request.urlopen) -> str:
    """The dump's file in a folder; one that is there is used as it is. A download gets its name when it is complete."""
    path = dump_path(folder, language, table)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        with opener(dump_url(language, table)) as source, open(path + ".part", "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(path + ".part", path)
    return path


def fetch_plain(language: str, table: str, folder: str, opener: Callable = urllib.request.urlopen) -> str:
    """The plain file, decompressed as it comes in: the compressed one is never on disk."""
    path = dump_path(folder, language, table, compressed=False)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        with opener(dump_url(language, table)) as source, gzip.GzipFile(fileobj=source) as plain, open(path + ".part", "wb") as out:
            shutil.copyfileobj(plain, out, 1 << 20)
        os.replace(path + ".part", path)
    return path


def gunzip(path: str) -> str:
    """The plain file beside a .gz file, which Spark can split; one that is there is used as it is."""
    plain = path.removesuffix(".gz")
    if plain != path and not os.path.exists(plain):
        with gzip.open(path) as source, open(plain + ".part", "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(plain + ".part", plain)
    return plain


def _lines(spark: SparkSession, path: str, parts: int | None) -> DataFrame:
    """Lines with their place: the partition of the scan and the row in it, which follow the file's order."""
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    if str(path).endswith(".gz"):
        lines = lines.repartition(parts or spark.sparkContext.defaultParallelism)
    return lines


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first CREATE TABLE: back-quoted names at the start of lines, up to a line that starts with )."""
    names: list[str] = []
    inside = False
    for row in spark.read.text(path).where(~F.col("value").startswith("INSERT ")).toLocalIterator():
        line = row.value
        if not inside:
            inside = line.startswith("CREATE TABLE")
        elif line.startswith(")"):
            break
        elif m := re.match(r"\s*`(.*)`", line):
            names.append(m[1])
    return names


def inserts(lines: DataFrame, table: str, quoted: bool = True) -> DataFrame:
    """A row for each tuple of the table's INSERT lines: _row, its place in the line, _body, its inside, and other columns."""
    values = F.regexp_replace("value", rf"^INSERT INTO `{re.escape(table)}`[^(]*?VALUES\s*", "")
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(F.col("value").startswith(f"INSERT INTO `{table}`")).select(*rest, F.posexplode(insert_rows(values, quoted)).alias("_row", "_body"))


def named_fields(table: str, header: list[str], columns: list[str]) -> list[Column]:
    """The columns asked for out of _f, by the header's names."""
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"{table} has no column {', '.join(missing)}; it has {', '.join(header) or 'none'}")
    return [F.get("_f", F.lit(header.index(c))).alias(c) for c in columns]


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """The named columns as text, in the order asked for, and _pos."""
    named = named_fields(table, header_columns(spark, path), columns)
    rows = inserts(_lines(spark, path, parts), table).withColumn("_f", quoted_fields(F.col("_body")))
    return rows.select(*named, F.struct("_line", "_row").alias("_pos"))


def read_plain_dump(spark: SparkSession, path: str, table: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """The first columns by position, of a dump whose tuples have no strings."""
    rows = inserts(_lines(spark, path, parts), table, False).withColumn("_f", unquoted_fields(F.col("_body")))
    return rows.select(*[F.get("_f", F.lit(k)).alias(c) for k, c in enumerate(columns)], F.struct("_line", "_row").alias("_pos"))
