"""A folder that dump files are put into, one after another, as a stream of rows.

The parsing is that of sources.dump, inside the JVM. Rows have _file and _row in place of _pos: a stream has no order of
files, so keep-last rules need the file's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dump_text import quoted_fields
from ..sources.dump import inserts, named_fields


def stream_dump(spark: SparkSession, folder: str, table: str, header: list[str], columns: list[str], files_at_once: int = 16) -> DataFrame:
    """The named columns as text of every file, those that come later too; header: the names in the files' CREATE TABLE."""
    named = named_fields(table, header, columns)
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select("value", F.col("_metadata.file_name").alias("_file"))
    return inserts(lines, table).withColumn("_f", quoted_fields(F.col("_body"))).select(*named, "_file", "_row")


def append_new(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of files that have come since the last call to a Parquet table, each file once."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
