"""Helpers shared by the training-data operators: the shared folder, staged tables, packed blocks of documents."""

from __future__ import annotations

import atexit
import ctypes
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whether a query's shuffles are deleted as it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch of rows that goes to Python, about.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_dir: str | None = None
_staged: list[tuple[SparkSession, str, str | None]] = []


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where that is unset and all runs on one machine."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="linkweave-")
    return _local_dir


@atexit.register
def _drop_staged() -> None:
    while _staged:
        spark, path, table = _staged.pop()
        try:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            _delete(spark, path)
        except Exception:  # the session has ended: the folder goes with it
            continue


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, compression: str = "zstd", free: bool = False, batch: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors lose nothing.

    The table goes when the driver ends, since results that are still lazy read it. free: the shuffles that made it go
    once it is written. batch: bytes of the batches that Python gets meanwhile, about; Spark's own setting where None.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    meanwhile = ({_FREE: "true"} if free else {}) | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k) for k in meanwhile}
    for k, v in meanwhile.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _staged.append((spark, path, None))
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """stage(), but as a table of n buckets by a column: what meets it by that column is shuffled, the table isn't."""
    spark, table = df.sparkSession, f"linkweave_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    _staged.append((spark, path, table))
    df.write.option("compression", "none").bucketBy(n, column).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_staged(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def give_back() -> None:
    """Returns what this worker has freed to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


#: UTF-8 bytes of text in a block, but for a block that holds a single longer document.
BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "blk long, docs long, words long, payload binary"


def pack(ids: list, texts: list[bytes]) -> bytes:
    head = np.array([len(ids)] + [len(t) for t in texts], dtype="<i8").tobytes()
    known = np.array([i is not None for i in ids], dtype=np.uint8).tobytes()
    values = np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + known + values + b"".join(texts))


def unpack(payload: bytes) -> tuple[list, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = struct.unpack_from("<q", raw)[0]
    sizes = np.frombuffer(raw, "<i8", n, 8)
    known = np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
    values = np.frombuffer(raw, "<i8", n, 8 + 9 * n).tolist()
    at = 8 + 17 * n
    ends = (at + np.cumsum(sizes)).tolist()
    return [v if k else None for v, k in zip(values, known)], [raw[e - s : e] for s, e in zip(sizes.tolist(), ends)]


def _to_blocks(size: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, seq, held = TaskContext.get().partitionId() << 32, 0, 0
        ids: list = []
        texts: list[bytes] = []

        def block() -> pd.DataFrame:
            return pd.DataFrame({"blk": [base + seq], "docs": [len(ids)], "words": [sum(len(t.split()) for t in texts)], "payload": [pack(ids, texts)]})

        for part in parts:
            for i, t in zip(part["doc_id"], part["text"]):
                raw = t.encode()
                if ids and held + len(raw) > size:
                    yield block()
                    ids, texts, held, seq = [], [], 0, seq + 1
                ids.append(None if pd.isna(i) else int(i))
                texts.append(raw)
                held += len(raw)
        if ids:
            yield block()

    return run


def doc_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text only; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def to_blocks(docs: DataFrame, name: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Stages the documents as rows of compressed blocks: each is a unit of work of bounded size, whatever keys it holds."""
    return stage(doc_rows(docs).mapInPandas(_to_blocks(size), BLOCK_SCHEMA), name, "none")


# --- 64-bit keys of word runs ---------------------------------------------------------------------------------------

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of two keys, in order."""
    b = b * _B
    x = (a * _A) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


# --- counts of keys over all blocks ---------------------------------------------------------------------------------

#: Keys that one task of an exchange holds at once, about.
BUCKET_KEYS = 1 << 20


def encode_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as differences of the fewest whole bytes that hold them all."""
    steps = np.diff(keys, prepend=keys[:1] * 0)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(keys) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def decode_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(body), 8), np.uint8)
    full[:, :width] = body
    return np.cumsum(full.view("<u8")[:, 0], dtype=np.uint64)


def encode_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def decode_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)


def buckets(keys: int) -> int:
    """A power of two: the parts that so many keys go to."""
    return 1 << max(0, (max(1, keys) // BUCKET_KEYS).bit_length())


def split_keys(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """The parts, by their leading bits, that ascending keys fall in."""
    if parts == 1:
        return [(0, slice(0, len(keys)))] if len(keys) else []
    lead = (keys >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64)
    at = np.flatnonzero(np.diff(lead, prepend=-1))
    ends = np.append(at[1:], len(keys))
    return [(int(lead[a]), slice(int(a), int(e))) for a, e in zip(at, ends)]


def connected(edges: DataFrame) -> DataFrame:
    """edges(u, v long) to (node, component): component is the smallest node that it reaches.

    Large-star and small-star steps alternate until nothing changes. Each step is joins and aggregates by node between
    staged tables, so lineage is cut, and the join with a node of many edges can be split.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def kept(e: DataFrame) -> DataFrame:
        return stage(e.where("u <> v").distinct(), "stars")

    e = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-least")
        e = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        e = kept(e.join(least, "u").select(F.explode(pairs).alias("e")).select("e.*"))
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


KEYED_SCHEMA = "blk long, r int, keys binary, counts binary"


def keyed_rows(blk: int, keys: np.ndarray, counts: np.ndarray | None, parts: int) -> pd.DataFrame:
    """Rows of KEYED_SCHEMA for a block's ascending distinct keys."""
    rows = [(blk, r, encode_keys(keys[s]), None if counts is None else encode_counts(counts[s])) for r, s in split_keys(keys, parts)]
    return pd.DataFrame(rows, columns=["blk", "r", "keys", "counts"])


def text_key(raw: bytes) -> int:
    """What xxhash64() gives for the text, as a signed long."""
    key = xxhash.xxh64_intdigest(raw, 42)
    return key - (1 << 64) if key >> 63 else key


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit keys of all words of the texts, one text after another, and how many each text has.

    Words are cut at the six ASCII space characters. The key of up to 16 bytes mixes the first 8, the last 8 and their
    number, all words at once; that of longer words is a hash of their bytes.
    """
    joined = b"\n".join([b"", *texts, b" " * 16])
    buf = np.frombuffer(joined, np.uint8)
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    size = end - start
    eight = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
    last = np.zeros(len(start), np.uint64)
    wide = np.flatnonzero(size > 8)
    last[wide] = eight[end[wide] - 8]
    keys = mix(mix(eight[start] & _LOW_BYTES[np.minimum(size, 8)], last), size.astype(np.uint64))
    for k in np.flatnonzero(size > 16).tolist():
        keys[k] = xxhash.xxh64_intdigest(joined[start[k] : end[k]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return keys, np.diff(np.searchsorted(start, ends), prepend=0)
