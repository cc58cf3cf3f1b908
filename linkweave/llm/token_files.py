"""Token-id output: documents as range-coded ids, in files in the order of doc_id.

A file is a table of segments: each holds whole documents (their ids, their lengths in ids, and their ids as blocks of
the range coder). Segments are numbered in the order of doc_id by shard and place in it, so a shard is written and read
by itself. The table is written and read by Spark, so it can lie wherever Spark reads.

Edge cases: null and empty texts are one end id; null doc_ids come first, equal doc_ids in the order of their texts'
hashes; an empty table gives no segments. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, give_back, stage
from .range_coder import decode, encode
from .tokens import encoder, with_end

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Ids of a segment, but for one that holds a single longer document.
SEGMENT_IDS = 1024 * 8192
#: Documents of a segment at most; bytes of text that a writing task gets at once, but for a longer document.
SEGMENT_DOCS, BATCH_BYTES = 1 << 16, 4 << 20
SEGMENT = "shard int, segment int, before long, ids long, docs binary, blocks binary"


def _segment(shard: int, segment: int, before: int, docs: list, sizes: list[int], ids: np.ndarray) -> pd.DataFrame:
    known = np.array([i is not None for i in docs], np.uint8)
    head = np.array([0 if i is None else i for i in docs], "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + known.tobytes()
    return pd.DataFrame({"shard": [shard], "segment": [segment], "before": [before], "ids": [len(ids)], "docs": [head], "blocks": [encode(ids)]})


def _write(vocabulary: str, path: str | None, most: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, shard, segment, before, held = encoder(vocabulary, path).encode, TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        for part in parts:
            texts, names = part["text"].tolist(), [None if pd.isna(i) else int(i) for i in part["doc_id"]]
            for lo in range(0, len(texts), 2048):
                flat, many = with_end(*code(texts[lo : lo + 2048]), END)
                ends = np.cumsum(many).tolist()
                for name, n, e in zip(names[lo : lo + 2048], many.tolist(), ends):
                    if docs and (held + n > most or len(docs) == SEGMENT_DOCS):
                        yield _segment(shard, segment, before, docs, sizes, np.concatenate(ids))
                        segment, before, held, docs, sizes, ids = segment + 1, before + held, 0, [], [], []
                    docs.append(name)
                    sizes.append(n)
                    ids.append(flat[e - n : e])
                    held += n
                ids = [np.concatenate(ids)] if ids else ids
        if docs:
            yield _segment(shard, segment, before, docs, sizes, np.concatenate(ids))
        ids = []
        give_back()

    return run


def write(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None, most: int = SEGMENT_IDS) -> DataFrame:
    """The segments of all documents, not yet written anywhere."""
    ordered = doc_rows(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInPandas(_write(vocabulary, path, most), SEGMENT)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the segments alone."""
    shards = segments.groupBy("shard").agg(F.sum("ids").alias("n")).orderBy("shard").collect()  # a row a writing task
    base = dict(zip([r["shard"] for r in shards], np.cumsum([0] + [r["n"] for r in shards]).tolist()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, before, head, blocks in part[["shard", "before", "docs", "blocks"]].itertuples(index=False):
                n = len(head) // 17
                names, sizes, known = np.frombuffer(head, "<i8", n), np.frombuffer(head, "<i8", n, 8 * n), np.frombuffer(head, np.uint8, n, 16 * n)
                ids = decode(blocks)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                out = pd.DataFrame({"doc_id": pd.array([v if k else None for v, k in zip(names.tolist(), known.tolist())], "Int64"), "start": base[shard] + before + ends - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]})
                if with_ids:
                    out["ids"] = [ids[e - s : e].tolist() for e, s in zip(ends.tolist(), sizes.tolist())]
                yield out
                del out, ids, raw
                give_back()

    return segments.mapInPandas(run, READ + (", ids array<int>" if with_ids else ""))


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return read(stage(write(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-files", "none", batch=BATCH_BYTES))
