"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into M segments on a ring. If two fingerprints differ in at most BITS bits, some segment starts a
chain in which the first l segments differ in at most l * BITS / M bits, for every l. With M = 5 and BITS = 4 the first
segment is then equal, and the second differs in one bit at most: both together are the key of a bucket. Of two that
differ in a bit there, the one that has it off looks up the key of the other. In a bucket, candidates are pruned by the
chain from its start, segment after segment, each with its cumulative budget; only those that are left are held against
the full Hamming distance.

Fingerprints are distinct before any of this, so copies cost nothing, and a bucket gives the edges of a spanning forest
of its links, never its pairs. A bucket of more than SPLIT fingerprints is dealt out again by the third segment of the
chain (two bits at most over three segments). Names of components go to fingerprints by joins of staged tables, which
adaptive execution can split where one is hot.

Edge cases: a null text counts as empty, with fingerprint zero, which links like any other; fewer than four words are
one shingle. Repeated rows each get a row. A null doc_id names a component (null) only if none of it has another.
keep_one() so keeps one of all texts without words, and of texts whose fingerprints are that near to zero; whatever
other columns are called, they come out as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, connected, doc_rows, stage

BITS, M, WORDS, SEED, SPLIT = 4, 5, 4, 42, 4096
_FINER = 1 << 62
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(M))


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) < WORDS:
        return np.array([h(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - WORDS + 1].tolist()
    return np.array([h(line[a:e], SEED) for a, e in zip(starts, ends[WORDS - 1 :].tolist())], np.uint64)


def fingerprint(text: str) -> int:
    """Bits that over half of the shingles' hashes set; bytes.lower and bytes.split know ASCII letters and spaces only."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        marks = np.fromiter(map(fingerprint, part["text"]), np.uint64, len(part))
        yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "fp": marks.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp: the fingerprint as a signed long."""
    return doc_rows(docs).withColumn("text_key", F.xxhash64("text")).mapInPandas(_fingerprints, "doc_id long, text_key long, fp long")


def _segment(x: np.ndarray, i: int) -> np.ndarray:
    i %= M
    return (x >> np.uint64(64 - STARTS[i] - WIDTHS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _key(i: int, parts: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(parts[0]), i, np.uint64)
    for p in parts:
        key = (key << np.uint64(13)) | p
    return key


def _keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each start of a chain a row to be found by, and a row to look up for each bit that the second segment has off."""
    for part in parts:
        for k in range(0, len(part), 4096):
            x = part["fp"].to_numpy()[k : k + 4096].view(np.uint64)
            keys, own = [], []
            marks = []
            for i in range(M):
                a, b = _segment(x, i), _segment(x, i + 1)
                for flip in _flips(WIDTHS[(i + 1) % M], 1):
                    off = (b & np.uint64(flip)) == 0
                    keys.append(_key(i, [a[off], b[off] | np.uint64(flip)]))
                    marks.append(x[off])
                    own.append(np.full(len(marks[-1]), flip == 0))
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "fp": np.concatenate(marks).view(np.int64), "own": np.concatenate(own)})


def _finer_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of large buckets with the third segment of the chain in the key: what is left of two bits may differ in it."""
    for part in parts:
        x, key, own = part["fp"].to_numpy().view(np.uint64), part["key"].to_numpy().view(np.uint64), part["own"].to_numpy()
        start = (key >> np.uint64(26)).astype(np.int64)
        for i in range(M):
            for mine in (True, False):
                rows = np.flatnonzero((start == i) & (own == mine))
                if not len(rows):
                    continue
                c = _segment(x[rows], i + 2)
                spent = np.bitwise_count((key[rows] & np.uint64((1 << 13) - 1)) ^ _segment(x[rows], i + 1)).astype(np.int64)
                for flip in _flips(WIDTHS[(i + 2) % M], 2):  # a row to be found by looks others up as well
                    some = rows[spent + flip.bit_count() <= 2]
                    wide = (key[some] << np.uint64(13)) | (_segment(x[some], i + 2) ^ np.uint64(flip)) | np.uint64(_FINER)
                    yield pd.DataFrame({"key": wide.view(np.int64), "fp": x[some].view(np.int64), "own": np.full(len(some), mine and flip == 0)})


def chained(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences keep within the budget of every chain of segments from the start but the whole; one is pruned
    at the first segment that is beyond it."""
    left, total = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n in range(M - 1):
        total = total + np.bitwise_count(_segment(x[left], start + n))
        keep = total <= (n + 1) * BITS // M
        left, total = left[keep], total[keep]
    return left


def forest(x: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints whose chain holds from the start: a search
    that looks at unreached ones only."""
    left, edges = np.arange(len(x)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            change = x[left] ^ x[at]
            near = chained(change, start)
            near = near[np.bitwise_count(change[near]) <= BITS]
            if len(near):
                got = left[near]
                edges += [(at, int(g)) for g in got]
                queue += got.tolist()
                left = np.delete(left, near)
    return edges


def _start(key: int) -> int:
    """The segment that a bucket's chain begins with."""
    key &= (1 << 64) - 1
    return (key ^ _FINER) >> 39 if key & _FINER else key >> 26


def _bucket_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in the order of their keys; the last bucket of a batch waits for the next batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(key, fp, own) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        at = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(np.append(at, len(key)))
        for a, n in zip(at[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            if own[a : a + n].any():
                x = np.unique(fp[a : a + n].view(np.uint64))
                edges += [(int(x[i]), int(x[j])) for i, j in forest(x, _start(int(key[a])))]
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    for part in parts:
        held.append((part["key"].to_numpy(), part["fp"].to_numpy(), part["own"].to_numpy()))
        if held[-1][0][0] == held[-1][0][-1] and len(held) > 1 and held[-1][0][0] == held[0][0][-1]:
            continue
        key, fp, own = (np.concatenate(c) for c in zip(*held))
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield links(key[:cut], fp[:cut], own[:cut])
        held = [(key[cut:], fp[cut:], own[cut:])]
    if held:
        yield links(*(np.concatenate(c) for c in zip(*held)))


def _links_in(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_bucket_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, component_id and group (a number of the component, never null) for every row of docs."""
    marks = stage(fingerprints(docs), "simhash")
    distinct = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    n = distinct.count()
    # A fingerprint gives 38 rows or so; each meets few others by chance, so parts are sized by rows.
    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, 8 * buckets(n * 38 // 8))
    rows = distinct.select("fp").repartition(parts, "fp").mapInPandas(_keys, "key long, fp long, own boolean")
    large = stage(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("key"), "simhash-large")
    if large.isEmpty():
        links = _links_in(rows, parts)
    else:
        rest = _links_in(rows.join(large, "key", "left_anti"), parts)
        finer = rows.join(large, "key", "left_semi").mapInPandas(_finer_keys, "key long, fp long, own boolean")
        links = rest.unionByName(_links_in(finer, parts))
    component = connected(stage(links.distinct(), "simhash-links"))
    member = component.select(F.col("node").alias("fp"), F.col("component").alias("group"))
    member = member.unionByName(component.select(F.col("component").alias("fp"), F.col("component").alias("group")).distinct())
    linked = stage(member.join(distinct, "fp"), "simhash-linked")
    named = stage(linked.groupBy("group").agg(F.min("rep").alias("component_id")), "simhash-named")
    linked = linked.join(named, "group").select("fp", "group", "component_id")
    own = F.when(F.col("group").isNull(), F.col("rep")).otherwise(F.col("component_id"))
    every = stage(distinct.join(linked, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), own.alias("component_id")), "simhash-named-fp")
    return marks.join(every, "fp").select("doc_id", "text_key", "fp", "component_id", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (null last), and of those the text's hash."""
    found = stage(near_duplicates(docs), "simhash-components")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    kept = found.groupBy("group").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    if not found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates(["id", "key"])
    return out.select("row.*")


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
