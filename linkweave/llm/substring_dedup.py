"""Substring deduplication with difference-cover anchors.

A window is WINDOW consecutive words. COVER is a difference cover modulo PERIOD: for any two positions there is a shift
below PERIOD that takes both to cover positions. So if two windows are equal, both hold an equal run of
WINDOW - PERIOD + 1 words at a cover position, at the same shift: only those anchors are hashed and exchanged. Windows
around an anchor that occurs twice are then extended: their whole keys are exchanged, and a window is a repeat if its
key occurs again anywhere.

Work goes by blocks of documents of bounded size. A block sends each distinct key once, however often it holds it, so a
passage that a third of all rows share costs one key a block; answers come back in the order of the block's keys.
Keys are 64-bit hashes of the words; equal keys count as equal windows.

Edge cases: a null text has no words; a text of fewer than WINDOW words keeps all; empty tables give empty results;
repeated rows repeat each other, so both lose their windows; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYED_SCHEMA, buckets, decode_keys, drop_staged, keyed_rows, mix, pack, stage, text_key, to_blocks, unpack, word_keys

WINDOW, PERIOD = 35, 21
COVER = (3, 6, 7, 12, 14)
RESULT = "doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, kept string"


def run_keys(words: np.ndarray, length: int) -> np.ndarray:
    """The key of the run of so many words that starts at each position: keys of powers of two, two of which overlap."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    power, keys = 1, words
    while power * 2 <= length:
        keys = mix(keys[:-power], keys[power:])
        power *= 2
    return mix(keys[: len(words) - length + 1], keys[length - power : length - power + len(words) - length + 1])


class _Block:
    """A block's words, and which positions start a run inside one document."""

    def __init__(self, payload: bytes, window: int, period: int, cover: tuple[int, ...]):
        self.ids, self.texts = unpack(payload)
        self.words, self.sizes = word_keys(self.texts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.window, self.period, self.cover = window, period, cover
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((self.place + self.left >= self.window) & (self.left >= self.window - self.period + 1) & np.isin(self.place % self.period, self.cover))
        return at, run_keys(self.words, self.window - self.period + 1)[at]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows that hold one of these anchors."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        low = np.maximum(repeated - self.period + 1, repeated - self.place[repeated])
        np.add.at(edge, low, 1)
        np.add.at(edge, repeated + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.window))

    def covered(self, windows: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.words) + 1, np.int64)
        edge[windows] += 1
        edge[windows + self.window] -= 1
        return np.cumsum(edge[:-1]) > 0

    def rows(self, gone: np.ndarray | None, docs: list[int], whole: bool) -> list[tuple]:
        out = []
        for d in docs:
            words, n = self.texts[d].split(), int(self.sizes[d])
            keep = None if gone is None else ~gone[self.starts[d] : self.starts[d] + n]
            left = n if keep is None else int(keep.sum())
            kept = b" ".join(words if left == n else [w for w, k in zip(words, keep.tolist()) if k])
            out.append((self.ids[d], text_key(self.texts[d]), n, n - left, hashlib.sha256(kept).hexdigest(), kept.decode() if whole and left < n else None))
        return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True, return_counts=True)


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each block's keys, in order, whether another block has the key too."""
    keys = [decode_keys(k) for k in rows["keys"]]
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    again = flat[order][1:] == flat[order][:-1]
    twice = np.zeros(len(flat), bool)
    twice[order[1:]] |= again
    twice[order[:-1]] |= again
    ends = np.cumsum([len(k) for k in keys])
    pressed = [zstandard.compress(np.packbits(twice[e - len(k) : e]).tobytes(), 1) for k, e in zip(keys, ends)]
    return pd.DataFrame({"blk": rows["blk"], "r": rows["r"], "n": [len(k) for k in keys], "flags": pressed})


def _flags(answers: pd.DataFrame, n: int) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(zstandard.decompress(f), np.uint8))[:k] for k, f in answers.sort_values("r")[["n", "flags"]].itertuples(index=False)]
    return np.concatenate(parts).astype(bool) if n else np.zeros(0, bool)


def _exchange(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("r").applyInPandas(_shared, "blk long, r int, n long, flags binary")


def repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False) -> DataFrame:
    """For every row: doc_id, text_key (of the whole text), n_words, n_removed, kept_sha256, kept (where asked for and changed)."""
    blocks = to_blocks(docs, "substrings")
    words = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = buckets(words * len(cover) // period)

    def anchor_keys(batches):
        for batch in batches:
            for blk, payload in batch[["blk", "payload"]].itertuples(index=False):
                yield keyed_rows(blk, np.unique(_Block(payload, window, period, cover).anchors()[1]), None, parts)

    def extend(left: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for blk, payload in left[["blk", "payload"]].itertuples(index=False):
            block = _Block(payload, window, period, cover)
            at, keys = block.anchors()
            distinct, inverse, counts = _distinct(keys)
            twice = _flags(answers, len(distinct)) | (counts > 1)
            starts = block.candidates(at[twice[inverse]]) if len(at) else at
            owner = np.repeat(np.arange(len(block.ids)), block.sizes)[starts]
            some = np.unique(owner)
            rest = np.setdiff1d(np.arange(len(block.ids)), some).tolist()
            rows += [dict(zip(("doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept"), r), kind=0) for r in block.rows(None, rest, with_text)]
            if len(some):
                mask = np.zeros(len(block.words), bool)
                mask[starts] = True
                mask = mask[np.isin(np.repeat(np.arange(len(block.ids)), block.sizes), some)]
                held = pack([block.ids[d] for d in some], [block.texts[d] for d in some])
                rows.append({"kind": 1, "blk": blk, "keys": zstandard.compress(np.packbits(mask).tobytes(), 1), "payload": held})
                keyed = keyed_rows(blk, np.unique(run_keys(block.words, window)[starts]), None, parts)
                rows += [{"kind": 2, "blk": blk, "r": r, "keys": k} for r, k in zip(keyed["r"], keyed["keys"])]
        out = pd.DataFrame(rows, columns=["kind", "blk", "r", "keys", "payload", "doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept"], dtype=object)
        return out.astype({c: "Int64" for c in ("kind", "blk", "r", "doc_id", "text_key", "n_words", "n_removed")})

    def settle(left: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for payload, starts in left[["payload", "keys"]].itertuples(index=False):
            block = _Block(payload, window, period, cover)
            at = np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(starts), np.uint8))[: len(block.words)])
            distinct, inverse, counts = _distinct(run_keys(block.words, window)[at])
            twice = (_flags(answers, len(distinct)) | (counts > 1))[inverse]
            rows += block.rows(block.covered(at[twice]), range(len(block.ids)), with_text)
        out = pd.DataFrame(rows, columns=["doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept"], dtype=object)
        return out.astype({c: "Int64" for c in ("doc_id", "text_key", "n_words", "n_removed")})

    answers = _exchange(blocks.select("blk", "payload").mapInPandas(anchor_keys, KEYED_SCHEMA))
    middle = blocks.select("blk", "payload").groupBy("blk").cogroup(answers.groupBy("blk")).applyInPandas(extend, f"kind int, blk long, r int, keys binary, payload binary, {RESULT}")
    middle = stage(middle, "substrings-candidates")
    drop_staged(blocks)
    answers = _exchange(middle.where("kind = 2").select("blk", "r", "keys"))
    last = middle.where("kind = 1").select("blk", "keys", "payload").groupBy("blk").cogroup(answers.groupBy("blk")).applyInPandas(settle, RESULT)
    return middle.where("kind = 0").select("doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept").unionByName(last)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated windows taken out of their texts (what is left is joined by one space).

    Every row and column stays, whatever it is called; n_chars, where there is one, follows a text that changes. Null
    texts stay null.
    """
    changed = repeats(docs, with_text=True).where("kept is not null").select(F.col("doc_id").alias("changed_id"), F.col("text_key").alias("changed_key"), "kept").dropDuplicates(["changed_id", "changed_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    joined = rows.join(changed, F.col("id").eqNullSafe(F.col("changed_id")) & (F.col("key") == F.col("changed_key")), "left")
    field = F.col("row").getField
    new = {"text": F.coalesce("kept", field("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNull(), field("n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[new.get(c, field(c)).alias(c) for c in docs.columns])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
