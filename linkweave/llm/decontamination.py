"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared lower-cased, as UTF-8 bytes, with every run of ASCII characters other than letters and digits as one
space. An item of m bytes is found in a document where some stretch of it is within k = min(rate * m, (m - q) / q)
edits. Such a stretch shares at least m - q + 1 - k * q of its q-grams (q = 8) with the item, and their diagonals
(position in the document less position in the item) differ by at most k; so they are counted in bands of 2 (k + 1)
diagonals that overlap by half, one of which holds them all. Bands that reach the bound are verified by an alignment
whose cells stay within the band.

Items of fewer than 2 q bytes, too short for the lemma, are found where they occur without edits and as whole words (next
to letters of scripts without spaces, anywhere).

Before any of that, stretches of the document that hold too few q-grams of any item at all are skipped, by one running
sum. Items are broadcast in blocks of at most ITEM_BYTES bytes, each against all documents.

Edge cases: null and empty texts, and items without letters and digits, are part of no match; of overlapping stretches of a
document that match an item, the one with the fewest edits is reported. A benchmark or documents without rows give no
matches. Repeated rows are each reported; other columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows

Q, RATE = 8, 0.1
#: Bytes of items in a broadcast.
ITEM_BYTES = 4 << 20
FOUND = "doc_id long, text_key long, item_id long, start long, length long, edits int"
#: Letters of scripts that don't put spaces between words: Thai to Tibetan, Burmese, Khmer, Chinese and Japanese.
_NO_SPACES = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Normal:
    """The bytes of a text that are compared, and where they come from."""

    def __init__(self, text: str):
        self.source, self.characters = text, None
        low = text.lower()
        raw = low.encode()
        flat = np.frombuffer(raw.translate(_KEEP), np.uint8)
        space = flat == 32
        keep = ~(space & np.concatenate([[True], space[:-1]])) if len(flat) else space
        self.text, self.places = flat[keep].tobytes(), np.flatnonzero(keep)
        if len(low) != len(text) or len(raw) != len(text.encode()):  # a few letters change their length
            self.characters = np.repeat(np.arange(len(text)), [len(c.lower().encode()) for c in text])

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The start and length, in characters of the source, of what bytes a to b come from."""
        first, last = int(self.places[a]), int(self.places[b - 1])
        if self.characters is not None:
            start = int(self.characters[first])
            return start, int(self.characters[last]) + 1 - start
        raw = self.source.encode()
        start = len(raw[:first].decode(errors="ignore"))
        return start, len(raw[: last + 1].decode(errors="ignore")) - start


def normal(text: str) -> tuple[bytes, np.ndarray]:
    """The bytes that are compared, and their places in the lower-cased text's UTF-8."""
    whole = Normal(text)
    return whole.text, whole.places


def grams(raw: bytes) -> np.ndarray:
    """Each q-gram of the bytes as the number that its 8 bytes are."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


def budget(m: int, rate: float) -> int:
    return min(int(rate * m), (m - Q) // Q)


def bounded(raw: bytes, a: int, b: int) -> bool:
    """Whether raw[a:b] neither begins nor ends inside of a word."""
    inner = raw[a:b].decode(errors="ignore")
    before, after = raw[max(0, a - 4) : a].decode(errors="ignore")[-1:], raw[b : b + 4].decode(errors="ignore")[:1]
    return not any(out and unicodedata.category(out)[0] in "LMN" and not _NO_SPACES.match(out) and not _NO_SPACES.match(edge) for out, edge in ((before, inner[:1]), (after, inner[-1:])))


class Items:
    """Items with an index from q-grams to places in them, and a bitmap that most other q-grams miss."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], rate: float):
        flat_items = [(i, normal(t)[0].strip()) for i, t in items]
        kept = [(i, n) for i, n in flat_items if len(n) >= 2 * Q]
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, n in flat_items:
            if 0 < len(n) < 2 * Q:
                self.short.setdefault(len(n), {}).setdefault(n, []).append(i)
        self.short_keys = {m: np.unique(np.array([int.from_bytes(n[:Q], "little") for n in some], np.uint64)) for m, some in self.short.items()}
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t), rate) for t in self.texts], np.int64)
        self.least = self.sizes - Q + 1 - self.edits * Q
        keys = [grams(t) for t in self.texts]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else item
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self._slot(self.keys)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def hits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the document's q-grams that items have, and the index's entry of each."""
        x = grams(raw)
        at = np.flatnonzero(self.bitmap[self._slot(x)])
        entry = np.minimum(np.searchsorted(self.keys, x[at]), max(0, len(self.keys) - 1))
        same = self.keys[entry] == x[at] if len(at) else np.zeros(0, bool)
        return at[same], entry[same]

    def bands(self, raw: bytes) -> list[tuple[int, int]]:
        """(item, first diagonal) of each band that reaches its item's bound."""
        if not len(self.keys) or len(raw) < Q:
            return []
        at, entry = self.hits(raw)
        low, reach = int(self.least.min()), int((self.sizes + self.edits).max())
        if len(at) < low:
            return []
        # A stretch of the longest item's reach with fewer hits than the smallest bound can't hold a match.
        there = np.searchsorted(at, at + reach) - np.arange(len(at)) >= low
        if not there.any():
            return []
        edge = np.zeros(len(at) + 1, np.int64)
        starts = np.flatnonzero(there)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.searchsorted(at, at[starts] + reach), -1)
        inside = np.cumsum(edge[:-1]) > 0
        at, entry = at[inside], entry[inside]
        found: list[tuple[int, int]] = []
        for k in range(0, len(at), 1 << 16):  # stretches that span two rounds are in both
            e = int(np.searchsorted(at, at[min(k + (1 << 16), len(at)) - 1] + reach, "right"))
            found += self._bands(at[k:e], entry[k:e])
        return sorted(set(found))

    def _bands(self, at: np.ndarray, entry: np.ndarray) -> list[tuple[int, int]]:
        many = self.many[entry]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        spot = np.repeat(self.first[entry], many) + within
        item = self.item[spot]
        diagonal = np.repeat(at, many) - self.place[spot] + self.sizes[item]
        # Each hit is in two bands of two widths, so that any width + 1 diagonals lie in one of them.
        width = self.edits[item] + 1
        band = diagonal // width
        most = int(band.max()) + 2
        cell = item * most + band
        if len(self.sizes) * most <= 8 * len(cell) + (1 << 16):  # else a count of all cells would cost more than it saves
            n = np.bincount(cell, minlength=len(self.sizes) * most + 1)
            n[1:] += n[:-1].copy()
            reached = n[: len(self.sizes) * most].reshape(-1, most) >= self.least[:, None]
            flat = np.append(reached.ravel(), False)
            near = flat[cell] | flat[cell + 1]
            cell, item, spot = cell[near], item[near], spot[near]
            if not len(cell):
                return []
        bands, of = np.unique(np.concatenate([cell, cell + 1]), return_inverse=True)
        # What counts is how many of the item's q-grams occur, not how often.
        span = int(self.sizes.max()) + 1
        distinct = np.unique(of * span + np.tile(self.place[spot], 2)) // span
        n = np.bincount(distinct, minlength=len(bands))
        which, band = bands // most, bands % most
        ok = n >= self.least[which]
        start = (band - 1) * (self.edits[which] + 1) - self.sizes[which]
        return list(zip(which[ok].tolist(), start[ok].tolist()))

    def short_places(self, raw: bytes) -> Iterator[tuple[int, int, int]]:
        """(item_id, start, end) of items too short for the lemma; of places that overlap, an item's first."""
        if not self.short:
            return
        starts = grams(raw + bytes(Q - 1))
        for m, keys in self.short_keys.items():
            x = starts & np.uint64((1 << 8 * m) - 1) if m < Q else starts
            ends: dict[bytes, int] = {}
            for a in np.flatnonzero(np.isin(x, keys)).tolist():
                n = raw[a : a + m]
                if n in self.short[m] and ends.get(n, 0) <= a and bounded(raw, a, a + m):
                    ends[n] = a + m
                    yield from ((i, a, a + m) for i in self.short[m][n])

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, length, edits) in the text's characters; of an item's stretches that overlap, the nearest."""
        whole = Normal(text)
        raw = whole.text
        found: dict[tuple[int, int, int], int] = {}
        for i, diagonal in self.bands(raw):
            k, m = int(self.edits[i]), int(self.sizes[i])
            low = max(0, diagonal - k)
            region = raw[low : diagonal + 3 * (k + 1) + m + k]
            exact = region.find(self.texts[i])
            hit = (exact, exact + m, 0) if exact >= 0 else align(self.texts[i], region, k)
            if hit:
                place = i, low + hit[0], low + hit[1]
                found[place] = min(hit[2], found.get(place, hit[2]))
        out: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for (i, a, b), edits in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            others = taken.setdefault(i, [])
            at = bisect_left(others, (b, 0))
            if at and others[at - 1][1] > a:
                continue
            others.insert(at, (a, b))
            out.append((self.ids[i], *whole.span(a, b), edits))
        for i, a, b in self.short_places(raw):
            out.append((i, *whole.span(a, b), 0))
        return out


def align(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """The stretch of the region nearest to the item, as (start, end, edits), if within k edits; the region is the band."""
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    n, far = len(b), k + 1
    cols = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), cols.copy()
    big = 1 << 32
    for i, c in enumerate(a.tolist(), 1):
        best = np.minimum(cost + 1, far) * big + origin
        step = (cost[:-1] + (b != c)) * big + origin[:-1]
        best[1:] = np.minimum(best[1:], step)
        # Insertions: what runs along the row costs one a column.
        best = np.minimum.accumulate(best - cols * big) + cols * big
        cost, origin = np.minimum(best >> 32, far), best & (big - 1)
        if i % 4 == 0 and cost.min() > k:
            return None
    at = int(np.argmin(cost))
    return (int(origin[at]), at, int(cost[at])) if cost[at] <= k and at > origin[at] else None


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size, streamed through the driver one block at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if held and size + len(row.text) > most:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def _search(held, rate: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Items(held.value, rate)
        for part in parts:
            found = [(d, k, *m) for d, k, t in zip(part["doc_id"], part["text_key"], part["text"]) for m in index.matches(t)]
            yield pd.DataFrame(found, columns=["doc_id", "text_key", "item_id", "start", "length", "edits"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return run


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, text_key, item_id, start, length, edits: one row for each item that a document holds, at each place."""
    out: DataFrame | None = None
    rows = doc_rows(docs).withColumn("text_key", F.xxhash64("text"))
    for items in item_blocks(benchmark):
        one = rows.mapInPandas(_search(docs.sparkSession.sparkContext.broadcast(items), rate), FOUND)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows whose text holds an item; only texts go to Python."""
    for items in item_blocks(benchmark):
        docs = docs.where(_holds_none(docs.sparkSession.sparkContext.broadcast(items), rate)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs


def _holds_none(held, rate: float):
    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(held.value, rate)
        for part in parts:
            yield pd.Series([not index.matches(t) for t in part], dtype=bool)

    return run


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")
