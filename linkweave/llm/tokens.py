"""Token ids by the public tokenizers, by chunks: a text's ids are its chunks' ids one after another.

For the vocabularies here a tokenizer never merges across white space (but for one leading space of the byte-level one)
or from a run of letters into a mark, so each distinct chunk is encoded once and looked up from then on. A worker
remembers a bounded number of chunks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

# The characters that the tokenizers' patterns take as white space.
SPACE = r"\t-\r \x85\xa0  -     　"
# Letters, and the ASCII characters that end a run of letters in the patterns (an apostrophe may not).
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
CHUNKS = {
    "byte_bpe_50k.json": rf" ?[{LETTERS}]++(?=[{MARKS}{SPACE}]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+",
    "word_bpe_49k.json": rf"[{LETTERS}]++(?=[{MARKS}{SPACE}]|\Z)|[^{SPACE}]+",
}
#: Vocabularies of lower-case tokens.
LOWER = frozenset(("word_bpe_49k.json",))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Kinds of bytes: white space, letters, marks that end a run of letters, others, the end of a text.
_SPACES, _LETTERS, _MARKS, _OTHERS, _END = range(5)
_STOP = 0xFF  # no byte of UTF-8
_LONG_SPACES = frozenset(c.encode() for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{SPACE}]", c))


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHERS, np.uint8)
    for c in map(chr, range(128)):
        for kind, some in ((_SPACES, SPACE), (_LETTERS, LETTERS), (_MARKS, MARKS)):
            if re.match(f"[{some}]", c):
                out[ord(c)] = kind
    out[_STOP] = _END
    return out


_KINDS = _kinds()
_LEADS = np.isin(np.arange(256), [c[0] for c in _LONG_SPACES])
_MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)


def _after(flags: np.ndarray) -> np.ndarray:
    """Whether the byte before has the flag."""
    return np.concatenate([[False], flags[:-1]])


def _before(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([flags[1:], [False]])


class Encoder:
    """encode(texts): all ids as one array of unsigned 16-bit numbers, and how many each text has.

    Texts are cut on their bytes, many at once. A chunk of at most 16 bytes is known by its first and its last 8 bytes
    and its length, exactly; its number is found in a table of open addresses. Longer chunks are in a dictionary. Chunks
    are forgotten beyond REMEMBERED of them, POOL ids, or LONG bytes of that dictionary (ENTRY for each besides its own), so
    all of it takes some 160 MB at most, besides what AT_ONCE characters bring.
    """

    REMEMBERED, POOL, LONG, ENTRY = 2_000_000, 12_000_000, 16 << 20, 150
    KEPT = 64  # bytes of a chunk that stays when others are forgotten
    AT_ONCE = 2_000_000
    SLOTS = 21

    def __init__(self, name: str, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary(name))
        self.find, self.lower = re.compile(CHUNKS[name]).findall, name in LOWER
        self.tiles = not self.lower  # whether white space belongs to chunks, too
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(1 << self.SLOTS, np.int32)  # a chunk's number and one
        self.keys = np.zeros((3, 1 << 14), np.uint64)
        self.long: dict[bytes, int] = {}
        self.room = 0  # bytes that the dictionary takes, about
        self.known = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.first, self.many, self.seen = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def _thin(self) -> None:
        """Forgets chunks that were seen once since the last time, or all but the most frequent if those are many, and very long ones."""
        stay = self.seen[: self.known] > 1
        stay[[n for c, n in self.long.items() if len(c) > self.KEPT]] = False
        keep = np.flatnonzero(stay)
        keep = keep[np.argsort(-self.seen[keep], kind="stable")[: self.REMEMBERED // 2]]
        long = self.keys[2, keep] == 0
        fits = (np.cumsum(self.many[keep], dtype=np.int64) <= self.POOL // 2) & (~long | (np.cumsum(long) * (self.KEPT + self.ENTRY) <= self.LONG // 2))
        keep = np.sort(keep[fits])
        keys, first, many = self.keys[:, keep], self.first[keep].astype(np.int64), self.many[keep].astype(np.int64)
        ends = np.cumsum(many)
        pool = self.pool[np.repeat(first - ends + many, many) + np.arange(int(many.sum()))]
        place = dict(zip(keep.tolist(), range(len(keep))))
        long = {c: place[n] for c, n in self.long.items() if n in place}
        self._forget()
        self._add(keys, pool, many)
        self.long, self.room = long, sum(map(len, long)) + self.ENTRY * len(long)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) + keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[2] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0x9E3779B97F4A7C15)

    def _add(self, keys: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """Chunks under the next numbers; a length of zero: the chunk is in the dictionary."""
        at, end = self.known, self.known + len(many)
        while end > len(self.first):
            more = len(self.first) // 4
            self.first, self.many, self.seen = (np.concatenate([x, np.zeros(more, np.int32)]) for x in (self.first, self.many, self.seen))
            self.keys = np.concatenate([self.keys, np.zeros((3, more), np.uint64)], axis=1)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool[: len(self.pool) // 4]])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[at:end], self.many[at:end] = self.used + np.cumsum(many) - many, many
        self.keys[:, at:end] = keys
        self.used, self.known = self.used + len(ids), end
        if 2 * end > len(self.slots):  # more than a batch may bring: half of the addresses stay free
            self.slots = np.zeros(2 * len(self.slots), np.int32)
            at = 0
        numbers = at + np.flatnonzero(self.keys[2, at:end])
        spot = (self._slot(self.keys[:, numbers]) >> np.uint64(64 - len(self.slots).bit_length() + 1)).astype(np.int64)
        while len(numbers):
            free = self.slots[spot] == 0
            self.slots[spot[free]] = numbers[free] + 1
            left = self.slots[spot] != numbers + 1
            numbers, spot = numbers[left], (spot[left] + 1) & (len(self.slots) - 1)

    def _known(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The chunks' numbers, -1 where unknown."""
        spot = (hashes >> np.uint64(64 - len(self.slots).bit_length() + 1)).astype(np.int64)
        found = self.slots[spot].astype(np.int64) - 1
        a, b, c = self.keys
        other = (found >= 0) & ((a[found] != keys[0]) | (b[found] != keys[1]) | (c[found] != keys[2]))
        left = np.flatnonzero(other)
        while len(left):
            spot[left] = (spot[left] + 1) & (len(self.slots) - 1)
            got = self.slots[spot[left]].astype(np.int64) - 1
            found[left] = got
            left = left[(got >= 0) & ((a[got] != keys[0, left]) | (b[got] != keys[1, left]) | (c[got] != keys[2, left]))]
        return found

    def _learn(self, chunks: list[str], keys: np.ndarray) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(keys, np.fromiter(chain.from_iterable(ids), np.uint16, int(many.sum())), many)

    def _starts(self, buf: np.ndarray, texts: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start and end; each text is followed by a stop."""
        kind = _KINDS[buf]
        two = np.flatnonzero(buf == 0xC3)  # the letters beyond ASCII, but for two signs among them
        sign = (buf[two + 1] == 0x97) | (buf[two + 1] == 0xB7)
        kind[two] = kind[two + 1] = _LETTERS
        kind[two[sign]] = kind[two[sign] + 1] = _OTHERS
        space, letter, end = kind == _SPACES, kind == _LETTERS, kind == _END
        solid = ~(space | end)
        first = solid & ~_after(solid)
        start = end | first | (space & ~_after(space))
        if self.tiles:
            start |= space & _before(solid)
            start &= ~(first & _after(buf == 0x20))
        # A mark after letters that begin a run of solid bytes.
        marks = np.flatnonzero((kind == _MARKS) & _after(letter))
        runs = np.flatnonzero(letter & ~_after(letter))
        if len(marks):
            start[marks[first[runs[np.searchsorted(runs, marks) - 1]]]] = True
        lead = np.flatnonzero(_LEADS[buf])
        if len(lead):
            odd = [k for k in lead.tolist() if buf[k : k + 2].tobytes() in _LONG_SPACES or buf[k : k + 3].tobytes() in _LONG_SPACES]
            for t in np.unique(np.searchsorted(ends, odd)).tolist() if odd else ():
                self._cut_by_pattern(start, kind, texts[t], int(ends[t]))
        at = np.flatnonzero(start)
        upto = np.append(at[1:], len(buf))
        keep = kind[at] != _END
        if not self.tiles:
            keep &= kind[at] != _SPACES
        return at[keep], upto[keep]

    def _cut_by_pattern(self, start: np.ndarray, kind: np.ndarray, text: bytes, end: int) -> None:
        """The same for a text with longer white space characters, which are rare."""
        at = end - len(text)
        start[at:end] = False
        kind[at:end] = _OTHERS
        for piece in self.pieces(text.decode()):
            start[at] = True
            if piece[1]:
                kind[at] = _SPACES
            at += len(piece[0].encode())

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """All of a text: its chunks, and what lies between them (True)."""
        at = 0
        for chunk in self.find(text):
            k = text.index(chunk, at)
            if k > at:
                yield text[at:k], True
            yield chunk, False
            at = k + len(chunk)
        if at < len(text):
            yield text[at:], True

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode().lower() if self.lower else t.encode() for t in texts]
        joined = b"\xff".join([*raw, b"\0" * 16])
        buf = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        start, end = self._starts(buf[: len(joined) - 16], raw, ends)
        size = end - start
        word = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
        keys = np.empty((3, len(start)), np.uint64)
        keys[0] = word[start] & _MASKS[np.minimum(size, 8)]
        keys[1] = 0
        wide = np.flatnonzero(size > 8)
        keys[1, wide] = word[end[wide] - 8]
        keys[2] = size
        hashes, at = self._slot(keys), np.full(len(start), -1, np.int64)
        short = size <= 16
        at = np.where(short, self._known(keys, hashes), -1)
        left = np.flatnonzero(short & (at < 0))
        while len(left):
            _, one = np.unique(hashes[left], return_index=True)
            one = left[one]
            self._learn([joined[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist())], keys[:, one])
            at[left] = self._known(keys[:, left], hashes[left])
            left = left[at[left] < 0]
        long = np.flatnonzero(~short)
        if len(long):
            chunks = [joined[a:b] for a, b in zip(start[long].tolist(), end[long].tolist())]
            new = [c for c in dict.fromkeys(chunks) if c not in self.long]
            if new:
                self.long.update(zip(new, range(self.known, self.known + len(new))))
                self.room += sum(map(len, new)) + self.ENTRY * len(new)
                self._learn([c.decode() for c in new], np.zeros((3, len(new)), np.uint64))
            at[long] = [self.long[c] for c in chunks]
        many = self.many[at]
        upto = np.cumsum(many, dtype=np.int64)
        ids = self.pool[np.repeat(self.first[at] - upto + many, many) + np.arange(int(many.sum()))]
        counts = np.concatenate([[0], upto])[np.concatenate([[0], np.searchsorted(start, ends)])]
        np.add.at(self.seen, at, np.int32(1))
        if self.known > self.REMEMBERED or self.used > self.POOL or self.room > self.LONG:
            self._thin()
        return ids, np.diff(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, k = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], 0
        while k < len(texts):
            e, chars = k, 0
            while e < len(texts) and (e == k or chars + len(texts[e]) <= self.AT_ONCE):
                chars += len(texts[e])
                e += 1
            for out, x in zip((ids, sizes), self._some(texts[k:e])):
                out.append(x)
            k = e
        return np.concatenate(ids), np.concatenate(sizes)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one id after each text's."""
    full = np.full(len(ids) + len(sizes), end, np.uint16)
    last = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(full), bool)
    inside[last] = False
    full[inside] = ids
    return full, sizes + 1


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(name: str, path: str | None = None) -> Encoder:
    """This worker's encoder: what it remembers serves all its tasks."""
    if (name, path) not in _encoders:
        _encoders[name, path] = Encoder(name, path)
    return _encoders[name, path]
