"""Best-fit packing by bin completion.

Documents (ids by the tokenizer, then an end id) are packed into sequences of at most CAPACITY ids; only longer ones are
cut, into pieces of CAPACITY. What is to be solved is the number of pieces of each length below CAPACITY: at most
CAPACITY - 1 numbers, however many documents there are.

Bin completion: take the largest length that is left, enumerate the undominated fillings of the room beside it, of any
number of pieces (a filling is dominated if a piece left over can take the place of smaller ones in it, or of none),
least waste first, and use the filling for as many sequences as the numbers allow, then for fewer. Branches are pruned
when the waste so far leaves no room to beat the incumbent; the first incumbent is best-fit decreasing, and a solution
as small as the lower bound ends the search. It is exact when it ends by itself; NODES stops it before that.

A piece's place is looked up by its rank among the pieces of its length, which is a sum of per-task counts.

Edge cases: null and empty texts are one end id. Repeated rows are each packed; a null doc_id is kept as it is; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import doc_rows, stage
from .tokens import encoder, with_end

CAPACITY, VOCABULARY, END = 2048, "word_bpe_49k.json", 0
#: Nodes of the search: fillings that are looked at, dominated or not.
NODES = 6000

Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on numbers of pieces; sequences of equal room are filled together."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            fits = [r for r in room if r >= size]
            if not fits:
                n = capacity // size
                whole, rest = divmod(left, n)
                for k, times in ((n, whole), (rest, 1)):
                    if k and times:
                        spare = room.setdefault(capacity - k * size, {})
                        spare[(size,) * k] = spare.get((size,) * k, 0) + times
                break
            r = min(fits)
            held, times = room[r].popitem()
            used = min(left, times)
            if times > used:
                room[r][held] = times - used
            if not room[r]:
                del room[r]
            new = room.setdefault(r - size, {})
            new[(*held, size)] = new.get((*held, size), 0) + used
            left -= used
    return [(p, n) for spare in room.values() for p, n in spare.items()]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without: by ids, by pieces too large to share one with a large piece, and by
    pieces of which at most k fit into one (a piece of more than m parts of k + 1 counts as m of k)."""
    sizes = np.arange(len(counts))
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 33):
        # In units of one in k * (k + 1): a length that is m parts of k + 1 exactly keeps its share.
        parts, over = np.divmod(sizes * (k + 1), capacity)
        best = max(best, -(-int((np.where(over, parts * (k + 1), parts * k) * counts).sum()) // (k * (k + 1))))
    for k in range(1, capacity // 2 + 1):
        large, mid, low = counts[capacity - k + 1 :].sum(), (sizes * counts)[k : capacity - k + 1], counts[capacity // 2 + 1 : capacity - k + 1]
        free = int(low.sum()) * capacity - int((sizes[capacity // 2 + 1 : capacity - k + 1] * low).sum())
        small = int(mid[: capacity // 2 - k + 1].sum())
        best = max(best, int(large) + int(low.sum()) + max(0, -(-(small - free) // capacity)))
    return best


def _sums(pieces: list[tuple[int, int]], room: int) -> list[int]:
    """Bit r of entry i: the first i of the (length, number) pairs hold pieces that sum to r."""
    full = (1 << (room + 1)) - 1
    out = [1]
    for size, many in pieces:
        sums, many, step = out[-1], min(many, room // size), 1
        while many and sums != full:  # 1, 2, 4, ... pieces at once
            step = min(step, many)
            sums |= (sums << (step * size)) & full
            many -= step
            step *= 2
        out.append(out[-1] if sums == out[-1] else sums)
    return out


def _exactly(total: int, n: int, pieces: list[tuple[int, int]], sums: list[int]) -> Iterator[tuple[int, ...]]:
    """All ways to sum to the total by the first n pairs, larger pieces first; sums leads into no dead end."""
    if not total:
        yield ()
        return
    for i in range(n - 1, -1, -1):
        size, many = pieces[i]
        for k in range(min(many, total // size), 0, -1):
            rest = total - k * size
            if sums[i] >> rest & 1:
                for more in _exactly(rest, i, pieces, sums):
                    yield (size,) * k + more
        if not sums[i] >> total & 1:
            return


def _dominated(filling: tuple[int, ...], waste: int, unused: int) -> bool:
    """Whether a piece that is left over (bits of unused) can take the place of smaller ones, or of none."""
    one, more = 0, 0
    for size in filling:
        one, more = one | 1 << size, more | (one | more) << size
    if more & unused:  # a single piece in place of several that are as long
        return True
    larger, reach, left = (1 | one | more) << 1, 1, waste
    while reach < left:
        step = min(reach, left - reach)
        larger, reach = larger | larger << step, reach + step
    return bool(left and larger & unused)


def fillings(counts: np.ndarray, room: int, slack: int | None = None) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of the room by what is left that waste at most slack, least waste first; None stands for
    each dominated one that was looked at."""
    have = np.flatnonzero(counts[: room + 1]).tolist()
    pieces = [(x, int(counts[x])) for x in have]
    sums, small, n = _sums(pieces, room), 0, 0
    for waste in range(0, room - (have[0] if have else 0) + 1 if have else room + 1):
        if slack is not None and waste > slack:
            return
        # Pieces that fit into the waste are all in the filling, or another one holds it and more.
        grown = n
        while n < len(pieces) and pieces[n][0] <= waste:
            small += pieces[n][0] * pieces[n][1]
            n += 1
        total = room - waste - small
        if total < 0:
            return
        if n > grown:
            sums = _sums(pieces[n:], room)
        if not sums[-1] >> total & 1:
            continue
        base = tuple(x for x, many in reversed(pieces[:n]) for _ in range(many))
        for part in _exactly(total, len(pieces) - n, pieces[n:], sums):
            filling, unused = part + base, 0
            for x, many in pieces[n:]:
                if many > part.count(x):
                    unused |= 1 << x
            yield None if _dominated(filling, waste, unused) else filling


def solve(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns (lengths, largest first) and how many sequences use each; counts[n]: pieces of n ids, n up to capacity."""
    counts = np.asarray(counts, np.int64)
    total = int((np.arange(len(counts)) * counts).sum())
    best = best_fit(counts, capacity)
    used, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    # A frame: what is left, waste and sequences so far, the patterns to try with their times, those tried that may be
    # used fewer times, patterns that a frame before has settled.
    frames: list[tuple[np.ndarray, int, int, Iterator[Pattern | None], frozenset]] = []
    path: list[Pattern] = []

    def tries(left: np.ndarray, waste: int, settled: frozenset) -> Iterator[Pattern | None]:
        size = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[size] -= 1
        again: list[Pattern] = []
        for f in fillings(rest, capacity - size, (used - 1) * capacity - total - waste):
            if f is None or (pattern := (size, *f)) in settled:
                yield None
                continue
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            again.append((pattern, times))
            yield pattern, times
        for pattern, most in again:
            for times in range(most - 1, 0, -1):
                yield pattern, times

    def open_frame(left: np.ndarray, waste: int, done: int, settled: frozenset) -> None:
        frames.append((left, waste, done, tries(left, waste, settled), settled))

    if used > bound and total:
        open_frame(counts, 0, 0, frozenset())
    while frames and nodes and used > bound:
        nodes -= 1
        left, waste, done, some, settled = frames[-1]
        del path[len(frames) - 1 :]
        pattern, times = next(some, ((), 0)) or (None, 0)
        if not pattern:
            if pattern is not None:
                frames.pop()
            continue
        spent = waste + times * (capacity - sum(pattern))
        # One sequence fewer than the incumbent leaves this much room for waste.
        if spent > (used - 1) * capacity - total:
            continue
        path.append((pattern, times))
        rest = left - times * np.bincount(pattern, minlength=len(left))
        if rest.any():
            # While its largest piece is the largest left, more of the pattern is what more times of it have tried.
            open_frame(rest, spent, done + times, settled | {pattern} if rest[pattern[0]] else frozenset())
        else:
            best, used = list(path), done + times
    return best


class Plan:
    """Where the r-th piece of each length goes."""

    def __init__(self, patterns: list[Pattern]):
        self.runs: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for pattern, times in patterns:
            spots: dict[int, list[int]] = {}
            at = 0
            for size in pattern:
                spots.setdefault(size, []).append(at)
                at += size
            for size, offsets in spots.items():
                self.runs.setdefault(size, []).append((ranks.get(size, 0), base, tuple(offsets)))
                ranks[size] = ranks.get(size, 0) + times * len(offsets)
            base += times
        self.sequences = base

    def place(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = self.runs[size]
        at = np.searchsorted([r[0] for r in runs], ranks, "right") - 1
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for k in np.unique(at).tolist():
            first, base, offsets = runs[k]
            mine = at == k
            n = ranks[mine] - first
            sequence[mine] = base + n // len(offsets)
            offset[mine] = np.array(offsets)[n % len(offsets)]
        return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their task and their rank among its pieces of that length; ids where asked for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part_id = encoder(vocabulary, path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in parts:
            texts = part["text"].tolist()
            for lo in range(0, len(texts), 512):
                ids, sizes = with_end(*encode(texts[lo : lo + 512]), END)
                cuts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                length = np.minimum(sizes[doc] - piece * capacity, capacity)
                ends = np.cumsum(length)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.flatnonzero(np.diff(ordered, prepend=0))
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                out = pd.DataFrame({"doc_id": part["doc_id"].iloc[lo : lo + 512].to_numpy(dtype=object)[doc], "piece": piece, "start": piece * capacity, "length": length, "ids_crc32": crc, "part": part_id, "rank": rank})
                out["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in out["doc_id"]], "Int64")
                if with_ids:
                    out["ids"] = [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), length.tolist())]
                yield out

    return doc_rows(docs).mapInPandas(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece."""
    cut = stage(pieces(docs, vocabulary, capacity, with_ids, path), "pieces")
    by_task = stage(cut.where(F.col("length") < capacity).groupBy("part", "length").agg(F.count("*").alias("n")), "pieces-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # below capacity rows
        counts[r["length"]] = r["n"]
    plan = Plan(solve(counts, capacity))
    before = by_task.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size, rank = part["length"].to_numpy(), part["rank"].to_numpy() + part["before"].fillna(0).to_numpy(dtype=np.int64)
            sequence, offset = np.empty(len(part), np.int64), np.zeros(len(part), np.int64)
            for n in np.unique(size).tolist():
                mine = size == n
                if n == capacity:  # alone in a sequence: numbered below zero by task and rank
                    sequence[mine] = -1 - ((part["part"].to_numpy(dtype=np.int64)[mine] << 40) | part["rank"].to_numpy()[mine])
                else:
                    sequence[mine], offset[mine] = plan.place(n, rank[mine])
            yield part.assign(sequence_id=sequence, offset=offset)[columns]

    return cut.join(before, ["part", "length"], "left").select("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "before", *(["ids"] if with_ids else [])).mapInPandas(place, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
