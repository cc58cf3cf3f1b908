import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from linkweave.llm.packing import Plan, best_fit, fillings, lower_bound, pack, solve
from linkweave.llm.tokens import vocabulary


def counts_of(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


def fewest(sizes, capacity):
    """By trying all ways to fill the sequence of the largest piece."""
    if not sizes:
        return 0
    sizes = sorted(sizes, reverse=True)
    if sum(sizes) <= capacity:
        return 1
    rest, best = sizes[1:], len(sizes)
    for n in range(len(rest) + 1):
        for c in combinations(range(len(rest)), n):
            if sizes[0] + sum(rest[k] for k in c) <= capacity:
                best = min(best, 1 + fewest([x for k, x in enumerate(rest) if k not in c], capacity))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_as_few_as_brute_force(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 30) for _ in range(r.randint(1, 8))]
    patterns = solve(counts_of(sizes, 32), 32)
    assert sum(n for _, n in patterns) == fewest(sizes, 32)


@pytest.mark.parametrize("seed", range(60))
def test_no_packing_is_below_the_bound(seed):
    r = random.Random(seed)
    sizes = [r.choice((r.randint(1, 30), r.randint(8, 16), r.choice((8, 11, 16)))) for _ in range(r.randint(1, 8))]
    assert lower_bound(counts_of(sizes, 32), 32) <= fewest(sizes, 32)


def test_bound_by_pieces_of_which_two_fit():
    assert lower_bound(counts_of(np.arange(690, 1024), 2048), 2048) == 167


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_near_the_bound(seed):
    r = np.random.default_rng(seed)
    sizes = np.clip(r.lognormal(5.5, 1.2, 3000).astype(int), 1, 2047)
    counts = counts_of(sizes, 2048)
    patterns = solve(counts)
    used = sum(n for _, n in patterns)
    assert sum(np.bincount(p, minlength=2049) * n for p, n in patterns).tolist() == counts.tolist()
    assert lower_bound(counts, 2048) <= used <= sum(n for _, n in best_fit(counts, 2048))
    plan, seen = Plan(patterns), set()
    for size in np.flatnonzero(counts).tolist():
        for s, o in zip(*(x.tolist() for x in plan.place(size, np.arange(counts[size])))):
            assert (s, o) not in seen and 0 <= s < used
            seen.add((s, o))


def test_fillings_of_many_pieces():
    counts = np.zeros(2049, np.int64)
    counts[424], counts[400] = 200, 300
    assert sum(n for _, n in best_fit(counts, 2048)) == 110
    assert solve(counts) == [((424, 424, 400, 400, 400), 100)]


def test_a_filling_fewer_times_than_it_fits():
    sizes = [15, 15, 15, 15, 8, 8, 5, 5, 5, 5, 7, 7, 3, 3, 4, 4]
    for capacity in (21, 23, 26, 30):
        patterns = solve(counts_of(sizes, capacity), capacity, 10**6)
        assert sum(np.bincount(p, minlength=capacity + 1) * n for p, n in patterns).tolist() == counts_of(sizes, capacity).tolist()
        assert sum(n for _, n in patterns) == fewest_by_subsets(sizes, capacity)


def fewest_by_subsets(sizes, capacity):
    """By the fewest sequences, and the most room in the last, for every subset."""
    best = {0: (1, capacity)}
    for mask in range(1, 1 << len(sizes)):
        best[mask] = min((s, -(r - x)) if x <= r else (s + 1, x - capacity) for k, x in enumerate(sizes) if mask >> k & 1 for s, r in [best[mask ^ 1 << k]])
        best[mask] = (best[mask][0], -best[mask][1])
    return best[(1 << len(sizes)) - 1][0]


@pytest.mark.parametrize("seed", range(40))
def test_all_undominated_fillings(seed):
    r = random.Random(seed)
    sizes, room = [r.randint(1, 12) for _ in range(r.randint(0, 9))], r.randint(0, 24)
    some = {tuple(sorted(c, reverse=True)) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room}

    def worse(f):
        left = set((counts_of(sizes, 24) - counts_of(f, 24) if f else counts_of(sizes, 24)).nonzero()[0].tolist())
        return any(sum(c) <= x <= sum(c) + room - sum(f) and c != (x,) for n in range(len(f) + 1) for c in combinations(f, n) for x in left)

    got = [f for f in fillings(counts_of(sizes, 24), room) if f is not None]
    assert len(got) == len(set(got)) and {tuple(sorted(f, reverse=True)) for f in got} == {f for f in some if not worse(f)}
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def check_packing(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_ids_and_places(docs, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            piece = ids[k : k + capacity]
            want.append((i, k // capacity, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), piece))
    rows = pack(docs, capacity=capacity, with_ids=True).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in rows), key=str) == sorted(want, key=str)
    total = sum(len(w[5]) for w in want)
    assert -(-total // capacity) <= check_packing(rows, capacity) <= -(-total // capacity) + (1 if capacity == 2048 else 3)


def test_empty(none):
    assert pack(none).collect() == []
