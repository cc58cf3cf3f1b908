import random
import re

import numpy as np
import pandas as pd
import xxhash

from linkweave.llm import simhash
from linkweave.llm.simhash import near_duplicates

W = re.compile(r"[^\x20\x09-\x0D]+")


def fp(text):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def components(rows):
    """rows: (id, fingerprint) to the smallest id of each row's component."""
    marks = sorted({f for _, f in rows})
    parent = {f: f for f in marks}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(marks):
        for b in marks[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f, least.get(root(f))) for i, f in rows), key=str)


def test_equals_brute_force(docs, texts):
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == components([(i, fp(t)) for i, t in texts])


def flipped(n, seed):
    r = random.Random(seed)
    out = {0}
    for _ in range(12):
        centre = r.getrandbits(64)
        out.add(centre)
        for _ in range(n):
            x = centre
            for b in r.sample(range(64), r.randint(1, 7)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_every_link_is_found_also_in_split_buckets(spark, monkeypatch):
    for split in (4096, 4):
        monkeypatch.setattr(simhash, "SPLIT", split)
        marks = flipped(40, split)
        frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(marks)], "doc_id long, fp long").selectExpr("*", "doc_id as text_key")
        monkeypatch.setattr(simhash, "fingerprints", lambda _, frame=frame: frame)
        got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(frame).collect()]
        assert sorted(got, key=str) == components(list(enumerate(marks)))


def test_chain_filter_keeps_all_near_pairs():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in r.choice(64, r.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    held = np.zeros(len(a), bool)
    for start in range(simhash.M):
        held[simhash.chained(a ^ b, start)] = True
    assert held.all()


def test_chains_prune_by_each_budget():
    """Against every prefix of the chain, counted bit by bit."""
    r = np.random.default_rng(5)
    x = (r.integers(0, 1 << 63, 3000, dtype=np.uint64) & r.integers(0, 1 << 63, 3000, dtype=np.uint64)) & (r.integers(0, 1 << 63, 3000, dtype=np.uint64) & r.integers(0, 1 << 63, 3000, dtype=np.uint64))
    widths = [simhash.WIDTHS[k] for k in range(simhash.M)]
    for start in range(simhash.M):
        want = []
        for k, v in enumerate(x.tolist()):
            bits, at, segments = f"{v:064b}", 0, []
            for w in widths:
                segments.append(bits[at : at + w].count("1"))
                at += w
            total, ok = 0, True
            for n in range(simhash.M - 1):
                total += segments[(start + n) % simhash.M]
                ok &= total <= (n + 1) * simhash.BITS / simhash.M
            want += [k] * ok
        assert simhash.chained(x, start).tolist() == want


def test_buckets_that_span_batches():
    rows = pd.DataFrame({"key": [1] * 5 + [2] * 5, "fp": [0, 1, 3, 7, 15, 0, 1, 1 << 30, 3 << 30, 9], "own": [True] * 10})
    whole = pd.concat(simhash._bucket_links(iter([rows])))
    parts = pd.concat(simhash._bucket_links(iter([rows[k : k + 2].reset_index(drop=True) for k in range(0, 10, 2)])))
    assert sorted(map(tuple, whole.to_numpy())) == sorted(map(tuple, parts.to_numpy()))


def test_empty(none):
    assert near_duplicates(none).collect() == []


def test_one_of_each_component_stays(spark, docs, texts):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = {}
    for i, f, c in components([(i, fp(t)) for i, t in texts]):
        if i == c:
            want[i] = want.get(i, 0) + 1
    kept = sorted([r.doc_id for r in got.collect()], key=str)
    assert set(kept) == set(want) and 40 not in kept and kept.count(7) == 2 and kept.count(30) == 1


def test_any_columns_come_out_as_they_went_in(spark):
    names = ["doc_id", "text", "_key", "key", "id", "row", "_kept_id", "kept_id", "group", "fp", "component_id", "a.b"]
    rows = [(i, t, *["x"] * 10) for i, t in ((3, "one two three four five"), (3, "one two three four five"), (2, "one two three four five"), (5, ""), (4, None), (6, "quite another text with more words"))]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names[2:])))
    assert got.columns == names
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(2, "one two three four five", "x"), (4, None, "x"), (6, "quite another text with more words", "x")]
    same = simhash.keep_one(spark.createDataFrame([(3, "a b", "x")] * 4, "doc_id long, text string, _key string"))
    assert same.columns == ["doc_id", "text", "_key"] and same.count() == 1
