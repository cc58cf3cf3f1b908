import hashlib
import random
import re
from collections import Counter

import pytest

from linkweave.llm.substring_dedup import COVER, PERIOD, repeats

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    split = [W.findall(t or "") for _, t in texts]
    counts = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(texts, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cover_meets_every_pair_of_positions():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER for s in range(PERIOD))


def test_equals_brute_force(docs, texts):
    got = [tuple(r) for r in repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(texts, 35)
    assert sum(x[2] > 0 for x in got) >= 8


@pytest.mark.parametrize("seed", [1, 2])
def test_random_overlaps(spark, seed):
    r = random.Random(seed)
    base = [f"v{r.randrange(3000)}" for _ in range(900)]
    texts = []
    for i in range(40):
        a = r.randrange(800)
        texts.append((i, " ".join([f"x{i}_{k}" for k in range(r.randrange(30))] + base[a : a + r.randrange(20, 70)] + [f"y{i}"])))
    got = [tuple(x) for x in repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(texts, 35)


def test_empty(none):
    assert repeats(none).collect() == []
