import math
import re
import zlib
from collections import Counter

import pytest

from linkweave.llm.lm_scoring import op4_lm_scoring, score

W = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(texts):
    docs = [(i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, [*W.findall(lower(t or "")), END]) for i, t in texts]
    one, two = Counter(), Counter()
    for _, held, w in docs:
        if not held:
            one.update(w)
            two.update(zip([END, *w], w))
    n, v = sum(one.values()), len(one)
    n1, n2 = sum(c == 1 for c in two.values()), sum(c == 2 for c in two.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    kinds = Counter(h for h, _ in two)
    out = []
    for i, held, w in docs:
        p = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        q = [max(two[h, x] - d, 0) / one[h] + d * kinds[h] / one[h] * b if one[h] else b for h, x, b in zip([END, *w], w, p)]
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(map(math.log10, q))))
    return out


@pytest.mark.parametrize("size", [600, 1 << 24])
def test_equals_brute_force(docs, texts, size):
    got = sorted(map(tuple, score(docs, block_bytes=size).collect()), key=str)
    want = sorted(brute(texts), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2]))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def brute_three(texts):
    docs = [(i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, [END, *W.findall(lower(t or "")), END]) for i, t in texts]
    grams = [Counter(tuple(w[k - n + 1 : k + 1]) for _, held, w in docs if not held for k in range(max(1, n - 1), len(w))) for n in (1, 2, 3)]
    discount = [0.0]
    for g in grams[1:]:
        n1, n2 = sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())
        discount.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
    seen, kinds = Counter(), Counter()
    for g in grams[1:]:
        for h, c in g.items():
            seen[h[:-1]] += c
            kinds[h[:-1]] += 1
    n, v = sum(grams[0].values()), len(grams[0])

    def p(h, x):
        if not h:
            return (grams[0][x,] + 0.1) / (n + 0.1 * (v + 1))
        less, d = p(h[1:], x), discount[len(h)]
        return less if not seen[h] else max(grams[len(h)][*h, x] - d, 0) / seen[h] + d * kinds[h] / seen[h] * less

    return [(i, len(w) - 1, sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))) for i, _, w in docs]


@pytest.mark.parametrize("size", [600, 1 << 24])
def test_third_order_equals_brute_force(spark, docs, texts, size, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (score(docs, block_bytes=size, order=3), op4_lm_scoring(spark, str(tmp_path))):
        got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], r[2])) for x in ([(r.doc_id, r.n_tokens, r.score) for r in rows.collect()], brute_three(texts)))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_empty(none):
    assert score(none).collect() == []
