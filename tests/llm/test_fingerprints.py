import hashlib
import random
import re

from pyspark.sql import functions as F

from linkweave.llm import fingerprints
from linkweave.llm.fingerprints import _PARAGRAPH, fingerprint_rows, peel, sketch, subtract


def cut(text):
    return set(re.findall(_PARAGRAPH, text))


def brute(texts, hashes):
    order = sorted(((-(1 << 63) if i is None else i, hashes[t or ""], t or "", i) for i, t in texts), key=lambda x: x[:2])
    out = []
    for k, (_, _, t, i) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(cut(t), cut(edited)), like(cut(t), cut(after))))
    return sorted(out, key=str)


def test_equals_brute_force(spark, docs, texts, monkeypatch):
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in texts], "t string").select("t", F.xxhash64("t")).collect()}
    for size in (4 << 20, 1500):
        monkeypatch.setattr(fingerprints, "RANGE_BYTES", size)
        got = fingerprint_rows(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == brute(texts, hashes)
    marks = {}
    for r in got:
        marks.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 40)}) == 1 and len({r.fingerprint for r in got if r.doc_id in (0, 1, 2)}) == 3


def test_peeling_recovers_the_difference_or_says_no(spark):
    r = random.Random(4)
    rows = []
    for n in (0, 1, 2, 4, 8, 40):
        for _ in range(5):
            both = [r.getrandbits(62) for _ in range(30)]
            rows.append((both + [r.getrandbits(62) for _ in range(n)], both[:: -1] + [r.getrandbits(62) for _ in range(n // 2)]))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    done = 0
    for x in df.withColumn("r", peel(subtract(sketch(F.col("a"), 16, 1), sketch(F.col("b"), 16, 1)), 16, 1)).collect():
        want = sorted([(k, 1) for k in set(x.a) - set(x.b)] + [(k, -1) for k in set(x.b) - set(x.a)])
        if x.r.done:
            assert sorted(map(tuple, x.r.found)) == want
            done += 1
        else:
            assert len(want) > 3
    assert done >= 20


def test_plan_is_native(spark, docs):
    plan = fingerprint_rows(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_no_rows_and_one_row(spark, none):
    assert fingerprint_rows(none).collect() == []
    (one,) = fingerprint_rows(spark.createDataFrame([(5, "abcd.efgh.")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd.efgab").hexdigest()


def test_an_edit_changes_its_own_sentence_only(spark):
    first = "One short sentence here. Another one follows it. A third is to be read. The last ends the text."
    rows = [(1, first), (2, first.replace("short ", "")), (3, "Nothing of it is in this. Not even a sentence.")]
    got = {r.doc_id: r for r in fingerprint_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next == 3 / 5 and got[2].near_next == 0 and got[1].near_edited >= 0.5


def test_ranges_of_values(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 3, 10, 50):
        borders = sorted(r.sample(range(-100, 100), n))
        got = spark.range(-110, 110).select("id", fingerprints._range_of(F.col("id"), borders).alias("k")).collect()
        assert all(x.k == sum(b <= x.id for b in borders) for x in got)
