import subprocess
import sys
import zlib

import numpy as np
import pytest

from linkweave.llm.range_coder import decode, encode
from linkweave.llm.token_files import read, write
from linkweave.llm.tokens import CHUNKS, Encoder, vocabulary


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 40_000, 131_071])
def test_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50257, n), r.zipf(1.3, n) % 50257, np.full(n, 65535), np.tile(np.arange(7), n // 7 + 1)[:n]):
        ids = ids.astype(np.uint16)
        assert np.array_equal(decode(encode(ids)), ids)


@pytest.mark.parametrize("lanes", [3, 50])
def test_blocks_stand_alone(monkeypatch, lanes):
    """Any cut into blocks and lanes gives the ids back, and a block doesn't depend on those before it."""
    from linkweave.llm import range_coder

    monkeypatch.setattr(range_coder, "LANES", lanes)
    ids = (np.random.default_rng(5).zipf(1.2, 10_007) % 300).astype(np.uint16)
    for block in (1, 1000, 1001, 20_000):
        some = ids[: 40 if block == 1 else len(ids)]
        assert np.array_equal(decode(encode(some, block)), some)
    other = ids.copy()
    other[:1000] = 9
    assert encode(ids, 1000)[-200:] == encode(other, 1000)[-200:]


def test_models_adapt(monkeypatch):
    """Ids that only the two before tell, and ids of a narrow range, take little room."""
    monkeypatch.setattr("linkweave.llm.range_coder.LANES", 4)
    r = np.random.default_rng(8)
    one, ids = r.integers(0, 40, (40, 40)), [1, 2]
    for _ in range(40_000):
        ids.append(int(one[ids[-2], ids[-1]]) if r.random() < 0.95 else int(r.integers(0, 40)))
    assert len(encode(np.array(ids, np.uint16))) * 8 < 1.3 * len(ids)
    narrow = r.integers(30_000, 30_016, 40_000).astype(np.uint16)
    assert len(encode(narrow)) * 8 < 4.6 * len(narrow)


def test_what_repeats_gets_short():
    ids = np.random.default_rng(0).integers(0, 50257, 60).astype(np.uint16)
    assert len(encode(np.tile(ids, 400))) < 60 * 400 * 2 / 6


def test_damage_is_noticed():
    coded = bytearray(encode(np.arange(3000).astype(np.uint16)))
    coded[-100] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        decode(bytes(coded))


@pytest.mark.parametrize("name", list(CHUNKS))
def test_chunks_give_the_tokenizers_ids(name, texts, monkeypatch):
    hard = ["a  b \n\n c\t\td  ", "  x", "x  ", "\x1c\x1d y\x85z\xa0\xa0w", "it's we'll 'S I'M don't'", "é́ É 　日本 語 a​b", "foo<|endoftext|>bar <|endoftext|> x", "", " ", "İstanbul ΑΣ ΣΑΣ ﬁ ①²", " ́x", "a\r\n\r\nb", "x,y.z_w%%% (q)—r—,s ‘t’ 12ab34 a1,b2", "word́, word,́"]
    e = Encoder(name)
    for remembered in (600_000, 40):
        monkeypatch.setattr(Encoder, "REMEMBERED", remembered)
        monkeypatch.setattr(Encoder, "AT_ONCE", 3000)
        for some in (hard, [t or "" for _, t in texts], hard):
            ids, sizes = e.encode(some)
            ends = np.cumsum(sizes)
            assert [ids[b - a : b].tolist() for a, b in zip(sizes, ends)] == [x.ids for x in e.tokenizer.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("name", list(CHUNKS))
def test_cuts_on_bytes_equal_the_patterns(name):
    r, e = np.random.default_rng(4), Encoder(name)
    signs = list("ab Z  \n\t.,'-1%_") + ["é", "×", "÷", "ß", "\xa0", "\x85", "\u2003", "\u2014", "\u3000", "語", "😀", "\x1c", "longerword", "averyverylongwordindeed"]
    texts = ["".join(r.choice(signs, r.integers(0, 40))) for _ in range(1500)]
    raw = [t.encode().lower() if e.lower else t.encode() for t in texts]
    joined = b"\xff".join([*raw, b""])
    ends = np.cumsum([len(x) + 1 for x in raw]) - 1
    start, end = e._starts(np.frombuffer(joined, np.uint8), raw, ends)
    assert [joined[a:b].decode() for a, b in zip(start, end)] == [c for x in raw for c in e.find(x.decode())]


@pytest.mark.parametrize("most", [1 << 20, 700])
def test_files_hold_all_documents_in_order(spark, docs, texts, most):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = read(write(docs, most=most), with_ids=True).orderBy("start").collect()
    names = [r.doc_id for r in rows]
    assert names == sorted(names, key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted(want, key=str)


def test_empty(none):
    assert read(write(none)).collect() == []


def test_what_an_encoder_remembers_is_bounded(monkeypatch):
    """Long chunks count by their bytes, and all by their ids; what is forgotten is encoded again, alike."""
    for name, most in (("LONG", 40_000), ("POOL", 20_000), ("AT_ONCE", 3000)):
        monkeypatch.setattr(Encoder, name, most, raising=False)
    r, e = np.random.default_rng(3), Encoder("byte_bpe_50k.json")
    words = ["".join(r.choice(list("abcdxyz019"), n)) for n in r.integers(17, 120, 3000).tolist()]
    texts = [" ".join(words[k : k + 20]) for k in range(0, 3000, 10)]
    for _ in range(2):
        ids, sizes = e.encode(texts)
        assert sum(map(len, e.long)) <= 40_000 and e.used <= 20_000
        ends = np.cumsum(sizes)
        assert [ids[b - a : b].tolist() for a, b in zip(sizes, ends)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_batches_are_bounded_by_bytes(spark):
    """However long the documents, a worker gets few bytes at once; the session's setting stays as it was."""
    import pandas as pd

    from linkweave.llm.common import stage

    def sizes(parts):
        for p in parts:
            yield pd.DataFrame({"n": [int(p["text"].str.len().sum())]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 1000, 1, 1).selectExpr("repeat('x', 1000) AS text").mapInPandas(sizes, "n int")
    got = [r.n for r in stage(rows, "sizes", batch=100_000).collect()]
    assert sum(got) == 1_000_000 and max(got) <= 200_000
    assert spark.conf.get(key) == before


def test_segments_hold_a_bounded_number_of_documents(docs, monkeypatch):
    """Documents of one id each don't fill a segment by their ids."""
    monkeypatch.setattr("linkweave.llm.token_files.SEGMENT_DOCS", 3, raising=False)
    segments = [len(s.docs) // 17 for s in write(docs.coalesce(1)).select("docs").collect()]
    assert sum(segments) == docs.count() and max(segments) <= 3


TASK = """
import re, sys
import numpy as np, pandas as pd
from linkweave.llm import token_files
class Context:
    get = partitionId = lambda *_: 0
Context.get = lambda *_: Context()
token_files.TaskContext = Context
def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
r = np.random.default_rng(1)
words = np.array(["".join(r.choice(list("abcdefghij"), 6)) for _ in range(20_000)])
run = token_files._write("byte_bpe_50k.json", None, token_files.SEGMENT_IDS)
token_files.encoder("byte_bpe_50k.json")
before = held()
def parts():
    for _ in range(8):
        yield pd.DataFrame({"doc_id": range(1000), "text": [" ".join(r.choice(words, 500)) for _ in range(1000)]})
for out in run(parts()):
    del out
print(held() - before)
"""


def test_a_writing_task_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, timeout=120)
    assert float(out.stdout.split()[-1]) < 15, out.stderr
