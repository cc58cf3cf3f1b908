import hashlib
import random

import corpus_pipeline
from test_simhash import components, fp
from test_substring_dedup import W, brute


def make(tmp_path, spark):
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice(("an", "er", "th", "in", "on", "re", "ti", "ou")) for _ in range(r.randint(2, 5))) for _ in range(n))
    item = text(35)
    passage = text(60)
    docs = [(i, text(r.randint(40, 200))) for i in range(240)]
    toxic = {i for i in range(0, 120, 4)}
    docs = [(i, f"{t[:50]} idiot {t[50:]} gnarf{r.choice(('le', 'x'))} scum" if i in toxic else t) for i, t in docs]
    docs += [(300, docs[1][1]), (301, docs[1][1] + " tail"), (302, docs[3][1])]
    docs += [(310, text(40) + " " + passage + " " + text(30)), (311, text(50) + " " + passage), (320, text(60) + " " + item + " " + text(20)), (330, None), (331, "")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 240) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return dict(docs), toxic, item, passage


def test_each_stage_takes_effect(spark, tmp_path):
    texts, toxic, item, passage = make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    seen = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append(docs.collect())
    kept = {r.doc_id for r in seen[0]}
    assert kept == set(texts) - toxic
    want = {i for i, _, c in components([(i, fp(texts[i])) for i in kept]) if i == c}
    assert {r.doc_id for r in seen[1]} == want and not {300, 302, 331} & want
    by = {r.doc_id: r for r in seen[2]}
    assert set(by) == want
    for i in (310, 311):
        assert passage[10:-10] not in by[i].text and by[i].n_chars == len(by[i].text) == len(texts[i]) - len(passage) - 1
    for i, _, removed, sha in brute([(i, texts[i]) for i in want], 35):
        assert by[i].text == texts[i] if not removed else hashlib.sha256(by[i].text.encode()).hexdigest() == sha
    assert {r.doc_id for r in seen[3]} == want - {320}
    assert {r.doc_id for r in seen[4]} == want - {320} and sum(r.length for r in seen[4]) >= sum(len(W.findall(r.text or "")) for r in seen[3])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in seen[4])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_other_columns_pass_all_stages(spark, tmp_path):
    """Columns that are called like the operators' own, null and repeated rows, one text that is longer than any table's."""
    extra = ["_id", "_key", "_kept", "_kept_id", "key", "id", "row", "kept", "changed_id", "group", "fp", "text_key", "score", "toxic", "held_out", "item_id", "a.b"]
    r = random.Random(3)
    text = lambda n: " ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n))
    passage = text(50)
    docs = [(1, text(60)), (2, text(30) + " " + passage), (3, passage + " " + text(20)), (4, None), (4, None), (None, text(40)), (5, text(25_000)), (6, text(50)), (6, text(50))]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    frame = spark.createDataFrame([(i, t, None if t is None else len(t), *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(docs)], schema)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(35)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = frame
        step(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert frame.columns == before.columns, name
        assert all(str(x["_id"])[3:] == str(x["a.b"])[3:] == str(x["row"])[3:] for x in frame.collect())
    rows = frame.collect()
    assert sorted(int(x["_id"][3:]) for x in rows if x.doc_id != 4) == [0, 1, 2, 5, 6, 7, 8] and sum(x.doc_id == 4 for x in rows) == 1
    assert all(passage not in (x.text or "") for x in rows) and max(len(x.text or "") for x in rows) == len(docs[6][1])
    assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).agg({"length": "sum"}).first()[0] > 25_000
