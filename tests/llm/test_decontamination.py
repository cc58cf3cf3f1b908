import random

import pytest

from linkweave.llm.decontamination import Q, Items, align, budget, clean, find, normal


def prose(r, n):
    return " ".join("".join(r.choice(("an", "er", "th", "in", "on", "re")) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(r, text, edits):
    for _ in range(edits):
        k = r.randrange(len(text))
        text = r.choice((text[:k] + text[k + 1 :], text[:k] + "z" + text[k:], text[:k] + "q" + text[k + 1 :]))
    return text


def nearest(item, region):
    """Edits between the item and its nearest stretch of the region, cell by cell."""
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(region, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    items = [(i, prose(r, 30)) for i in range(6)]
    docs = [(100 + k, prose(r, 200)) for k in range(8)]
    for k in range(20):
        i, t = items[k % 6]
        docs.append((k, prose(r, r.randint(0, 150)) + " " + edited(r, t, r.randint(0, 16)).upper() + "!\n" + prose(r, r.randint(0, 150))))
    return items, docs


def test_equals_brute_force(spark, case):
    items, docs = case
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = normal(x)[0].strip(), normal(t)[0]
            if nearest(a, b) <= budget(len(a), 0.1):
                want.add((d, i, nearest(a, b)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = find(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(want) >= 10
    texts = dict(docs)
    for r in got:
        piece = normal(texts[r.doc_id][r.start : r.start + r.length])[0].strip()
        assert nearest(normal(dict(items)[r.item_id])[0].strip(), piece) <= r.edits + 1


def test_exact_copy_anywhere_in_a_long_text():
    r = random.Random(9)
    items = [(1, prose(r, 40)), (2, "Été à l'école: " + prose(r, 30) + " Éé")]
    index = Items(items, 0.1)
    text = prose(r, 40_000) + " " + items[1][1] + " " + prose(r, 30_000)
    assert [(i, text[a : a + n], e) for i, a, n, e in index.matches(text)] == [(2, items[1][1], 0)]


def test_alignment_stays_within_its_budget():
    assert align(b"abcdefgh", b"xxabcdefghxx", 0) == (2, 10, 0)
    assert align(b"abcdefgh", b"xxabcdeghxx", 1) == (2, 9, 1)
    assert align(b"abcdefgh", b"zzzzzzzzzz", 2) is None


def test_edge_cases(spark, docs, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    assert find(docs, bench).collect() == []
    assert find(none, bench).collect() == []
    assert find(docs, bench.limit(0)).collect() == []
    whole = spark.createDataFrame([(9, "another text with the same id"), (9, "another text with the same id")], "item_id long, text string")
    assert {(r.doc_id, r.edits) for r in find(docs, whole).collect()} == {(7, 0)}


def test_few_grams_never_match():
    assert Items([(1, "x" * (2 * Q - 1))], 0.1).matches("x" * 100) == []


def test_short_items_are_found_as_whole_words():
    index = Items([(1, "17 + 25 = 42"), (2, "Paris"), (3, "東京大学院"), (4, "!?"), (5, "no no"), (6, "Élan"), (7, "a longer item of several words")], 0.1)

    def found(text):
        return [(i, text[a : a + n], e) for i, a, n, e in index.matches(text)]

    assert found("so 17+25=42.") == [(1, "17+25=42", 0)] and found("so 17+25=421.") == found("117+25=42") == []
    assert found("PARIS, paris; comparison and Parisian") == [(2, "PARIS", 0), (2, "paris", 0)]
    assert found("彼は東京大学院で学ぶ") == [(3, "東京大学院", 0)]
    assert found("no, no, no!? no") == [(5, "no, no", 0), (5, "no!? no", 0)]
    assert found("élan") == [(6, "élan", 0)] and found("élané") == found("") == []
    assert found("Paris: a longer item of several words") == [(7, "a longer item of several words", 0), (2, "Paris", 0)]


def test_a_benchmark_of_short_items_only(spark):
    docs = spark.createDataFrame([(1, "It is 42, they say."), (2, "It is 421."), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "42"), (8, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.length, r.edits) for r in find(docs, bench).collect()] == [(1, 9, 6, 2, 0)]
    assert {r.doc_id for r in clean(docs, bench).collect()} == {2, 3}


@pytest.mark.parametrize("before", ["İ", "İ .... ,,,, !!!! ... ", "ẞİİ ΑΣ. ---- ΣΣ ", "İ" * 40 + "\n\n\t-- ", "ŉ ǰ ΐ ΰ İ ", ""])
@pytest.mark.parametrize("after", ["", " İ", " .. !! İİ end"])
def test_places_where_lower_case_changes_lengths(before, after):
    item = "The quick brown fox - jumps over İzmir, and the ẞ lazy dog"
    text = before + " " + item + after
    assert [(i, text[a : a + n], e) for i, a, n, e in Items([(1, item)], 0.1).matches(text)] == [(1, item, 0)]
    short = Items([(2, "42")], 0.1)
    assert [(text[a : a + n]) for _, a, n, _ in short.matches(before + " 42" + after) for text in [before + " 42" + after]] == ["42"]


def test_neighbours_are_all_found():
    item = "nineteen signs here"
    text = "nineteen sign here nineteen signs here, nineteensigns here nineteen signs here"
    got = [(text[a : a + n].strip(" ,"), e) for _, a, n, e in sorted(Items([(1, item)], 0.1).matches(text), key=lambda x: x[1])]
    assert got == [("nineteen sign here", 1), (item, 0), ("nineteensigns here", 1), (item, 0)]
    many = " ".join(["a benchmark item of some length"] * 3000)
    assert len(Items([(1, "a benchmark item of some length")], 0.1).matches(many)) == 3000
