import random
from itertools import product

import numpy as np
import pytest

from linkweave.llm.toxicity import LabelModel, _spanning_tree, held_out, label_model, score, train_linear


def make(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = r.random() < 0.2
        w = [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(r.randint(10, 80))]
        if toxic:
            w += r.choices(["Idiot", "scum,", "gnarfle", "gnarflest", "gnarfling", "(brumph)"], k=r.randint(1, 5))
            r.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = make(1500, 3)
    docs = spark.createDataFrame([(i, t, "en", 0.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert all(r.held_out == held_out(i) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    unseen = [(got[i].predicted, y) for i, _, y in rows if held_out(i)]
    assert sum(p == y for p, y in unseen) / len(unseen) > 0.97


def test_edge_cases(spark, docs, none, texts):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    assert len({r.score for r in score(docs, labels).where("doc_id in (30, 31, 32)").collect()}) == 1
    assert score(docs, labels.limit(0)).count() == len(texts)
    assert score(none, labels).collect() == []


def test_repeating_voters_share_their_weight():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    a, b = (r.random(4000) < np.where(y, 0.8, 0.1)).astype(float), (r.random(4000) < np.where(y, 0.6, 0.1)).astype(float)
    start, times = np.full(4000, 0.5) + 0.01 * (np.where(y, 0.9, 0.1) - 0.5), np.ones(4000)
    alone = label_model(np.stack([a, b], 1), start, times)[1]
    many = label_model(np.stack([a] * 8 + [b], 1), start, times)[1]
    assert np.abs(alone - many).mean() < 0.25
    model = LabelModel(9)
    model.fit(np.stack([a] * 8 + [b], 1), y.astype(float), times)
    two = LabelModel(2)
    two.fit(np.stack([a, b], 1), y.astype(float), times)
    assert np.abs(model.posterior(np.stack([a] * 8 + [b], 1)) - two.posterior(np.stack([a, b], 1))).max() < 0.02


def some_model(seed, voters):
    r, model = np.random.default_rng(seed), LabelModel(voters)
    model.parent = np.array([-1] + [int(r.integers(0, k)) for k in range(1, voters)])
    model.balance, model.rates = 0.35, r.uniform(0.05, 0.95, (2, 2, voters))
    model.rates[:, 1, 0] = model.rates[:, 0, 0]
    return r, model


def joint(model, row, label):
    p = model.balance if label else 1 - model.balance
    for k, v in enumerate(row):
        above = 0 if model.parent[k] < 0 else int(row[model.parent[k]])
        rate = model.rates[label, above, k]
        p *= rate if v else 1 - rate
    return p


@pytest.mark.parametrize("seed", range(5))
def test_posteriors_equal_enumeration(seed):
    _, model = some_model(seed, 6)
    rows = np.array(list(product((0.0, 1.0), repeat=6)))
    both = np.array([[joint(model, r, y) for y in (0, 1)] for r in rows])
    assert both.sum() == pytest.approx(1)
    assert model.posterior(rows) == pytest.approx(both[:, 1] / both.sum(axis=1))


@pytest.mark.parametrize("seed", range(5))
def test_a_round_never_makes_votes_less_likely(seed):
    """Expectation-maximisation over a fixed tree, by brute force over all rows of votes."""
    r, truth = some_model(seed, 5)
    rows = np.array(list(product((0.0, 1.0), repeat=5)))
    times = r.multinomial(20_000, [joint(truth, x, 0) + joint(truth, x, 1) for x in rows]).astype(float)
    model, q, last = LabelModel(5), r.uniform(0.2, 0.8, len(rows)), -np.inf
    model.parent = truth.parent
    for _ in range(15):
        model.fit(rows, q, times, tree=False)
        q = model.posterior(rows)
        value = sum(n * np.log(joint(model, x, 0) + joint(model, x, 1)) for n, x in zip(times, rows))
        assert value >= last - 1
        last = value


def test_accuracies_of_the_model_that_drew_the_votes():
    """From a poor start and without labels, rates and posteriors come near those of the model that drew the rows."""
    r, truth = some_model(11, 8)
    truth.rates[0], truth.rates[1] = r.uniform(0.02, 0.15, (2, 8)), r.uniform(0.55, 0.9, (2, 8))
    truth.rates[:, 1, 0] = truth.rates[:, 0, 0]
    y, votes = r.random(20_000) < truth.balance, np.zeros((20_000, 8))
    for k in range(8):
        above = votes[:, truth.parent[k]].astype(int) if k else np.zeros(20_000, int)
        votes[:, k] = r.random(20_000) < truth.rates[y.astype(int), above, k]
    model, q = label_model(votes, np.where(votes[:, 0] > 0, 0.7, 0.3), np.ones(20_000), 200)
    assert abs(model.balance - truth.balance) < 0.03
    for label in (0, 1):
        weight = q if label else 1 - q
        assert (weight @ votes) / weight.sum() == pytest.approx(votes[y == label].mean(axis=0), abs=0.04)
    assert np.abs(q - truth.posterior(votes)).mean() < 0.03


def test_spanning_tree_is_the_heaviest():
    r = np.random.default_rng(2)
    w = r.random((5, 5))
    w = w + w.T
    parent = _spanning_tree(w)
    got = sum(w[k, p] for k, p in enumerate(parent) if p >= 0)

    def whole(edges):
        seen = {0}
        for _ in range(5):
            seen |= {b for a, b in edges if a in seen} | {a for a, b in edges if b in seen}
        return len(seen) == 5

    from itertools import combinations

    every = [(a, b) for a in range(5) for b in range(a)]
    assert got == pytest.approx(max(sum(w[a, b] for a, b in e) for e in combinations(every, 4) if whole(e)))


def test_rows_count_as_often_as_they_occur():
    r = np.random.default_rng(4)
    x, q, times = r.normal(size=(30, 3)), r.random(30), r.integers(1, 5, 30)
    some, all_rows = train_linear(x, q, times.astype(float)), train_linear(np.repeat(x, times, axis=0), np.repeat(q, times), np.ones(times.sum()))
    assert some[0] == pytest.approx(all_rows[0], abs=1e-5) and some[1] == pytest.approx(all_rows[1], abs=1e-5)


def test_linear_classifier_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 20)
    w, b = train_linear(x, (x[:, 0] > 1.5).astype(float), np.ones(80), ridge=0.01)
    assert w[0] > 0 and (x[:, 0] * w[0] + b > 0).tolist() == (x[:, 0] > 1.5).tolist()
