"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (beginnings of words): a short general list, and those that a bounded
sample of labelled rows suggests. A generative label model has, for each class, the rate at which each voter fires (its
accuracy) and the rates at which pairs of voters fire together (their correlation); the pairs form the tree that holds
most of the voters' mutual information within the classes, so a voter that repeats another adds nothing. Labels of the
sample choose voters and start the model, which tells the classes apart; from then on it is fitted by
expectation-maximisation to the votes alone, and its posteriors come from votes, not from a row's label. A linear
classifier is trained on the posteriors, and only it scores documents: the voters that fire, with the logarithm of how
often, are its features.

The sample: labelled rows outside the held-out fold, the SAMPLE of them with the smallest hashes of their doc_id; where
rows share doc_ids, at most SAMPLE different rows of votes, by hash, enter the models with how many rows have them.
Labels, lang, source and doc_id are no inputs of a score.

Edge cases: null and empty texts have no features and get the classifier's bias; without labelled rows the general list
alone votes, and without any document of the sample the score is a fixed logistic curve of its votes; with labels of one
class alone, posteriors are the labels. Repeated rows get equal scores; a null doc_id counts as the text "" for the
split, and labels with a null doc_id are of no row; labels that contradict each other both count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows

FOLDS, SAMPLE, VOTERS = 5, 20_000, 400
#: Rounds of expectation-maximisation after the start, at most.
ROUNDS = 10
#: Lengths of the beginnings that patterns look at.
STEMS = (3, 4, 5, 6, 7, 8)
# General insults.
LEXICON = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(str("" if doc_id is None or doc_id is pd.NA else int(doc_id)).encode()) % folds == 0


def signs(word: str) -> list[str]:
    """The lexicon entry and the patterns that a word may fire."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def _document_signs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of documents by sign and label, added up within each batch."""
    for part in parts:
        seen = (Counter(), Counter())
        for text, toxic in zip(part["text"], part["toxic"]):
            seen[int(toxic)].update({s for w in set(_WORD.findall(text.lower())) for s in signs(w)})
        rows = [(s, seen[1][s], seen[0][s]) for s in seen[0].keys() | seen[1].keys()]
        yield pd.DataFrame(rows, columns=["sign", "pos", "neg"])


class Votes:
    """Counts, by voter, of what fires in a text; words that were looked up are remembered, up to a bound."""

    REMEMBERED = 200_000

    def __init__(self, voters: list[str]):
        self.index = {v: i for i, v in enumerate(voters)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in Counter(_WORD.findall(text.lower())).items():
            fired = self.known.get(word)
            if fired is None:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                fired = self.known[word] = tuple(self.index[s] for s in signs(word) if s in self.index)
            for i in fired:
                out[i] = out.get(i, 0) + n
        return out


class LabelModel:
    """Two classes of 0/1 votes, each a tree of voters: a voter's rate depends on the class and on whether its parent fires."""

    def __init__(self, voters: int):
        self.parent = np.full(voters, -1)
        self.balance = 0.5
        #: By class: the rate of each voter where its parent doesn't fire, and where it does (for the root both are one).
        self.rates = np.full((2, 2, voters), 0.5)

    @staticmethod
    def _rates(votes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rates of voters, rates of pairs, and the weight of a class with one more row of all rows' rates."""
        total = weight.sum() + 1
        one = (weight @ votes + votes.mean(axis=0)) / total
        both = ((votes * weight[:, None]).T @ votes + np.outer(one, one)) / total
        return one, np.minimum(both, np.minimum(one[:, None], one[None, :])), total

    @staticmethod
    def _information(one: np.ndarray, both: np.ndarray) -> np.ndarray:
        a, b, out = one[:, None], one[None, :], np.zeros(both.shape)
        for p, q in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
            out += np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0.0)
        return out

    def fit(self, votes: np.ndarray, q: np.ndarray, times: np.ndarray, tree: bool = True) -> None:
        """The parameters most likely for rows of votes whose classes have the posteriors q."""
        known = [self._rates(votes, times * w) for w in (1 - q, q)]
        if tree:
            self.parent = _spanning_tree(sum(total * self._information(one, both) for one, both, total in known))
        self.balance = known[1][2] / (known[0][2] + known[1][2])
        child = np.arange(len(self.parent))
        at = np.where(self.parent < 0, child, self.parent)
        for k, (one, both, _) in enumerate(known):
            one = np.clip(one, 1e-6, 1 - 1e-6)
            with_parent = np.where(self.parent < 0, one, both[child, at] / one[at])
            without = np.where(self.parent < 0, one, (one - both[child, at]) / (1 - one[at]))
            self.rates[k] = np.clip([without, with_parent], 1e-6, 1 - 1e-6)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of votes."""
        above = np.where(self.parent < 0, 0, votes[:, self.parent])
        logit = np.full(len(votes), np.log(self.balance / (1 - self.balance)))
        for sign, (without, with_parent) in zip((-1, 1), self.rates):
            for fires, rate in ((above, with_parent), (1 - above, without)):
                logit += sign * ((votes * fires) @ np.log(rate) + ((1 - votes) * fires) @ np.log(1 - rate))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _spanning_tree(weight: np.ndarray) -> np.ndarray:
    """The parent of each node (-1: the root) in the spanning tree of the largest weight."""
    n = len(weight)
    parent, best, inside = np.full(n, -1), weight[0].copy(), np.zeros(n, bool)
    near = np.zeros(n, np.int64)
    inside[0] = True
    for _ in range(n - 1):
        k = int(np.argmax(np.where(inside, -np.inf, best)))
        inside[k], parent[k] = True, near[k]
        closer = ~inside & (weight[k] > best)
        best[closer], near[closer] = weight[k][closer], k
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> tuple[LabelModel, np.ndarray]:
    """The model and its posteriors, by expectation-maximisation from a first guess of the rows' classes."""
    model = LabelModel(votes.shape[1])
    model.fit(votes, start, times)
    q = model.posterior(votes)
    for _ in range(rounds):
        model.fit(votes, q, times)
        before, q = q, model.posterior(votes)
        if np.abs(q - before).max() < 1e-4:
            break
    return model, q


def train_linear(x: np.ndarray, q: np.ndarray, times: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton steps; times: how many rows are like each."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(full.shape[1]), np.full(full.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (times * (p - q)) + keep * w
        bend = (full * (times * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + np.diag(keep)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = SAMPLE) -> DataFrame:
    """text, toxic of at most so many labelled rows: their ids are bounded, and so broadcast."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.crc32(key) % folds != 0)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    return doc_rows(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic")


class Model:
    def __init__(self, voters: list[str], weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def scorer(self):
        votes, weights, bias = Votes(self.voters), self.weights.tolist(), self.bias

        def score(text: str) -> float:
            z = bias + sum(weights[i] * np.log1p(n) for i, n in sorted(votes(text).items()))
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    sample = labelled_sample(docs, labels, folds)
    sizes = {int(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    found: list[str] = []
    if pos and neg:
        counts = sample.mapInPandas(_document_signs, "sign string, pos long, neg long").groupBy("sign").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
        most = counts.where(F.col("pos") >= 3).withColumn("odds", odds).where(F.col("odds") > 1.0)
        # A voter's worth: how far it separates the classes, by how many documents it speaks for.
        found = [r["sign"] for r in most.orderBy((F.col("odds") * F.sqrt("pos")).desc(), "sign").limit(VOTERS).collect()]
    voters = list(dict.fromkeys([*LEXICON, *found]))
    general = np.array([1.0] * len(LEXICON) + [0.0] * (len(voters) - len(LEXICON)))
    if not pos + neg:
        return Model(voters, 3.0 * general, -2.0)

    def fired(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes = Votes(voters)
        for part in parts:
            got = [sorted(votes(t).items()) for t in part["text"]]
            yield pd.DataFrame({"toxic": part["toxic"], "at": [[i for i, _ in g] for g in got], "n": [[n for _, n in g] for g in got]})

    rows = sample.mapInPandas(fired, "toxic int, at array<int>, n array<int>").groupBy("toxic", "at", "n").agg(F.count("*").alias("rows"))
    rows = rows.orderBy(F.xxhash64("toxic", "at", "n"), "toxic", "at", "n").limit(SAMPLE).collect()
    x = np.zeros((len(rows), len(voters)))
    for k, r in enumerate(rows):
        x[k, r["at"]] = np.log1p(r["n"])
    times, toxic = np.array([float(r["rows"]) for r in rows]), np.array([float(r["toxic"]) for r in rows])
    q = label_model((x > 0).astype(np.float64), toxic, times)[1] if pos and neg else toxic
    return Model(voters, *train_linear(x, q, times))


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted for every row."""
    model = train(docs, labels, folds)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rate = model.scorer()
        for part in parts:
            s = np.array([rate(t) for t in part["text"]], np.float64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "held_out": [held_out(None if pd.isna(i) else i, folds) for i in part["doc_id"]], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return doc_rows(docs).withColumn("text_key", F.xxhash64("text")).mapInPandas(run, "doc_id long, text_key long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; only texts go to Python."""
    model = train(docs, labels)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rate = model.scorer()
        for part in parts:
            yield pd.Series([rate(t) < 0.5 for t in part], dtype=bool)

    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
