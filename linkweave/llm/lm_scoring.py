"""Language-model scoring by a weighted backoff automaton.

States are the root, every training token and every two tokens in a row; the state of h has an arc for each n-gram
(h, w) seen in training, and a failure arc to the state g of its last token (of a single token: to the root) that
carries the backoff weight. With absolute discounting of D (one for each order), C the count of h and T its number of
distinct followers:

    weight(h -> w)    = (c(h, w) - D) / C + D * T / C * p(w | g)    an arc of h
    weight(h -> g)    = D * T / C, then p(w | g) from g             the failure arc
    p(w)              = (c(w) + 0.1) / (N + 0.1 * (V + 1))          arcs of the root, unseen tokens as one

which sums to one for every h. A text is traversed once from left to right, from the state of the end token: each token
takes an arc, or failure arcs and then an arc, its log10 weight is added, and the state of the last two tokens (the
longest end of them that training has) is carried on. Of order 2, states are single tokens.

The automaton is as large as the corpus, so it is never in one place: blocks of documents fetch the arcs that their own
texts use. Texts are cut into numbered tokens once, in a table of blocks that later steps read in place. A block sends its distinct 1- and 2-grams once with its training counts, and gets the totals back in the same
order, and whether other blocks have them. Then it does so for 3-grams, but for those with a 2-gram that no other block
has: their totals are its own. A last exchange counts each state's followers (each n-gram counted by one block alone);
states that are a block's own, or seen once, need none.

Edge cases: a null text counts as empty and has the end token alone; a null doc_id counts as the text "" for the split;
without training rows the root has only unseen tokens. Repeated rows are separate texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYED_SCHEMA, buckets, decode_counts, decode_keys, drop_staged, encode_counts, encode_keys, keyed_rows, mix, stage, stage_buckets, to_blocks, unpack, word_keys

FOLDS, ADD, ORDER = 10, 0.1, 3
END = np.uint64(0x2545F4914F6CDD1C)  # keys of tokens are even
#: Larger blocks send fewer n-grams twice.
LM_BLOCK_BYTES = 8 << 20
#: Buckets of the table of blocks, at most; a block is a unit of work in any of them.
BUCKETS = 20_000


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % folds == 0


class _Tokens:
    """A block's tokens as numbers of its distinct 1- and 2-grams, whose keys ascend (even and odd ones).

    cut() does so for texts, once; to_bytes() keeps the numbers, from which all else follows without sorting again.
    """

    def __init__(self, ids: list, sizes: np.ndarray, word: np.ndarray, pair: np.ndarray, grams: np.ndarray, folds: int):
        self.ids, self.sizes, self.word, self.pair, self.grams = ids, sizes, word, pair, grams
        self.ends = np.cumsum(sizes) - 1
        self.held = np.array([held_out(i, folds) for i in ids], bool)
        self.train = np.repeat(~self.held, sizes)
        #: The token before; a text's first follows the end token.
        self.before = np.concatenate([[np.searchsorted(grams, END)], word[:-1]]) if len(word) else word
        two = (grams & np.uint64(1)).astype(bool)
        #: The 1-grams', and the 2-grams' numbers.
        self.words, self.pairs = np.flatnonzero(~two), np.flatnonzero(two)
        kept = self.train.astype(np.float64)
        self.counts = (np.bincount(word, kept, len(grams)) + np.bincount(pair, kept, len(grams))).astype(np.int64)

    @classmethod
    def cut(cls, payload: bytes, folds: int) -> _Tokens:
        ids, texts = unpack(payload)
        words, sizes = word_keys([t.lower() for t in texts])
        sizes = sizes + 1
        tokens = np.full(int(sizes.sum()), END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(sizes) - 1] = False
        tokens[inside] = words & ~np.uint64(1)
        grams, at = np.unique(np.concatenate([tokens, cls._pairs(tokens)]), return_inverse=True)
        return cls(ids, sizes, at[: len(tokens)], at[len(tokens) :], grams, folds)

    @staticmethod
    def _pairs(tokens: np.ndarray) -> np.ndarray:
        return mix(np.concatenate([[END], tokens[:-1]]).astype(np.uint64), tokens) | np.uint64(1)

    def to_bytes(self) -> bytes:
        place = np.zeros(len(self.grams), np.int64)
        place[self.words] = np.arange(len(self.words))
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        parts = [known.tobytes(), ids.tobytes(), self.sizes.astype("<i8").tobytes(), encode_keys(self.grams[self.words]), encode_counts(place[self.word]), encode_counts(self.pair)]
        return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def read(cls, raw: bytes, folds: int) -> _Tokens:
        lengths = np.frombuffer(raw, "<i8", 6)
        ends = (48 + np.cumsum(lengths)).tolist()
        known, ids, sizes, keys, place, pair = (raw[e - n : e] for e, n in zip(ends, lengths.tolist()))
        keys, place, pair = decode_keys(keys), decode_counts(place), decode_counts(pair)
        tokens = keys[place]
        # What isn't a pair's number is a word's, in order.
        is_word = np.ones(int(pair.max()) + 1 + len(keys) if len(pair) else 0, bool)
        is_word[pair] = False
        at = np.flatnonzero(is_word)[: len(keys)]
        grams = np.zeros(len(keys) + len(is_word) - int(is_word.sum()), np.uint64)
        grams[at] = keys
        grams[pair] = cls._pairs(tokens)
        names = [v if k else None for v, k in zip(np.frombuffer(ids, "<i8").tolist(), known)]
        return cls(names, np.frombuffer(sizes, "<i8"), at[place], pair, grams, folds)


def _first(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of n numbers occurs first; anything for one that doesn't."""
    out = np.zeros(n, np.int64)
    out[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return out


class _Triples:
    """A block's distinct 3-grams, whose keys ascend. The first token of a text ends none."""

    def __init__(self, t: _Tokens, shared: np.ndarray):
        inside = np.ones(len(t.word), bool)
        inside[t.ends + 1 - t.sizes] = False
        self.at = np.flatnonzero(inside)
        context, pair = t.pair[self.at - 1], t.pair[self.at]
        self.grams, first, self.triple = np.unique(mix(t.grams[context], t.grams[t.word[self.at]]) | np.uint64(1), return_index=True, return_inverse=True)
        self.counts = np.bincount(self.triple, t.train[self.at].astype(np.float64), len(self.grams)).astype(np.int64)
        #: The 2-gram before each 3-gram.
        self.before = context[first]
        #: Whether other blocks may have the 3-gram.
        self.sent = shared[self.before] & shared[pair[first]]

    def totals(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        total, owned = self.counts.copy(), np.ones(len(self.grams), bool)
        total[self.sent], owned[self.sent], _ = _gather(answers)
        return total, owned


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Each block's keys' counts over all blocks, whether several have the key, and its owner: the first block that does."""
    keys = [decode_keys(k) for k in rows["keys"]]
    flat, counts = np.concatenate(keys), np.concatenate([decode_counts(c) for c in rows["counts"]])
    distinct, first, inverse, many = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    owned = np.zeros(len(flat), np.int64)
    owned[first] = 1
    ends = np.cumsum([len(k) for k in keys])
    pieces = [slice(e - len(k), e) for k, e in zip(keys, ends)]
    pairs, out = (distinct & np.uint64(1)).astype(bool), total[inverse] * 4 + (many > 1)[inverse] * 2 + owned
    some = np.zeros((len(rows), 4), np.int64)
    some[0] = total[~pairs].sum(), (total[~pairs] > 0).sum(), (total[pairs] == 1).sum(), (total[pairs] == 2).sum()
    some[0, 2:] += rows[["once", "twice"]].to_numpy(dtype=np.int64).sum(0)
    return pd.DataFrame({"blk": rows["blk"], "r": rows["r"], "answer": [encode_counts(out[p]) for p in pieces], "tokens": some[:, 0], "types": some[:, 1], "once": some[:, 2], "twice": some[:, 3]})


#: once, twice: n-grams that a block doesn't send, by their count.
SENT = KEYED_SCHEMA + ", once long, twice long"
ANSWER = "blk long, r int, answer binary, tokens long, types long, once long, twice long"


def _exchange(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("r").applyInPandas(_totals, ANSWER)


def _sent(blk: int, keys: np.ndarray, counts: np.ndarray, parts: int, rest: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of SENT for a block's ascending distinct keys; rest: counts of n-grams that it doesn't send."""
    rows = keyed_rows(blk, keys, counts, parts)
    if rest is not None and not len(rows):
        rows = pd.DataFrame([(blk, 0, encode_keys(keys), encode_counts(counts))], columns=rows.columns)
    rows["once"] = rows["twice"] = 0
    if rest is not None:
        rows.loc[0, ["once", "twice"]] = int((rest == 1).sum()), int((rest == 2).sum())
    return rows


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def _gather(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in the order of a block's keys, whether it owns each, and whether other blocks have it."""
    got = np.concatenate([decode_counts(a) for a in answers.sort_values("r")["answer"]]) if len(answers) else np.zeros(0, np.int64)
    return got >> 2, (got & 1).astype(bool), (got & 2).astype(bool)


class _Known:
    """What a block knows of its n-grams by the answers (kind 0: 1- and 2-grams, 2: 3-grams)."""

    def __init__(self, t: _Tokens, answers: pd.DataFrame, order: int):
        self.total, owned, shared = _gather(answers[answers["kind"] == 0])
        arcs = t.pairs[owned[t.pairs] & (self.total[t.pairs] > 0)]
        self.followers = np.bincount(t.before[_first(t.pair, len(t.grams))[arcs]], minlength=len(t.grams))
        states = np.zeros(len(t.grams), bool)
        states[t.before] = True
        self.triples = self.total3 = None
        if order > 2:
            self.triples = _Triples(t, shared)
            self.total3, owned = self.triples.totals(answers[answers["kind"] == 2])
            self.followers += np.bincount(self.triples.before[owned & (self.total3 > 0)], minlength=len(t.grams))
            states[self.triples.before] = True
        #: States whose followers other blocks may have.
        self.asked = np.flatnonzero(states & shared & (self.total > 1))

    def all_followers(self, answers: pd.DataFrame) -> np.ndarray:
        out = np.where(self.total == 1, 1, self.followers)
        out[self.asked], _, _ = _gather(answers[answers["kind"] == 1])
        return out


class _Automaton:
    """The part of the automaton that a block's texts pass through.

    A state is the number of a 1- or 2-gram (known: whether training has it), or ROOT. arc holds the log10 weight of each
    n-gram's arc, from the state of all its tokens but the last; nan where there is none. fail holds the log10 weight of
    each state's failure arc, back the state that it leads to.
    """

    ROOT = -1

    def __init__(self, t: _Tokens, known: _Known, followers: np.ndarray, n: int, v: int, discounts: tuple[float, float]):
        self.known, self.triples = known.total > 0, known.triples
        seen = np.maximum(known.total, 1)
        left = followers / seen
        self.fail, self.back = np.zeros(len(t.grams)), np.full(len(t.grams), self.ROOT)
        words, pairs = t.words, t.pairs
        first, states = _first(t.pair, len(t.grams)), np.zeros(len(t.grams), np.int64)
        self.back[t.pair] = t.word  # a 2-gram's last token
        states[pairs] = t.before[first[pairs]]
        with np.errstate(divide="ignore"):
            self.fail[words] = np.log10(discounts[0] * left[words])
            self.fail[pairs] = np.log10(discounts[1] * left[pairs])
        self.arc = np.full(len(t.grams), np.nan)
        self.arc[words] = np.log10((known.total[words] + ADD) / (n + ADD * (v + 1)))
        two = pairs[self.known[pairs]]
        self.arc[two] = self._arcs(known.total[two], seen[states[two]], discounts[0], self.fail[states[two]] + self.arc[self.back[two]])
        self.arc3 = np.zeros(0)
        if self.triples is not None:
            self.arc3 = np.full(len(known.total3), np.nan)
            ends = np.zeros(len(known.total3), np.int64)  # the 2-gram that ends each 3-gram
            ends[self.triples.triple] = t.pair[self.triples.at]
            three = np.flatnonzero(known.total3 > 0)
            state = self.triples.before[three]
            self.arc3[three] = self._arcs(known.total3[three], seen[state], discounts[1], self.fail[state] + self.arc[ends[three]])

    @staticmethod
    def _arcs(count: np.ndarray, seen: np.ndarray, discount: float, backed: np.ndarray) -> np.ndarray:
        return np.log10((count - discount) / seen + 10**backed)

    def traverse(self, t: _Tokens) -> np.ndarray:
        """The log10 weight of each token, from left to right: its arc, or failure arcs and then an arc."""
        # The state carried to each token: that of the two before if training has them, else that of the one before.
        first = t.ends + 1 - t.sizes
        state = t.before
        if self.triples is not None:
            state = np.concatenate([[0], t.pair[:-1]]) if len(t.pair) else t.pair
            state[first] = t.before[first]
            state = np.where(self.known[state], state, t.before)
        weight, at = np.zeros(len(state)), np.arange(len(state))
        if self.triples is not None:
            arc = np.full(len(state), np.nan)
            arc[self.triples.at] = self.arc3[self.triples.triple]
            found = ~np.isnan(arc)
            weight[found] = arc[found]
            at = np.flatnonzero(~found)
            two = at[self.back[state[at]] != self.ROOT]
            weight[two] += self.fail[state[two]]
            state[two] = self.back[state[two]]
        # Now in states of one token: known or not, they lead to the root.
        arc = self.arc[t.pair[at]]
        found = ~np.isnan(arc)
        weight[at[found]] += arc[found]
        at = at[~found]
        some = at[self.known[state[at]]]
        weight[some] += self.fail[state[some]]
        weight[at] += self.arc[t.word[at]]
        return weight


def score(docs: DataFrame, folds: int = FOLDS, block_bytes: int = LM_BLOCK_BYTES, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; order: 2 or 3."""
    blocks = to_blocks(docs, "lm", block_bytes)
    words, many = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    parts = buckets(words)

    def numbered(batches):
        for batch in batches:
            for blk, payload in batch[["blk", "payload"]].itertuples(index=False):
                yield pd.DataFrame({"blk": [blk], "tokens": [_Tokens.cut(payload, folds).to_bytes()]})

    own = stage_buckets(blocks.select("blk", "payload").mapInPandas(numbered, "blk long, tokens binary"), "lm-tokens", "blk", max(1, min(BUCKETS, many)))
    drop_staged(blocks)

    def read(left: pd.DataFrame) -> tuple[int, _Tokens]:
        return int(left["blk"].iloc[0]), _Tokens.read(left["tokens"].iloc[0], folds)

    def gram_keys(batches):
        for batch in batches:
            for k in range(len(batch)):
                blk, t = read(batch.iloc[k : k + 1])
                yield _sent(blk, t.grams, t.counts, parts)

    def triple_keys(left: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        blk, t = read(left)
        t = _Triples(t, _gather(answers)[2])
        return _sent(blk, t.grams[t.sent], t.counts[t.sent], parts, t.counts[~t.sent]).astype({"blk": "int64", "r": "int32"})

    def follower_keys(left: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        blk, t = read(left)
        known = _Known(t, answers, order)
        return _sent(blk, t.grams[known.asked], known.followers[known.asked], parts).astype({"blk": "int64", "r": "int32"})

    def traverse(left: pd.DataFrame, answers: pd.DataFrame, n: int, v: int, discounts: tuple[float, float]) -> pd.DataFrame:
        _, t = read(left)
        known = _Known(t, answers, order)
        automaton = _Automaton(t, known, known.all_followers(answers), n, v, discounts)
        sums = [np.add.reduceat(x, t.ends + 1 - t.sizes) for x in (automaton.known[t.word].astype(np.int64), automaton.arc[t.word], automaton.traverse(t))]
        return pd.DataFrame({"doc_id": pd.array(t.ids, "Int64"), "held_out": t.held, "n_tokens": t.sizes, "n_known": sums[0], "train_tokens": n, "base_score": sums[1], "score": sums[2]})

    def each_block(answers: DataFrame, use, schema: str) -> DataFrame:
        return own.groupBy("blk").cogroup(answers.groupBy("blk")).applyInPandas(use, schema)

    def sums(df: DataFrame, *names: str):
        return df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()

    grams = stage(_exchange(own.mapInPandas(gram_keys, SENT)), "lm-grams", "none", free=True)
    n, v, once, twice = sums(grams, "tokens", "types", "once", "twice")
    discounts = (_discount(once, twice), 0.5)
    answers = grams.select("blk", "r", "answer", F.lit(0).alias("kind"))
    if order > 2:
        triples = stage(_exchange(each_block(answers, triple_keys, SENT)), "lm-triples", "none", free=True)
        discounts = (discounts[0], _discount(*sums(triples, "once", "twice")))
        answers = answers.unionByName(triples.select("blk", "r", "answer", F.lit(2).alias("kind")))
    both = answers.unionByName(_exchange(each_block(answers, follower_keys, SENT)).select("blk", "r", "answer", F.lit(1).alias("kind")))
    return each_block(both, lambda a, b: traverse(a, b, n, v, discounts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=ORDER)
