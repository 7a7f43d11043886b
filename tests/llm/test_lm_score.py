"""The language model against naive counts, and its trie."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import elias_fano, lm_score, quality

SCHEMA = "doc_id long, text string, block string"


def words(r, n, size=40):
    return " ".join("w" + str(int(r.paretovariate(0.7)) % size) for _ in range(n))


@pytest.mark.parametrize(("n", "u"), [(0, 5), (1, 1), (5, 6), (1000, 1000), (1000, 10**6), (20_000, 10**12)])
def test_elias_fano_round_trip_and_successor(n, u):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, u, n))
    e = elias_fano.EliasFano.build(v, u)
    assert (e.get(np.arange(n)) == v).all()
    if n:
        v = np.unique(v)
        e, x = elias_fano.EliasFano.build(v, u), r.integers(0, u, 2000)
        assert (e.successor(x, np.zeros(2000, int), np.full(2000, len(v))) == np.searchsorted(v, x)).all()


def test_trie_file_round_trip(tmp_path):
    r = np.random.default_rng(1)
    w = np.unique(r.integers(2, 10**9, 300))
    n = len(w)
    pairs = np.unique(r.integers(0, n * n, 20_000))
    triples = np.unique(r.integers(0, len(pairs) * n, 50_000))
    logs = [-20 * r.random(len(x)) for x in (w, pairs, pairs, triples)]
    trie = elias_fano.NgramTrie.build(-20.0, w, logs[0], pairs, logs[1], logs[2], triples, logs[3])
    (tmp_path / "trie").write_bytes(trie.dump())
    for back in (elias_fano.NgramTrie.open(str(tmp_path / "trie")), elias_fano.NgramTrie.mapped(trie.dump())):
        ask = r.integers(0, n * n, 30_000)
        at = {x: i for i, x in enumerate(pairs.tolist())}
        found = back.pair(ask // n, ask % n)
        assert found.tolist() == [at.get(x, -1) for x in ask.tolist()]
        ask = np.concatenate([triples[::3], r.integers(0, len(pairs) * n, 30_000)])
        at = {x: i for i, x in enumerate(triples.tolist())}
        assert back.triple(ask // n, ask % n).tolist() == [at.get(x, -1) for x in ask.tolist()]
        assert (back.pair(np.array([-1, 0]), np.array([0, -1])) == -1).all()
        for codes, x in zip((back.codes, back.pair_codes, back.after_codes, back.triple_codes), logs, strict=True):
            assert np.abs(elias_fano.restore(codes, -20.0) - x).max() < 2e-4
        assert (back.find(w) == np.arange(n)).all() and back.find(np.array([1]))[0] == -1


class Naive:
    """The model by plain counts over lists of tokens."""

    def __init__(self, toks, m2=200.0, m3=10.0):
        self.c, self.two, self.three, self.m2, self.m3 = Counter(), Counter(), Counter(), m2, m3
        for t in toks:
            self.c.update(t)
            self.two.update(zip(["", *t], t, strict=False))
            self.three.update(zip([None, "", *t], ["", *t], t, strict=False))
        self.n, self.v, self.texts = sum(self.c.values()), len(self.c), len(toks)
        n1, n2 = (sum(x == k for x in self.c.values()) for k in (1, 2))
        self.d = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p1(self, w):
        return (self.c[w] - self.d) / self.n if self.c[w] else max(self.d * self.v / self.n, 1 / (self.n + self.v + 1))

    def p2(self, w, v):
        return (self.two[v, w] + self.m2 * self.p1(w)) / (self.c[v] + self.m2)

    def p3(self, w, u, v):
        return (self.three[u, v, w] + self.m3 * self.p2(w, v)) / ((self.texts if u is None else self.two[u, v]) + self.m3)

    def score(self, t):
        return sum(math.log10(self.p3(w, u, v)) for u, v, w in zip([None, "", *t], ["", *t], t, strict=False))


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


@pytest.mark.parametrize("sizes", [{"block_tokens": 900, "shard_bytes": 900, "hot_share": 8}, {"block_tokens": 37, "shard_bytes": 2000, "hot_share": 30}, {}])
def test_language_model_matches_naive_counts(spark, sizes):
    r = random.Random(4)
    texts = [words(r, r.randint(0, 80)) for _ in range(120)] + [None, "", "W1 w1\x0bunseen word", "w1 " * 3000, *[f"the rare{k % 50} follows{k % 50} the once{k}" for k in range(200)]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, "w2 w3", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows]
    toks = [tokens(t) for _, t, _ in rows]
    m = Naive([t for t, h in zip(toks, held, strict=True) if not h])
    got = lm_score.score_texts(df, quality.remainder("doc_id", 7) == 2, **sizes).collect()
    want = sorted((str(i), h, len(t), sum(w in m.c for w in t), m.n, sum(math.log10((m.c[w] + 1) / (m.n + m.v + 1)) for w in t), m.score(t)) for (i, _, _), h, t in zip(rows, held, toks, strict=True))
    seen = sorted((str(x.doc_id), *x[1:]) for x in got)
    assert [x[:5] for x in seen] == [x[:5] for x in want]
    for a, b in zip(seen, want, strict=True):
        assert abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 3e-4 * b[2]


def test_a_stored_model_scores_alike(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(i, words(r, r.randint(0, 60)), "x") for i in range(60)], SCHEMA)
    held = quality.remainder("doc_id", 7) == 2
    blocks, numbers, totals = lm_score.prepare(df, ~held, block_tokens=300, shard_bytes=1000)
    model = lm_score.fit(blocks, numbers, totals)
    assert model.tries.count() > 3
    assert sorted(map(tuple, lm_score.score(blocks, numbers, model).collect())) == sorted(map(tuple, lm_score.score_texts(df, held, block_tokens=300, shard_bytes=1000).collect()))


def test_empty_tables_and_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b", ""), (2, None, "")], SCHEMA)
    assert lm_score.score_texts(df.limit(0), F.lit(False)).count() == 0
    got = {x.doc_id: (x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in lm_score.score_texts(df, F.lit(True)).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}


def test_each_order_sums_to_one():
    r = random.Random(3)
    m = Naive([tokens(words(r, 30, 15)) for _ in range(20)])
    known = [*m.c]
    assert abs(sum(map(m.p1, known)) + m.p1("?") - 1) < 1e-9
    for v in known:
        assert abs(sum(m.p2(w, v) for w in [*known, "?"]) - 1) < 1e-9
    for u, v in [(None, ""), *[k for k in m.two if k[1]][:50], ("?", "w1")]:
        assert abs(sum(m.p3(w, u, v) for w in [*known, "?"]) - 1) < 1e-9


def test_a_frequent_pair_is_spread_over_shards():
    """A pair that is a third of all tokens: no shard gets more than a few of its n-grams, and each gets its total."""
    n = 3000
    count = np.concatenate([[n, n], np.ones(n, np.int64)])
    order = np.arange(len(count))
    number = order + 10
    text = np.empty(3 * n + 1, np.int64)
    text[0], text[1::3], text[2::3], text[3::3] = 0, np.arange(n) + 2, 0, 1
    body = lm_score.pack([np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8), np.ones(1, np.uint8), lm_score.smallest(np.array([len(text)])), np.ones(1, np.uint8), lm_score.smallest(order), lm_score.smallest(text)])
    t = lm_score.Totals(3 * n, n + 2, 0.5, 200.0, 10.0, 40, 256)
    block = lm_score.Block(body, [lm_score._numbers(number, count)], t)
    sent = list(block.requests())
    w, v = (int(np.flatnonzero(block.word == x)[0]) for x in (11, 10))
    pair = int(np.flatnonzero((block.w == w) & (block.v == v))[0])
    assert block.total[pair] == n and sum(pair in pairs for _, _, pairs in sent) == 40
    assert max(len(keys) for _, keys, _ in sent) < len(block.keys) / 8


def test_requests_round_trip():
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False))
    for words in (h, h[:1], h[:2]):
        back, counts = lm_score._open_words(lm_score.pack([*lm_score.hash_steps(words), lm_score.smallest(np.arange(len(words)))]))
        assert (back == words).all() and len(counts) == len(words)
    first = np.array([True, False, False, True, True, False])
    x = np.array([3, 3, 9, 1, 0, 7])
    assert (lm_score.sums(lm_score.steps(x, first), first) == x).all()
