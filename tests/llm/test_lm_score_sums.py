"""The sums that the language model's tries are made of, by one sort or by places."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import lm_score


@pytest.mark.parametrize("most", [50, 1 << 40, 1 << 61])
@pytest.mark.parametrize("n", [0, 1, 4000])
def test_sums_by_key(n, most):
    r = np.random.default_rng(n)
    keys = r.integers(0, most, 1 + n // 4)[r.integers(0, 1 + n // 4, n)]
    times = r.integers(1, 300, n).astype(np.uint16)
    want = Counter()
    for k, x in zip(keys.tolist(), times.tolist(), strict=True):
        want[k] += x
    got, sums = lm_score.summed(keys, times)
    assert got.tolist() == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]


def test_a_block_that_asks_and_one_that_scores_have_the_same_keys():
    r = np.random.default_rng(1)
    text = np.concatenate([[0], r.integers(0, 30, 2000), [0]])
    order, count = np.arange(30), r.integers(1, 90, 30)
    body = lm_score.pack([np.array([7, 8]), np.array([7, 8]), np.zeros(2, np.uint8), np.array([1, 0], np.uint8), lm_score.smallest(np.array([1200, 802])), np.array([1, 2], np.uint8), lm_score.smallest(order), lm_score.smallest(text)])
    t = lm_score.Totals(5000, 30, 0.5, 200.0, 10.0, 9, 256)
    number = np.empty(30, np.int64)
    number[np.argsort(-count, kind="stable")] = np.arange(30) + 2
    asks, scores = (lm_score.Block(body, [lm_score._numbers(number, count)], t, x) for x in (False, True))
    assert (asks.keys == scores.keys).all() and (asks.shard == scores.shard).all()
    learnt = scores.scored & scores.training[scores.part]
    assert asks.times.tolist() == np.bincount(scores.which[learnt], minlength=len(scores.keys)).tolist() and asks.total.sum() == 1199


def test_blocks_do_not_depend_on_when_words_are_numbered_anew(spark):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in r.integers(0, 500, r.integers(0, 90))) for _ in range(60)] + ["a b " * 300, "", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    told = [sorted(map(tuple, lm_score.token_blocks(df, F.col("doc_id") % 3 != 0, 3, "doc_id", "text", 70, most).collect())) for most in (20, 400_000)]
    assert told[0] == told[1] and len(told[0]) > 80
