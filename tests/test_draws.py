"""The seeded test draws what Python's generator draws, wherever a task begins."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quire.operators import draws, significance


def test_a_stream_begins_anywhere():
    r = random.Random(7)
    want = [r.random() for _ in range(30_000)]
    stream = draws.Stream()
    for at in (0, 1, 311, 312, 5_000, 29_000):
        stream.at(draws.jump(draws.start(7), draws.ahead(2 * at)))
        assert stream.random(np.empty(700)).tolist() == want[at : at + 700]


def one_by_one(rows, n_iter, seed):
    """The test as the reference runs it: one generator, a draw for each query of each iteration."""
    diffs = [x - y for _, x, y in sorted(rows)]
    if not any(diffs):
        return 1.0
    target, rng = abs(sum(diffs) / len(diffs)), random.Random(seed)
    hits = sum(abs(sum(x if rng.random() < 0.5 else -x for x in diffs) / len(diffs)) >= target - 1e-12 for _ in range(n_iter))
    return round((hits + 1) / (n_iter + 1), 4)


@pytest.mark.parametrize("segment", [1 << 22, 64])
def test_seeded_is_the_generators_own_test(spark, monkeypatch, segment):
    monkeypatch.setattr(significance, "SEGMENT", segment)
    r = random.Random(1)
    rows = {("s", "t"): [(f"q{i}", float(r.random() < 0.5), float(r.random() < 0.4)) for i in range(150)],
            ("s", "u"): [(f"q{i}", float(r.random() < 0.5), float(r.random() < 0.5)) for i in range(150)],
            ("t", "u"): [(f"q{i}", r.choice((0.0, 0.63, 1.0)), r.choice((0.0, 0.5, 1.0))) for i in range(97)],
            ("u", "v"): [(f"q{i}", 1.0, 1.0) for i in range(20)]}
    df = spark.createDataFrame([(a, b, *x) for (a, b), xs in rows.items() for x in xs], "a string, b string, qid string, sa double, sb double").repartition(3)
    got = {(x.a, x.b): x.p_value for x in significance.seeded(df, 450, 42).collect()}
    assert got == {k: one_by_one(xs, 450, 42) for k, xs in rows.items()}
