"""The sampled test takes its signs from real MD5 digests, many at once; metrics meet gold once a query."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quire.operators import metrics, significance


def test_heads_are_md5():
    texts = [b"", b"q1", "ü9".encode(), *(b"x" * n for n in range(40, 70)), *(f"1-URGENT:{i}".encode() for i in range(500))]
    heads = significance.Heads(texts)
    for before in (b"42:7:", b"42:166:", b"1:33:", b""):
        assert heads.after(before).tolist() == [int.from_bytes(hashlib.md5(before + t).digest()[:8], "big") for t in texts]


def test_monte_carlo_is_the_sums_of_its_signs(spark):
    r = random.Random(3)
    rows = [("s", "t", f"q{i}", float(r.random() < 0.6), float(r.random() < 0.5)) for i in range(120)] + [("s", "u", f"q{i}", r.random(), r.choice((0.0, 0.5))) for i in range(90)] + [("t", "u", "q1", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, qid string, sa double, sb double").repartition(3)
    for x in significance.monte_carlo(df, 130).collect():
        d = [(q, sa - sb) for a, b, q, sa, sb in rows if (a, b) == (x.a, x.b) and sa != sb]
        hits = 0
        for i in range(130):
            sign = lambda q: int(hashlib.md5(f"42:{i // 60}:{q}".encode()).hexdigest()[:15], 16) >> (i % 60) & 1  # noqa: B023, E731
            hits += abs(sum(v if sign(q) else -v for q, v in d)) >= abs(sum(v for _, v in d)) - 1e-9
        assert x.p_value == (round((hits + 1) / 131, 4) if d else 1.0)


def test_predictions_meet_gold_once_a_query(spark):
    gold = spark.createDataFrame([("b", "q1", "A"), ("b", "q2", "B"), (None, "q3", "C")], "book_id string, qid string, docid string")
    runs = spark.createDataFrame([("s", 0, "b", "q1", ["A"]), ("t", 1, "b", "q1", ["X", "A"]), ("s", 0, "b", "q2", ["X", "Y", "B"]), ("z", 2, "b", "q1", ["A"])], "system string, sys_seq int, book_id string, qid string, ranked array<string>")
    names = [("s", 0), ("t", 1)]
    want = metrics.evaluate(runs.drop("sys_seq"), metrics.for_systems(gold, names).drop("sys_seq"), ["system"])
    got = metrics.evaluate(runs, gold, ["system"], systems=names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    scores = metrics.per_query(runs, gold.filter("book_id is not null"), ["system", "sys_seq", "book_id", "qid"], systems=names)
    paired = significance.pairs(scores, ["book_id", "qid"])
    assert sorted((r.a, r.b, r.qid, r.sa, r.sb) for r in paired.collect()) == [("s", "t", "b:q1", 1.0, 0.0), ("s", "t", "b:q2", 0.0, 0.0)]
    assert paired.filter(F.col("a_seq") >= F.col("b_seq")).count() == 0
