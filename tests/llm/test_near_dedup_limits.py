"""What near-dedup sends and holds: parities only of sets with one near by, texts once, little memory for a dense group."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quire.llm import simhash


def dense(r, n):
    """Fingerprints of which any two are within 36 bits."""
    values = np.repeat(r.integers(0, 1 << 63, (1, 2), dtype=np.uint64), n, axis=0)
    for _ in range(6):
        values[:, 1] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    return values


def test_a_dense_group_takes_little_memory():
    r = np.random.default_rng(2)
    values = dense(r, 6000)
    odd, n = r.integers(0, 1 << 63, (6000, 16), dtype=np.uint64), np.full(6000, 100)
    fits = simhash.possible(n, odd, 0.8)
    everything = lambda i, j: fits(i, j) | True
    tracemalloc.start()
    try:
        a, _ = simhash.tile_links(values, values[:0], 36, everything, simhash.FORESTS)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert len(a) <= 3 * 5999 and peak < 220, peak


def test_near_links_connect_what_pairs_connect():
    r = np.random.default_rng(3)
    values = np.concatenate([dense(r, 40 + 10 * k) for k in range(5)] + [r.integers(0, 1 << 63, (200, 2), dtype=np.uint64)])[r.permutation(500)]
    n = r.integers(50, 100, 500)
    fits = simhash.comparable(n, 0.8)
    i, j = np.triu_indices(500, 1)
    near = (np.bitwise_count(values[i] ^ values[j]).sum(axis=1) <= 36) & ~((i >= 350) & (j >= 350)) & fits(i, j)
    _, want = simhash.forest(500, i[near], j[near], np.zeros(near.sum(), np.uint8))
    a, b = simhash.near_links(values[:350], values[350:], 36, fits, side=20)
    keep, got = simhash.forest(500, a, b, np.zeros(len(a), np.uint8))
    assert len(keep) == len(a) and (got == want).all()


def test_only_sets_with_one_near_by_are_sent_with_parities(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(200)]
    texts += [t.replace(t.split()[60], "changed") for t in texts[:20]]
    rows = simhash.set_prints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    for tile_rows in (16, 32, 10**6):
        near = simhash.placed(rows, simhash.clusters(rows, tile_rows=tile_rows), 0.8, tile_rows)
        assert near.count() == 40
        pairs = {frozenset((x.a, x.b)) for x in simhash.candidates(near, tile_rows=tile_rows).collect()}
        ids = {x.key: x.id for x in rows.collect()}
        assert {frozenset(ids[k] for k in p) for p in pairs} == {frozenset((k, 200 + k)) for k in range(20)}


def test_marked_rows_are_all_there_and_few_others(spark):
    rows = spark.range(20_000).withColumn("mark", F.xxhash64("id"))
    got = {x.id for x in simhash.marked(rows, rows.filter("id % 10 = 0").select("mark")).select("id").collect()}
    assert {k for k in range(0, 20_000, 10)} <= got and len(got) < 2_050


def test_texts_of_the_result_are_sent_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "a b c"), (None, "a b c"), (2, "d"), (2, "d"), (None, "e"), (None, "e")], "doc_id long, text string")
        kept = simhash.keep_one(df)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # of the kept keys and of the texts
        assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == [(0, "e"), (1, "a b c"), (2, "d")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
