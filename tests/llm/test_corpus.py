"""Operators over the whole corpus: fingerprints, language model, mixing, repeats, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import mixing, pfp, suffix_dedup

SCHEMA = "doc_id long, text string, block string"


def test_mixing(spark):
    rows = [(i, "w " * (i % 40 + 1), "big" if i % 3 else f"s{i % 5}") for i in range(600)] + [(700, None, "empty"), (701, "", None), (0, "w", "s0"), (None, "w w", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit("clash"))
    got = mixing.mix(df, entropy_share=0.99, block_tokens=100).toPandas()
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len((t or "").split())
    whole, named = sum(totals.values()), {s: t for s, t in totals.items() if t}
    best = None
    for k in range(100_001):
        a = k / 100_000
        z = sum((t / whole) ** a for t in named.values())
        w = {s: (t / whole) ** a / z for s, t in named.items()}
        if -sum(x * math.log(x) for x in w.values()) >= 0.99 * math.log(len(named)):
            best = w
    drawn = got.groupby("source", dropna=False).n_tokens.sum()
    for s, w in best.items():
        assert abs(got[got.source == s].weight.iloc[0] - w) < 1e-4
        assert w * whole - 80 <= drawn[s] <= w * whole + 1e-6
    per_doc = got[got.source == "s1"].groupby("doc_id").size()
    assert per_doc.max() - per_doc.min() <= 1 and set(got[got.source == "empty"].doc_id) == {700}
    assert (got["at"] <= 1 + 1e-9).all()
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_the_repetition_limit(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i else "b") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(df, entropy_share=1.0, most_repeats=5.0, block_tokens=50).toPandas()
    assert got[got.source == "b"].shape[0] in (4, 5)


def test_prefix_free_order():
    r = np.random.default_rng(0)
    for _ in range(15):
        pool = [bytes(r.integers(97, 100, r.integers(1, 9)).astype(np.uint8)) for _ in range(12)]
        texts = [b"".join(pool[k] for k in r.integers(0, 12, r.integers(0, 60))) for _ in range(20)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        order = pfp.PrefixFreeParse(data, off).order(np.arange(len(data)), 50)
        heads = [bytes(data[a : min(a + 50, b)]) for a, b in zip(order, off[np.searchsorted(off, order, "right")], strict=True)]
        assert heads == sorted(heads)


def test_least_ids_do_not_depend_on_parts():
    r = np.random.default_rng(3)
    pool = [bytes(r.integers(97, 99, 80).astype(np.uint8)) for _ in range(20)]
    sent = []
    for _ in range(4):
        own = sorted({(int(k), pool[k][: r.integers(50, 80)]) for k in r.integers(0, 20, 40)})
        sent.append([np.array([h for h, _ in own], np.uint64), np.array([len(t) for _, t in own], np.uint32), r.integers(0, 50, len(own)), np.frombuffer(b"".join(t for _, t in own), np.uint8)])
    whole = suffix_dedup.least_ids(sent, 50)
    for part in (1, 7, 1000):
        assert all((a == b).all() for x, y in zip(whole, suffix_dedup.least_ids_in_parts(sent, 50, part), strict=True) for a, b in zip(x, y, strict=True))


def brute_repeats(rows, length=50):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t in sorted(rows, key=lambda x: key(x[0])):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], key(i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(t)))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    r = random.Random(7)
    line = lambda n: "".join(r.choices("abé \n", k=n))
    shared = [line(k) for k in (49, 50, 51, 120, 700)]
    rows = []
    for k in range(150):
        body = [line(r.randint(0, 90)) for _ in range(3)]
        if k % 3:
            body.insert(r.randint(0, 3), r.choice(shared))
        if k % 10 == 0:
            body = ["ab " * r.randint(10, 200)]
        rows.append((k, "".join(body), "clash"))
    rows += [(200 + k, rows[k][1], "") for k in range(0, 150, 11)] + [(None, rows[4][1], ""), (None, rows[4][1], ""), (3, rows[4][1] + rows[3][1], ""), (300, None, ""), (301, "", ""), (302, "q" * 3000, ""), (303, "q" * 90, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_repeats([(i, (t or "").encode()) for i, t, _ in rows])
    for block_bytes, anchors in ((3000, 300), (10**9, 10**9)):
        got = suffix_dedup.remove_repeats(df, block_bytes=block_bytes, shard_anchors=anchors).collect()
        assert sorted((str(x.doc_id), *x[1:]) for x in got) == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    assert counts[3] < counts[2] and counts[4] == counts[3]
    assert docs.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_pipeline_takes_nulls_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "token = abcdefgh12345 here", "en", "a", 26), (2, None, None, None, None), (None, "", "en", "a", 0), (1, "token = abcdefgh12345 here", "en", "a", 26)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
            df.count()
