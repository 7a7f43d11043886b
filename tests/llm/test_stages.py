"""The pipeline's stages, and the models of language and quality, against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quire.llm import language, quality, queries, secrets_scan, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __quire_x string"


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def likelihoods(text, table):
    """Log likelihood of a text under each hypothesis, trigram by trigram."""
    b = [c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in (text or "").encode()]
    out = [0.0] * len(table)
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        if (x, y, z).count(32) < 2:
            bucket = (((x << 16) | (y << 8) | z) * 2654435761 % (1 << 32)) >> 16
            for k in range(len(table)):
                out[k] += float(table[k][bucket])
    return out


def fused(rows, model, dependence=0.25, smoothing=8.0):
    """rows (text, declared, host): (language, posterior, accepted) of each."""
    width = len(model.table)
    scores = [[v * dependence for v in likelihoods(t, model.table)] for t, _, _ in rows]
    sums = defaultdict(lambda: [0.0] * width)
    for s, (_, declared, host) in zip(scores, rows, strict=True):
        p = softmax(s)
        for key in [("all", ""), *([("declared", declared)] if declared is not None else []), *([("host", host)] if host is not None else [])]:
            sums[key] = [a + b for a, b in zip(sums[key], p, strict=True)]
    everything = sums["all", ""]
    n = sum(everything)
    prior = [(a + 1) / (n + width) for a in everything]
    out = []
    for s, (_, declared, host) in zip(scores, rows, strict=True):
        total = list(s)
        for k in range(width):
            if declared is not None:
                total[k] += math.log((sums["declared", declared][k] + 0.5 * prior[k]) / (everything[k] + 0.5))
            c = sums["host", host] if host is not None else None
            total[k] += math.log(prior[k] if c is None else (c[k] + smoothing * prior[k]) / (sum(c) + smoothing))
        post = softmax(total)
        best = max(range(width), key=post.__getitem__)
        out.append(([*model.languages, "und"][best], post[best], best < width - 1 and post[best] >= 0.5))
    return out


def corpus():
    r = random.Random(5)
    stock = {"en": "the house and the garden of the king with a long road", "de": "der hund und die katze in dem haus bei der strasse", "fr": "le chien et le chat dans la maison de la rue"}
    rows = []
    for k in range(90):
        lang = r.choice([*stock])
        words = stock[lang].split()
        rows.append((k, " ".join(r.choices(words, k=r.randint(1, 25))), r.choice([lang, lang, lang, "en", None]), r.choice([f"host-{lang}", "Mixed", None]), 1, "x"))
    return [*rows, (200, None, None, None, 0, "x"), (201, "", "de", "host-de", 0, "x"), (202, "0 1 2 #", None, "host-fr", 7, "x"), (203, "\x01\x02", "xx", "new", 2, "x"), rows[3], (204, "zqxj vwkq " * 30, None, None, 1, "x")]


def test_fusion_matches_plain_sums(spark, sf_dir):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train_text_model(docs)
    low = lambda x: None if x is None else x.lower()
    want = fused([(t, low(d), low(h)) for _, t, d, h, _, _ in rows], model)
    found = language.identify(docs, model, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
    pairs = sorted(zip([r[0] for r in rows], want, strict=True), key=str)
    seen = sorted(((x.doc_id, (x.language, x.posterior, x.accepted)) for x in found), key=str)
    assert [(i, w[0], w[2]) for i, w in pairs] == [(i, s[0], s[2]) for i, s in seen]
    assert max(abs(w[1] - s[1]) for (_, w), (_, s) in zip(pairs, seen, strict=True)) < 1e-3
    kept = stages.identify_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, w in pairs if w[2])


def test_language_of_held_out_texts_by_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    held = quality.remainder("doc_id", 5) == 0
    model = language.train_text_model(docs.filter(~held))
    found = language.identify(docs.filter(held), model, text=F.col("text"))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and sum(x.language == x.lang for x in rows) >= 0.95 * len(rows)


def test_pages_take_nulls_and_empty_tables(spark, sf_dir):
    pages = spark.createDataFrame([(1, "http://a.b.de/x", "<html lang=de><p>der hund und die katze</p>"), (2, None, None), (3, "", ""), (4, "nonsense", "<p>the cat")], "page_id long, url string, html string")
    model = language.train_text_model(spark.createDataFrame(corpus(), SCHEMA))
    columns = language.page_columns(F.col("html"), F.col("url"))
    got = {x.page_id: x.language for x in language.identify(pages, model, id_col="page_id", **columns).collect()}
    assert len(got) == 4 and got[1] == "de"
    assert language.identify(pages.limit(0), model, id_col="page_id", **columns).count() == 0


def test_secrets_are_masked_and_the_rest_stays(spark, sf_dir):
    r = random.Random(6)
    plain = "the quick brown fox jumps over the lazy dog".split()
    rows = []
    for k in range(60):
        words = r.choices(plain, k=12)
        if k % 3:
            words.insert(r.randrange(13), r.choice(['password = "hunter2secret"', "AKIA" + "".join(r.choices("ABCDEFGHIJ0123456789", k=16)), "".join(r.choices("0123456789abcdef", k=32)), "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=28))]))
        rows.append((k, " ".join(words), "en", "s", 5, "x"))
    rows += [(100, None, "en", "s", 0, "x"), (101, "", "en", "s", 0, "x"), rows[1], (102, "word " * 60_000 + "token: abcdef123456", "en", "s", 1, "x")]
    got = {}
    docs = spark.createDataFrame(rows, SCHEMA)
    masked = stages.secret_scan(spark, docs, sf_dir)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    for x in masked.collect():
        got.setdefault(x.doc_id, []).append((x.text, x.n_chars))
    secret = re.compile(r'password = "\w+|AKIA[A-Z0-9]{16}|token: \w+|\b(?=\S*\d)[A-Za-z0-9]{20,}\b')
    for i, t, *_ in rows:
        want = None if t is None else secret.sub("[secret]", t)
        assert got[i][0][0] == want
        assert got[i][0][1] == (len(want) if want != t else next(n for j, _, _, _, n, _ in rows if j == i))


def test_mixing_matches_its_sql(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([x for x in corpus() if x[0] != 3], SCHEMA)
    docs.drop("__quire_x").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(queries.OP7_SQL)
    names = [c[0] for c in cursor.description]
    told = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    want = sorted((told(x) for x in cursor.fetchall()), key=str)
    assert sorted((told(x) for x in stages.mix_sources(spark, docs, sf_dir).select(*names).collect()), key=str) == want and want


def plain_tree(g, h, reg):
    """Leaf of each bin: all pairs of cuts in the order the operator takes them, by sums of lists."""
    gain = lambda lo, hi: sum(g[lo:hi]) ** 2 / (sum(h[lo:hi]) + reg)

    def cut(lo, hi):
        if hi - lo < 2:
            return 0.0, hi
        gains = [gain(lo, k) + gain(k, hi) - gain(lo, hi) for k in range(lo + 1, hi)]
        return max(gains), lo + 1 + gains.index(max(gains))

    _, first = cut(0, len(g))
    left, right = cut(0, first), cut(first, len(g))
    second = left if left[0] >= right[0] else right
    out = [0.0] * len(g)
    bounds = sorted({0, first, second[1], len(g)})
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for k in range(lo, hi):
            out[k] = sum(g[lo:hi]) / (sum(h[lo:hi]) + reg)
    return out


def test_boosting_matches_plain_loops():
    r = np.random.default_rng(3)
    x = np.round(r.random((80, 3)) * 6)
    y = ((x[:, 0] > 3) ^ (r.random(80) < 0.2)).astype(float)
    model = quality.fit(x, y, bins=6, rounds=4, pair_rounds=0, pairs=0)
    share = y.mean()
    total = [math.log((share + 1e-3) / (1 - share + 1e-3))] * 80
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    place = [[sum(v >= e for e in model.edges[k]) for v in x[:, k]] for k in range(3)]
    for _ in range(4):
        for k in range(3):
            p = [1 / (1 + math.exp(-t)) for t in total]
            g, h = [0.0] * len(tables[k]), [0.0] * len(tables[k])
            for i in range(80):
                g[place[k][i]] += y[i] - p[i]
                h[place[k][i]] += p[i] * (1 - p[i])
            leaves = plain_tree(g, h, 4.0)
            tables[k] = [a + 0.1 * b for a, b in zip(tables[k], leaves, strict=True)]
            total = [t + 0.1 * leaves[place[k][i]] for i, t in enumerate(total)]
    for a, b in zip(model.tables, tables, strict=True):
        assert np.allclose(a, b, atol=1e-9)
    want = [1 / (1 + math.exp(-t)) for t in total]
    assert np.allclose(model.score(x), want, atol=1e-9)


def test_pairs_catch_an_interaction_that_features_alone_miss():
    r = np.random.default_rng(4)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    right = ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean()
    alone = ((quality.fit(x[:2000], y[:2000], pairs=0).score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean()
    assert (0, 1) in model.pairs and right > 0.9 > 0.7 > alone


def test_a_single_kind_of_label_gives_its_share():
    for label in (0.0, 1.0):
        model = quality.fit(np.random.default_rng(1).random((20, 2)), np.full(20, label))
        assert np.allclose(model.score(np.zeros((2, 2))), label, atol=1.1e-3)
    assert secrets_scan.MarkovPair.train([]).score(b"abc") == 0.0
