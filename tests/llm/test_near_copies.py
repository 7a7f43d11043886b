from __future__ import annotations

import random

import numpy as np

from quire.llm import simhash, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows, least=0.8, size=5):
    """Kept (id, text) of the rows: connected pairs of sets of word tuples by all comparisons."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links += sets[i] != sets[j]
                label[root(i)] = root(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    return [{rows[k][0] for k in g} for g in groups.values()], links


def near_copies_of(r, n_base=60):
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for _ in range(n_base):
        text = r.choices(words, k=r.randint(3, 260))
        rows.append((len(rows), " ".join(text)))
        for _ in range(r.randint(0, 3)):
            copy = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 60))):
                k = r.randrange(len(copy))
                copy[k : k + r.randint(0, 2)] = [r.choice(words)]
            rows.append((len(rows), " ".join(copy)))
    boiler = r.choices(words, k=30)
    rows += [(len(rows) + k, " ".join(boiler + r.choices(words, k=12))) for k in range(60)]
    rows += [(len(rows), None), (len(rows) + 1, "  "), (len(rows) + 2, "One two"), (len(rows) + 3, "one  TWO")]
    return rows


def test_stage_keeps_one_of_all_copies_of_similarity_eight_tenths(spark, sf_dir):
    rows = near_copies_of(random.Random(8))
    groups, links = brute_kept(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in stages.near_dedup(spark, df, sf_dir).collect())
    assert links > 40 and kept == sorted(min(g) for g in groups)


def test_tiles_have_no_say(spark):
    rows = near_copies_of(random.Random(9), 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(min(g) for g in brute_kept(rows)[0])
    for tile_rows in (7, 10**6):
        assert sorted(r.doc_id for r in simhash.keep_one(df, tile_rows=tile_rows).collect()) == want


def test_forest_has_least_distances():
    r = np.random.default_rng(5)
    n = 60
    i, j = r.integers(0, n, 900), r.integers(0, n, 900)
    d = r.integers(0, 9, 900)
    kept, label = simhash.forest(n, i, j, d.astype(np.uint8))
    assert len(set(label.tolist())) == n - len(kept)

    def count(pairs):
        label = list(range(n))

        def root(k):
            while label[k] != k:
                k = label[k]
            return k

        for a, b in pairs:
            label[root(a)] = root(b)
        return len({root(k) for k in range(n)})

    for most in range(9):  # at each distance the forest connects what all pairs connect, without a circle
        own = [(i[k], j[k]) for k in kept if d[k] <= most]
        assert count(own) == count([(i[k], j[k]) for k in range(900) if d[k] <= most]) == n - len(own)


def test_a_large_group_sends_few_links():
    r = np.random.default_rng(6)
    values = np.repeat(r.integers(0, 1 << 63, (1, 2), dtype=np.uint64), 1500, axis=0)
    values[:, 0] ^= np.uint64(1) << r.integers(0, 64, 1500).astype(np.uint64)
    assert len(simhash.tile_links(values, values[:0], 36, at_once=5000)[0]) == 1499


def test_early_reduction_changes_no_distance_of_the_forest():
    r = np.random.default_rng(7)
    centres = r.integers(0, 1 << 63, (8, 2), dtype=np.uint64)
    values = centres[r.integers(0, 8, 900)]
    for _ in range(14):
        values[:, 0] ^= (np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)) * (r.random(900) < 0.6).astype(np.uint64)
    distance = lambda a, b: sorted(np.bitwise_count(values[a] ^ values[b]).sum(axis=1).tolist())
    want = distance(*simhash.tile_links(values[:600], values[600:], 30, side=2000, at_once=10**9))
    assert len(want) > 800
    assert distance(*simhash.tile_links(values[:600], values[600:], 30, side=50, at_once=300)) == want


def test_more_forests_are_disjoint_and_each_connects_what_is_left():
    r = np.random.default_rng(8)
    values = r.integers(0, 1 << 63, (1, 1), dtype=np.uint64) ^ (np.uint64(1) << r.integers(0, 64, (120, 1)).astype(np.uint64))
    values = np.unique(values, axis=0)
    n = len(values)
    a, b = simhash.tile_links(values, values[:0], 3, forests=3, side=10, at_once=50)
    pairs = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
    # all distances are equal: each forest is a star, whose hub has no link left for the next one
    assert len(pairs) == len(a) == (n - 1) + (n - 2) + (n - 3)


def test_a_link_beside_a_nearer_pair_that_fails_is_kept():
    """Three texts: one has a partner of similarity 0.8, and a third text with a nearer fingerprint, but less similar."""
    found = None
    for seed in range(4000):
        r = np.random.default_rng(seed)
        base = r.integers(0, 1 << 64, 40, dtype=np.uint64, endpoint=False)
        sets = [base, np.concatenate([base[:36], r.integers(0, 1 << 64, 4, dtype=np.uint64, endpoint=False)]), np.concatenate([base[:30], r.integers(0, 1 << 64, 10, dtype=np.uint64, endpoint=False)])]
        p = simhash.wide_prints(sets)
        d = [int(np.bitwise_count(p[i] ^ p[j]).sum()) for i, j in ((0, 1), (0, 2), (1, 2))]
        if d[1] < d[0] and d[2] < d[0] <= 36:
            found = p
            break
    assert found is not None
    links = {frozenset(x) for x in zip(*[v.tolist() for v in simhash.tile_links(found, found[:0], 36, None, simhash.FORESTS)], strict=True)}
    assert frozenset((0, 1)) in links and frozenset((0, 1)) not in {frozenset(x) for x in zip(*[v.tolist() for v in simhash.tile_links(found, found[:0], 36)], strict=True)}
