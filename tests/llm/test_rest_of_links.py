"""Near copies whose link no forest holds, and the rounds in which the rest of the pairs is taken."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quire.llm import simhash


def similarity(p, q):
    both = len(np.intersect1d(p, q))
    return both / (len(p) + len(q) - both)


def crowded():
    """Two texts of similarity 0.8 or more, and others nearer to both by fingerprint, of which no two, and none with these, are similar by 0.8."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(150)]

    def variant(lo, hi):
        words = list(base)
        for k in r.sample(range(len(words)), r.randint(lo, hi)):
            words[k] = f"x{r.randrange(10**9)}"
        return " ".join(words)

    made = lambda text: (text, simhash.shingle_set(text.encode()))
    far = lambda p, q: int(np.bitwise_count(p ^ q).sum())
    first = made(" ".join(base))
    prints = lambda rows: simhash.wide_prints([s for _, s in rows])
    partners = [x for x in map(made, (variant(2, 4) for _ in range(600))) if similarity(first[1], x[1]) >= 0.8]
    at = prints([first, *partners])
    distance, second = max((far(at[0], p), k) for k, p in enumerate(at[1:]) if far(at[0], p) <= 36)
    rows = [first, partners[second]]
    ends = prints(rows)
    for other in map(made, (variant(3, 5) for _ in range(6000))):
        p = prints([other])[0]
        if max(far(p, ends[0]), far(p, ends[1])) < distance and all(similarity(other[1], s) < 0.8 for _, s in rows):
            rows.append(other)
        if len(rows) == 14:
            break
    assert len(rows) == 14
    return rows


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 4, "most": 1}])
def test_a_link_that_no_forest_holds_is_found(spark, sizes):
    rows = crowded()
    values = simhash.wide_prints([s for _, s in rows])
    forests = {frozenset(x) for x in zip(*[v.tolist() for v in simhash.tile_links(values, values[:0], 36, None, simhash.FORESTS)], strict=True)}
    assert frozenset((0, 1)) not in forests
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.keep_one(df, **sizes).collect()) == [0, *range(2, 14)]


def test_rounds_take_each_pair_of_different_labels_once():
    r = np.random.default_rng(4)
    values = r.integers(0, 1 << 63, (6, 2), dtype=np.uint64)[r.integers(0, 6, 400)]
    for _ in range(10):
        values[:, 0] ^= np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)
    label = r.integers(0, 5, 400)
    want = [{i, j} for i in range(250) for j in range(i + 1, 400) if label[i] != label[j] and np.bitwise_count(values[i] ^ values[j]).sum() <= 14]
    got, start, calls = [], 0, 0
    while start >= 0:
        a, b, start = simhash.parted_pairs(values[:250], values[250:], label, 14, start=start, most=100, side=20)
        got += [{i, j} for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        calls += 1
    assert calls > 5 and sorted(map(sorted, got)) == sorted(map(sorted, want))


def test_parities_refuse_no_similar_pair():
    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)
    sets = [draw(0), draw(1)]
    for n in (5, 60, 63, 66, 130, 700, 40_000):
        sets.append(base := draw(n))
        sets += [np.unique(np.concatenate([base[: n - k], draw(k * m)])) for k in range(0, max(2, n // 3), max(1, n // 30)) for m in (0, 1)]
    n = np.array([len(s) for s in sets])
    fits = simhash.possible(n, simhash.parity_rows([simhash.parities(s) for s in sets]), 0.8)
    i, j = np.triu_indices(len(sets), 1)
    similar = np.array([2 * len(np.intersect1d(sets[a], sets[b])) * 0.9 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9 for a, b in zip(i, j, strict=True)])
    kept = fits(i, j)
    assert similar.sum() > 100 and kept[similar].all()
    alone = np.array([simhash.possible(n[[a, b]], simhash.parity_rows([simhash.parities(sets[a]), simhash.parities(sets[b])]), 0.8)(np.array([0]), np.array([1]))[0] for a, b in zip(i, j, strict=True)])
    assert alone[similar].all() and not alone[~similar].all()
