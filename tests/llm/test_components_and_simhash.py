from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from quire.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=3):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = {}
    for i, at in enumerate(label):
        if ids[i] is not None:
            out[at] = min(out.get(at, ids[i]), ids[i])
    return [out.get(at) for at in label]


def texts(n=120, seed=2):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "ÉTÉ", "the", "of", "a\tb"]
    out = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(n)]
    out += [out[k] for k in range(0, n, 7)] + ["", None, "  \n", "one", "One", "one two", "w " * 60_000, "w " * 60_000 + "x"]
    for k in range(0, n, 9):
        out.append(out[k] + " tail")
    return out


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    rows += [(None, "alone without an id", "x"), rows[3], (5000, rows[5][1], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _, _), p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("tile_rows", [8, 4096])
def test_forest_links_what_all_pairs_link(spark, tile_rows):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base[:30]:
        for _ in range(12):
            v = int(b)
            for bit in r.integers(0, 64, r.integers(1, 4)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.link_forest(df, 3, tile_rows).collect()
    find = {v: v for v in values}

    def root(x):
        while find[x] != x:
            x = find[x]
        return x

    for a, b in links:
        a, b = a % (1 << 64), b % (1 << 64)
        assert bin(a ^ b).count("1") <= 3 * 4
        find[root(a)] = root(b)
    own = {v: root(v) for v in values}
    want = brute_components(list(range(len(values))), values)
    assert len({(own[v], c) for v, c in zip(values, want, strict=True)}) == len(set(own.values())) == len(set(want))


def test_components_of_chains_and_rings(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 199), (200, 199), (None, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = [(2, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "a b c d", "z"), (3, "quite another text here", "x"), (None, "no id at all, ever", "x"), (None, "no id at all, ever", "x"), (4, None, "x"), (5, "", "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.doc_id is not None and r.text) == [("1", "a b c d"), ("3", "quite another text here")]
    assert [r.doc_id for r in kept if not r.text] == [4] and [r.text for r in kept if r.doc_id is None] == ["no id at all, ever"]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
