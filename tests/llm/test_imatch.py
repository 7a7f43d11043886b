"""I-Match against definitions written out by themselves."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import imatch

SCHEMA = "doc_id long, text string, block string"
MASK = (1 << 64) - 1


def words(r, n, size=40):
    return " ".join("w" + str(int(r.paretovariate(0.7)) % size) for _ in range(n))


def keeps(draw: int, term: int, level: int) -> bool:
    """Does that random draw of the lexicon keep the term at that level?"""
    x = ((term ^ xxhash.xxh64_intdigest(f"draw {draw}", 11)) * 0x9E3779B97F4A7C15) & MASK
    x ^= x >> 32
    x = (x * 0xD6E8FEB86659FD93) & MASK
    x ^= x >> 32
    return x % 2**level == 0


def by_hand(text: str, lexicon: set[int]) -> list[list[bytes]]:
    """The terms of each level and draw, sorted by hash; [] for a text without a lexicon term."""
    own = sorted({h for w in text.encode().lower().split() if (h := xxhash.xxh64_intdigest(w, 11)) in lexicon})
    return [[b"".join(h.to_bytes(8, "little") for h in own if keeps(k, h, level)) for k in range(16)] for level in range(10)] if own else []


def alike(a: str, b: str, lexicon: set[int]) -> float:
    if {*a.encode().lower().split()} == {*b.encode().lower().split()}:
        return 1.0
    x, y = by_hand(a, lexicon), by_hand(b, lexicon)
    if x == y and x:
        return 1.0
    best = 0.0
    for p, q in zip(x, y, strict=False) if x and y else ():
        if 2 * sum(map(bool, p)) >= 16 and 2 * sum(map(bool, q)) >= 16:
            best = max(best, sum(i == j and i != b"" for i, j in zip(p, q, strict=True)) / sum(bool(i or j) for i, j in zip(p, q, strict=True)))
    return best


def test_edited_fingerprints(spark):
    r = random.Random(1)
    rows = [(k * 3 % 101, words(r, r.randint(0, 200), 3000), "clash") for k in range(90)] + [(500, None, ""), (501, "", ""), (3, "twin é", ""), (3, "twin é", ""), (None, "no id", ""), (None, None, ""), (600, words(r, 30_000, 3000), "")]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = Counter(w for _, t, _ in rows for w in set((t or "").encode().lower().split()))
    n = len(rows)
    lexicon = {xxhash.xxh64_intdigest(w, 11) for w, c in counts.items() if max(2, 0.01 * n) <= c <= 0.5 * n}
    model = imatch.IMatch(imatch.lexicon(df, n, least_share=0.01, most_share=0.5))
    assert set(model.terms.tolist()) == lexicon
    got = imatch.edited_fingerprints(df, model, group_chars=3000).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited, lexicon), 9), round(alike(t, following, lexicon), 9)))
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in got) == sorted(want)
    prints = {}
    for x in got:
        prints.setdefault(x.fingerprint, set()).add(x.doc_id)
    assert {500, 501, None} <= prints["x"] and max(len(v) for v in prints.values()) == 3
    long = [x for x in got if x.n_chars > 300]
    assert np.mean([x.near_edited for x in long]) > np.mean([x.near_next for x in long]) + 0.2
    assert imatch.edited_fingerprints(df.limit(0), model).count() == 0 and len(imatch.lexicon(df.limit(0), 0)) == 0


def test_lexicon_is_the_band_and_its_size_is_checked(spark):
    r = random.Random(2)
    texts = [words(r, 60, 200) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(w for t in texts for w in set((t or "").encode().split()))
    want = sorted(xxhash.xxh64_intdigest(w, 11) for w, c in counts.items() if 5.2 <= c <= 20.8)
    assert imatch.lexicon(df, 52, least_share=0.1, most_share=0.4).tolist() == want
    with pytest.raises(ValueError, match="none is left out"):
        imatch.lexicon(df, 52, least_share=0.1, most_share=0.4, most_terms=len(want) - 1)


def test_reduced_lexicons_are_nested_and_half_each():
    model = imatch.IMatch(np.arange(1, 40_000, dtype=np.uint64))
    levels = model.levels(model.terms)
    for level in range(1, 9):
        share = (levels >= level).mean(axis=1)
        assert (abs(share * 2**level - 1) < 0.2).all()
