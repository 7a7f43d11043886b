"""Prefix-free parsing: rolling-hash triggers cut texts into phrases; suffix arrays of the dictionary and of the parse combine into corpus order.

A trigger is a place where the hash of the next `window` bytes is 0 modulo `modulus`. A phrase runs from one trigger to the end of the
next one's window, so neighbours overlap by `window` bytes and no phrase that ends in a trigger is a prefix of another. A suffix of
the text is then ordered first by the rest of its phrase (a suffix of the dictionary), then by the phrases after it
(a suffix of the parse). Repeated text has repeated phrases: the dictionary stays small.
"""

from __future__ import annotations

import numpy as np

PRIME = 0x100000001B3


def mix_bytes(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def mix_words(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes (len - k + 1 of them), by doubling: k = 2^a + ... is put together from halves."""
    if len(b) < k:
        return np.zeros(0, np.uint64)
    power, width = mix_bytes(b), 1
    out, done = None, 0
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:
                n = min(len(out), len(power) - done)
                out = out[:n] * np.uint64(pow(PRIME, width, 1 << 64)) + power[done : done + n]
                done += width
        if done == k:
            break
        power = power[:-width] * np.uint64(pow(PRIME, width, 1 << 64)) + power[width:]
        width *= 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal keys share one."""
    return np.unique(keys, return_inverse=True)[1] + 1


def _double(rank: np.ndarray, left: np.ndarray, first: int, depth: int) -> np.ndarray:
    """Ranks of suffixes from ranks of their first `first` items, by doubling; left: items up to each suffix's end; at least `depth` items count."""
    reach = first
    n = len(rank)
    while reach < depth and (left > reach).any():
        after = np.zeros(n, np.int64)
        more = np.flatnonzero(left > reach)
        after[more] = rank[more + reach]
        rank = _dense(rank.astype(np.uint64) * np.uint64(n + 1) + after.astype(np.uint64))
        reach *= 2
    return rank


class PrefixFreeParse:
    """texts: concatenated bytes and their offsets (len + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = 6, modulus: int = 12):
        self.data, self.offsets = data, offsets
        h = rolling(data, window)
        hit = np.flatnonzero(h % np.uint64(modulus) == 0)
        text = np.searchsorted(offsets, hit, "right") - 1
        hit = hit[(hit + window <= offsets[text + 1]) & (hit > offsets[text])]
        starts = np.unique(np.concatenate([hit, offsets[:-1][np.diff(offsets) > 0]]))
        text = np.searchsorted(offsets, starts, "right") - 1
        last = np.ones(len(starts), bool)  # of its text
        last[:-1] = text[1:] != text[:-1]
        stops = np.where(last, offsets[text + 1], np.concatenate([starts[1:], [0]]) + window)
        self.starts, self.last = starts, last
        whole = data.tobytes()
        seen: dict[tuple[bytes, bool], int] = {}
        self.parse = np.array([seen.setdefault((whole[a:b], z), len(seen)) for a, b, z in zip(starts.tolist(), stops.tolist(), last.tolist(), strict=True)], np.int64)
        self.phrases = list(seen)

    def dictionary_ranks(self, depth: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every suffix of the phrases used (equal ones share it), by its first `depth` bytes at least; where each phrase begins."""
        texts = [self.phrases[k][0] for k in used.tolist()]
        lengths = np.array([len(p) for p in texts])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        left = np.repeat(begins[1:], lengths) - np.arange(len(flat))
        padded = np.concatenate([flat, np.zeros(7, np.uint8)])
        key = np.zeros(len(flat), np.uint64)
        for k in range(7):
            key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + len(flat)], 0).astype(np.uint64)
        key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
        at = np.zeros(len(self.phrases), np.int64)
        at[used] = begins[:-1]
        return _double(_dense(key), left, 7, depth), at

    def parse_ranks(self, depth: int) -> np.ndarray:
        """Rank of the parse's suffix at each phrase; texts end the sequence. A phrase adds a byte at least, so `depth` phrases hold as many bytes."""
        order = sorted(range(len(self.phrases)), key=self.phrases.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        ends = np.flatnonzero(self.last)
        left = ends[np.searchsorted(ends, np.arange(len(self.parse)))] + 1 - np.arange(len(self.parse))
        return _double(rank[self.parse], left, 1, depth)

    def order(self, positions: np.ndarray, depth: int) -> np.ndarray:
        """positions sorted by the text that follows; positions with the same `depth` bytes are neighbours."""
        phrase = np.searchsorted(self.starts, positions, "right") - 1
        dictionary, at = self.dictionary_ranks(depth, np.unique(self.parse[phrase]))
        parse = self.parse_ranks(depth)
        own = dictionary[at[self.parse[phrase]] + positions - self.starts[phrase]]
        after = np.where(self.last[phrase], 0, parse[np.minimum(phrase + 1, len(parse) - 1)])
        return positions[np.argsort(own.astype(np.uint64) * np.uint64(len(parse) + 2) + after.astype(np.uint64), kind="stable")]


def same_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at a and at b are equal, exactly; length is 8 at least."""
    wide = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= wide[a + k] == wide[b + k]
    return same
