"""Elias-Fano sequences and an n-gram trie of memory-mapped levels (numpy, vectorised queries).

A monotone sequence of n numbers below u keeps l = log2(u / n) low bits of each in a packed array, and the high parts in unary in
a bit vector, with a running count for each 64-bit word. The trie is kept by predicted word: its first level holds
the words, with quantised smoothed log probabilities; pointers (a monotone sequence) lead to a second level, which
holds for each word the words it was seen after, and pointers of these to a third level, which holds for each such pair the words
seen before it. A word's number is stored relative to its parent (parent * words + word), which makes a level one
monotone sequence; a query is a successor search between the parent's pointers.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: position of the k-th one in a byte
_SELECT = np.array([[*np.flatnonzero(b), *[0] * (8 - int(b.sum()))] for b in _BITS], np.uint8)
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


class EliasFano:
    """A sequence of non-decreasing numbers; arrays() and from_arrays() give and take its parts."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.words64 = np.frombuffer(high, "<u8")
        self.counts = ones.astype(np.int64)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - self.counts

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        l = max(0, int(np.log2(max(universe, 1) / n))) if n else 0  # noqa: E741
        bits = np.zeros(n * l + 128, np.uint8)
        for k in range(l):
            bits[k : n * l : l] = (values >> np.uint64(k)) & np.uint64(1)
        size = n + (universe >> l) + 2
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        packed = np.packbits(high, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(high.reshape(-1, 64).sum(axis=1, dtype=np.int64))])
        return cls(n, l, np.packbits(bits, bitorder="little"), packed, ones.astype(np.uint32 if n < 1 << 32 else np.uint64))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l], np.int64), self.low, self.high, self.ones]

    @classmethod
    def from_arrays(cls, head, low, high, ones) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the i-th numbers: eight bytes from the one in which they begin."""
        at = i * self.l
        wide = np.lib.stride_tricks.as_strided(self.low[:8].view("<u8"), (len(self.low) - 7,), (1,))
        return (wide[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def _select(self, i: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the i-th one (or zero) of the high bits: the 64-bit word by the running counts, the byte by sums of all its bytes at once, the bit by a table."""
        counts = self.zeros if zeros else self.counts
        word = np.searchsorted(counts, i, "right") - 1
        rest = (i - counts[word]).astype(np.uint64)
        x = self.words64[word]
        if zeros:
            x = ~x
        s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
        s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH  # each byte: ones up to and with it
        full = ((rest * _EACH) | _TOPS) - s
        place = np.bitwise_count(full & _TOPS).astype(np.uint64) << np.uint64(3)
        before = ((s << np.uint64(8)) >> place) & np.uint64(255)
        return word * 64 + place.astype(np.int64) + _SELECT[((x >> place) & np.uint64(255)).astype(np.int64), (rest - before).astype(np.int64)]

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i) << self.l) | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index in [lo, hi) of the first number >= x, hi if there is none; the sequence must be increasing there."""
        return self._search(x, lo, hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index in [lo, hi) of x, -1 if it isn't there; the sequence must be increasing there."""
        at, stop, low = self._search(x, lo, hi)
        out = np.full(len(at), -1)
        inside = np.flatnonzero(at < stop)
        hit = inside[self._low(at[inside]) == low[inside]]
        out[hit] = at[hit]
        return out

    def _search(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the first number >= x, where the numbers with x's high bits end, and x's low bits."""
        x = np.asarray(x, np.int64)
        bucket = x >> self.l
        # numbers of a bucket lie between the zeros before and after it
        start = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), True) - bucket + 1, 0)
        stop = np.clip(self._select(bucket, True) - bucket, lo, hi)
        low = x.astype(np.uint64) & np.uint64((1 << self.l) - 1)
        a, b = np.clip(start, lo, hi), stop.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            x_, y_ = a[todo], b[todo]
            mid = (x_ + y_) >> 1
            less = self._low(mid) < low[todo]
            x_, y_ = np.where(less, mid + 1, x_), np.where(less, y_, mid)
            a[todo], b[todo] = x_, y_
            todo = todo[x_ < y_]
        return a, stop, low


STEPS = 65_535


def quantise(logp: np.ndarray, least: float) -> np.ndarray:
    """log10 probabilities, none below `least`, as 16-bit codes in steps of -least / 65535."""
    return np.rint(np.clip(logp / least, 0, 1) * STEPS).astype(np.uint16)


def restore(codes: np.ndarray, least: float) -> np.ndarray:
    return codes.astype(np.float64) * (least / STEPS)


class NgramTrie:
    """words: increasing numbers. Level 1: a code for each word w; level 2: for each (w, v) seen, v being the word before w, two codes;
    level 3: a code for each (w, v, u) seen, u being the word before v."""

    def __init__(self, least: float, words: EliasFano, codes: np.ndarray, first: EliasFano, pairs: EliasFano, pair_codes: np.ndarray, after_codes: np.ndarray, second: EliasFano, triples: EliasFano, triple_codes: np.ndarray):
        self.least, self.words, self.codes = least, words, codes
        self.first, self.pairs, self.pair_codes, self.after_codes = first, pairs, pair_codes, after_codes
        self.second, self.triples, self.triple_codes = second, triples, triple_codes
        self.width = max(1, words.n)
        self.top = int(words.get(np.array([words.n - 1]))[0]) if words.n else 0

    @classmethod
    def build(cls, least: float, words: np.ndarray, logp: np.ndarray, pairs: np.ndarray, pair_logp: np.ndarray, after: np.ndarray, triples: np.ndarray, triple_logp: np.ndarray) -> NgramTrie:
        """pairs: w * len(words) + v, increasing; triples: index of the pair * len(words) + u, increasing. All logs lie in [least, 0]."""
        n = max(1, len(words))
        starts = lambda parents, size: np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=size))])
        return cls(
            least, EliasFano.build(words, int(words[-1]) + 1 if len(words) else 1), quantise(logp, least),
            EliasFano.build(starts(pairs // n, len(words)), len(pairs) + 1), EliasFano.build(pairs, n * n), quantise(pair_logp, least), quantise(after, least),
            EliasFano.build(starts(triples // n, len(pairs)), len(triples) + 1), EliasFano.build(triples, max(1, len(pairs)) * n), quantise(triple_logp, least),
        )

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.least]), *self.words.arrays(), self.codes, *self.first.arrays(), *self.pairs.arrays(), self.pair_codes, self.after_codes, *self.second.arrays(), *self.triples.arrays(), self.triple_codes]

    @classmethod
    def from_arrays(cls, a: list[np.ndarray]) -> NgramTrie:
        level = lambda k: EliasFano.from_arrays(*a[k : k + 4])
        return cls(float(a[0][0]), level(1), a[5], level(6), level(10), a[14], a[15], level(16), level(20), a[24])

    def dump(self) -> bytes:
        """One file: a table of types and lengths, then each level's arrays, aligned to 64 bytes."""
        arrays = self.arrays()
        table, at = [], 64 * (1 + len(arrays))
        for x in arrays:
            table.append((x.dtype.str, len(x), at))
            at += -(-(x.nbytes + 8) // 64) * 64
        out = bytearray(at)
        head = f"{len(arrays)} {at}".ljust(63) + "\n" + "".join(f"{t} {n} {p}".ljust(63) + "\n" for t, n, p in table)
        out[: len(head)] = head.encode()
        for (_, _, p), x in zip(table, arrays, strict=True):
            out[p : p + x.nbytes] = x.tobytes()
        return bytes(out)

    @classmethod
    def view(cls, buffer) -> NgramTrie:
        """A trie whose levels are views of the buffer (a memory map)."""
        flat = np.frombuffer(buffer, np.uint8)
        line = lambda k: flat[64 * k : 64 * k + 64].tobytes().decode().split()
        arrays = []
        for k in range(int(line(0)[0])):
            kind, n, at = line(k + 1)
            dtype = np.dtype(kind)
            arrays.append(flat[int(at) : int(at) + int(n) * dtype.itemsize].view(dtype))
        return cls.from_arrays(arrays)

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """Maps a file of dump()'s bytes; levels are read as queries touch them."""
        with open(path, "rb") as f:
            return cls.view(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def mapped(cls, raw: bytes) -> NgramTrie:
        """dump()'s bytes in a file of the task's own, without a name, and mapped from there."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls.view(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Indexes of words; -1 if unknown."""
        n = self.words.n
        if not n:
            return np.full(len(words), -1)
        low, high = np.zeros(len(words), np.int64), np.full(len(words), n)
        inside = np.minimum(words, self.top)
        return np.where(words <= self.top, self.words.find(inside, low, high), -1)

    @staticmethod
    def _child(level: EliasFano, pointers: EliasFano, parent: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
        """Index of each parent's child with that number; -1 where there is none, or parent or number is -1."""
        out = np.full(len(parent), -1)
        ask = np.flatnonzero((parent >= 0) & (number >= 0))
        if level.n and len(ask):
            p, x = parent[ask], parent[ask] * width + number[ask]
            lo, hi = pointers.get(p), pointers.get(p + 1)
            out[ask] = level.find(x, lo, hi)
        return out

    def pair(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Level 2's index of w after v (indexes of words)."""
        return self._child(self.pairs, self.first, w, v, self.width)

    def triple(self, pair: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Level 3's index of the pair after u."""
        return self._child(self.triples, self.second, pair, u, self.width)
