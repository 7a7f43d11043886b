"""The draws of Python's seeded generator (MT19937) from any place on, so that tasks share one stream and each makes its own part of it."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

N, M = 624, 397


def _twist(mt: np.ndarray) -> np.ndarray:
    """The next 624 words before tempering."""
    upper, lower = np.uint32(0x80000000), np.uint32(0x7FFFFFFF)
    mix = lambda u, v: (((u & upper) | (v & lower)) >> np.uint32(1)) ^ ((v & np.uint32(1)) * np.uint32(0x9908B0DF))
    out, k = np.empty(N, dtype=np.uint32), N - M
    out[:k] = mt[M:] ^ mix(mt[:k], mt[1 : k + 1])
    out[k : 2 * k] = out[:k] ^ mix(mt[k : 2 * k], mt[k + 1 : 2 * k + 1])
    out[2 * k : N - 1] = out[k : N - 1 - k] ^ mix(mt[2 * k : N - 1], mt[2 * k + 1 :])
    out[N - 1 :] = out[M - 1 : M] ^ mix(mt[N - 1 :], out[:1])
    return out


def start(seed: int) -> np.ndarray:
    """The words whose successors random.Random(seed) gives."""
    return np.array(random.Random(seed).getstate()[1][:-1], dtype=np.uint32)


@lru_cache(maxsize=1)
def _least() -> tuple[int, tuple[int, ...]]:
    """Degree and lower exponents of the recurrence's polynomial over two elements, from 40,000 bits of a stream (Berlekamp and Massey)."""
    words, rows = start(1), []
    for _ in range(65):
        words = _twist(words)
        rows.append(words & np.uint32(1))
    bits = np.concatenate(rows).tolist()
    c, b, length, gap, past = 1, 1, 0, 1, 0
    for i, bit in enumerate(bits[: 2 * 19937 + 2]):
        past = past << 1 | bit  # the latest bit lowest, as c has its constant
        if (c & past & ((1 << (length + 1)) - 1)).bit_count() & 1:
            kept = c
            c ^= b << gap
            if 2 * length <= i:
                length, b, gap = i + 1 - length, kept, 0
        gap += 1
    return length, tuple(length - e for e in range(1, length + 1) if c >> e & 1)


def _reduced(p: int) -> int:
    degree, lower = _least()
    while high := p >> degree:
        p &= (1 << degree) - 1
        for e in lower:
            p ^= high << e
    return p


def _squared(p: int) -> int:
    raw = np.frombuffer(p.to_bytes((p.bit_length() + 7) // 8 or 1, "little"), dtype=np.uint8)
    wide = np.zeros(16 * len(raw), dtype=np.uint8)
    wide[::2] = np.unpackbits(raw, bitorder="little")
    return _reduced(int.from_bytes(np.packbits(wide, bitorder="little").tobytes(), "little"))


@lru_cache(maxsize=256)
def ahead(words: int) -> np.ndarray:
    """The places of earlier words whose exclusive-or is the word so many further."""
    p = 1
    for bit in bin(words)[2:]:
        p = _squared(p)
        if bit == "1":
            p = _reduced(p << 1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(p.to_bytes((p.bit_length() + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))


def jump(state: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The state after as many words as ahead() was asked for."""
    blocks = [state]
    for _ in range(-(-(_least()[0] + N) // N)):
        blocks.append(_twist(blocks[-1]))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(blocks), N)
    out = np.zeros(N, dtype=np.uint32)
    for k in range(0, len(places), 1024):
        out ^= np.bitwise_xor.reduce(windows[places[k : k + 1024]], axis=0)
    return out


class Stream:
    """Draws as random.random() makes them, from a state on."""

    def __init__(self) -> None:
        self.bits = np.random.MT19937(0)
        self.draws = np.random.Generator(self.bits)

    def at(self, state: np.ndarray) -> None:
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": N}}

    def random(self, out: np.ndarray) -> np.ndarray:
        return self.draws.random(out=out)
