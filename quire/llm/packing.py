"""Arrays packed into one compressed value, for rows that carry many numbers."""

from __future__ import annotations

import numpy as np
import zstandard

_TYPES = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i8", "f8")]


def pack(arrays: list[np.ndarray]) -> bytes:
    """Numbers byte by byte: all first bytes, then all second ones, which compresses better."""
    head = np.array([len(arrays), *[len(x) for x in arrays], *[_TYPES.index(x.dtype) for x in arrays]], np.int64).tobytes()
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if x.itemsize > 1 else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * k + 1)
    at, out = 8 * (2 * k + 1), []
    for n, kind in zip(head[1 : k + 1].tolist(), head[k + 1 :].tolist(), strict=True):
        size = _TYPES[kind].itemsize
        flat = np.frombuffer(raw, np.uint8, n * size, at)
        out.append(flat if size == 1 else np.ascontiguousarray(flat.reshape(size, n).T).view(_TYPES[kind])[:, 0])
        at += n * size
    return out


def smallest(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
