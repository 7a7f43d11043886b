"""SimHash near-dedup (operator 6): tiled exact comparison with exclusive-or and bit counts.

A fingerprint has a bit set if over half of the text's shingle hashes have it set. Distinct fingerprints are dealt
into tiles by the population counts of their four 16-bit lanes. Two fingerprints within `radius` bits differ in those
counts by `radius` in sum at most, so only such tile pairs are compared, each exactly (exclusive-or, bit count), by
numpy; the other pairs are skipped. A fingerprint is sent to its own tile and, as a probe, to the following half of
the tiles that may hold partners. Tiles that hold many fingerprints are split by a hash, and what probes them is sent to each part, so no task
gets more than about `tile_rows` of them; no tile, bucket or partner is capped.

A tile pair gives a spanning forest of its links (of least distances), not all pairs, so a group of n fingerprints sends on fewer than n
links for each tile pair. Components come from alternating stars.

keep_one() is the pipeline's stage: the same comparison over 128-bit fingerprints of sets of five-word shingles, tiled by size, with an exact check
of the similarity of what it links. Fingerprints alone are compared first; only sets that have one within the radius are sent on with their parities. Of their
pairs forests of links are checked first; then all others within the radius whose texts the links found so far don't connect, so none is left out.

Copies share a fingerprint and are one node. Null texts count as empty; texts without words have fingerprint zero,
linked like any other. Null ids: their fingerprints link like others; component_id is the smallest id that isn't null.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import lean, lean_group, raw_texts
from quire.llm.components import components
from quire.session import materialize

LANES = 4
FORESTS = 3  # of links that are checked first; what they leave apart is compared pair by pair
PARITIES = 8, 64, 1 << 16  # bits of a set's parities: for each member, at least, at most
WORDS = 1 << 21  # of 64 bits, at most, in the bitmap by which texts are chosen before they are sent
SIDE = 512  # rows of a tile that are compared at once with four times as many


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `size` lower-cased words, repeats included; of the whole sequence if there are fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= size:
        return np.array([h(join(words), seed)], np.uint64)
    return np.array([h(join(x), seed) for x in zip(*(words[k:] for k in range(size)), strict=False)], np.uint64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set (bit 0 first); in slices, so memory is bounded."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        out += np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def simhashes(texts: list[bytes], size: int = 3, seed: int = 42) -> np.ndarray:
    """A fingerprint (uint64) for each text. Short texts' bits are summed together, long ones' by themselves."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    count = 0

    def flush():
        nonlocal held, rows, count
        if rows:
            bits = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n = np.array([len(x) for x in held])
            sums = np.add.reduceat(bits, np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.int32)
            out[rows] = _pack(2 * sums > n[:, None])
        held, rows, count = [], [], 0

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, size, seed)
        if len(hashes) > 16_384:
            out[i] = _pack((2 * _bit_sums(hashes) > len(hashes))[None, :])[0]
        elif len(hashes):
            held.append(hashes)
            rows.append(i)
            count += len(hashes)
            if count > 32_768:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long, the fingerprint's 64 bits) of every whole text. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhashes(raw_texts(b.column(1)), size, seed).view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _offsets(radius: int) -> list[int]:
    """Differences of tile numbers (lane counts in base 32) to the following half of the tiles within the radius."""
    found = [d for d in product(range(-radius, radius + 1), repeat=LANES) if 0 < sum(map(abs, d)) <= radius and d > (0,) * LANES]
    return [sum(x * 32**k for k, x in enumerate(reversed(d))) for d in found]


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the edges (i, j) of a spanning forest of least distances d (uint8 or uint16), of n nodes, and a label of each node's tree."""
    label, kept = np.arange(n), [np.zeros(0, np.int64)]
    order = np.argsort(d, kind="stable")
    while len(order):
        level = d[order[0]]
        stop = int(np.searchsorted(d[order], level, "right"))
        at = order[:stop]
        while True:
            a, b = label[i[at]], label[j[at]]
            at, a, b = at[a != b], a[a != b], b[a != b]
            if not len(at):
                break
            # each root is hooked once, to a smaller one: no circle
            roots, pick = np.unique(np.maximum(a, b), return_index=True)
            label[roots] = np.minimum(a, b)[pick]
            kept.append(at[pick])
            while (label != (up := label[label])).any():
                label = up
        order = order[stop:]
        order = order[label[i[order]] != label[j[order]]]  # in a dense group nearly all go here
    return np.concatenate(kept), label


def near_tiles(values: np.ndarray, own: int, radius: int, side: int, start: int = 0):
    """(number, x, y, distances of x to y, which of these are within the radius), each pair of rows once, of every pair of tiles that may hold such, from number `start` on.
    The first `own` rows are compared among themselves and with the others."""
    counts = np.bitwise_count(values).sum(axis=1, dtype=np.int64)
    first, rest = (x[np.argsort(counts[x], kind="stable")].astype(np.int32) for x in (np.arange(own), np.arange(own, len(values))))
    number = -1
    for a in range(0, len(first), side):
        x = first[a : a + side]
        low, high = counts[x[0]] - radius, counts[x[-1]] + radius
        for others, begin in ((first, a), (rest, 0)):
            begin, stop = max(begin, int(np.searchsorted(counts[others], low))), int(np.searchsorted(counts[others], high, "right"))
            for b in range(begin, stop, 4 * side):
                number += 1
                if number < start:
                    continue
                y = others[b : min(stop, b + 4 * side)]
                d = np.zeros((len(x), len(y)), np.uint8 if 64 * values.shape[1] < 256 else np.uint16)
                for k in range(values.shape[1]):
                    d += np.bitwise_count(values[x, k][:, None] ^ values[y, k][None, :])
                near = d <= radius
                if others is first and b < a + len(x):  # each pair once
                    near &= np.arange(b, b + len(y))[None, :] > np.arange(a, a + len(x))[:, None]
                yield number, x, y, d, near


def tile_links(own: np.ndarray, probes: np.ndarray, radius: int, fits=None, forests: int = 1, side: int = SIDE, at_once: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Rows (numbered own first, then probes) at both ends of a spanning forest, by least distances, of the links among `own` and between `own` and `probes`;
    with more `forests`, also of a forest of the links that the one before leaves, and so on.

    Both are uint64 arrays with a row of words for each fingerprint. Rows are put in order of population counts and compared by tiles, exclusive-or
    and bit counts; tiles whose population counts differ beyond the radius are skipped. fits(i, j) may refuse pairs."""
    values = np.concatenate([own, probes])
    held: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))]
    size, label, widest = 0, None, None

    def reduced():
        """The forests of what is held; pairs of one tree of the last one, no nearer than its longest edge, can't change any."""
        nonlocal label, widest
        i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
        left, kept = np.arange(len(d)), []
        for _ in range(forests):
            keep, label = forest(len(values), i[left], j[left], d[left])
            keep = left[keep]
            kept.append(keep)
            left = np.setdiff1d(left, keep, assume_unique=True)
        widest = np.zeros(len(values), d.dtype)
        np.maximum.at(widest, label[i[keep]], d[keep])
        widest = widest[label]
        keep = np.concatenate(kept)
        return i[keep], j[keep], d[keep]

    for _, x, y, d, near in near_tiles(values, len(own), radius, side):
        if label is not None:
            near &= (d < widest[x][:, None]) | (label[x][:, None] != label[y][None, :])
        i, j = np.nonzero(near)
        dist, i, j = d[i, j], x[i], y[j]
        if fits is not None:
            keep = fits(i, j)
            i, j, dist = i[keep], j[keep], dist[keep]
        if len(i):
            held.append((i, j, dist))
            size += len(i)
            if size > at_once:
                held, size = [reduced()], 0
    i, j, _ = reduced()
    return i, j


def near_links(own: np.ndarray, probes: np.ndarray, radius: int, fits=None, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Rows (numbered as in tile_links) at both ends of links that connect what the pairs within the radius connect: fewer than there are rows."""
    values = np.concatenate([own, probes])
    label, kept = np.arange(len(values)), [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for _, x, y, _, near in near_tiles(values, len(own), radius, side):
        i, j = np.nonzero(near)
        i, j = x[i], y[j]
        new = label[i] != label[j]
        i, j = i[new], j[new]
        if fits is not None:
            new = fits(i, j)
            i, j = i[new], j[new]
        if len(i):
            keep, up = forest(len(values), label[i], label[j], np.zeros(len(i), np.uint8))
            kept.append((i[keep], j[keep]))
            label = up[label]
    i, j = (np.concatenate(x) for x in zip(*kept, strict=True))
    return i, j


def parted_pairs(own: np.ndarray, probes: np.ndarray, label: np.ndarray, radius: int, fits=None, start: int = 0, most: int = 1_000_000, side: int = SIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows (numbered as in tile_links) at both ends of all pairs within the radius whose labels differ, of the pairs of tiles from number `start` on, and the number to go on with
    (-1: these are all): a call ends after the pair of tiles with which there are `most`."""
    found, size = [(np.zeros(0, np.int32), np.zeros(0, np.int32))], 0
    after = -1
    for number, x, y, _, near in near_tiles(np.concatenate([own, probes]), len(own), radius, side, start):
        if size >= most:
            after = number
            break
        near &= label[x][:, None] != label[y][None, :]
        i, j = np.nonzero(near)
        i, j = x[i], y[j]
        if fits is not None:
            keep = fits(i, j)
            i, j = i[keep], j[keep]
        found.append((i, j))
        size += len(i)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, after


def link_forest(prints: DataFrame, radius: int = 3, tile_rows: int = 4096) -> DataFrame:
    """prints: distinct fp (long). Links a, b (long) that connect exactly what the relation 'within radius bits' connects."""
    lane = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    tiled = prints.select("fp", sum((lane(k) * 32**k for k in range(1, LANES)), lane(0)).cast("int").alias("tile"))
    # at most 17^4 rows, whatever the input
    parts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    where = F.explode(F.array(*[F.struct((F.col("tile") + F.lit(d)).alias("tile"), F.lit(d == 0).alias("own")) for d in [0, *_offsets(radius)]])).alias("w")
    sent = tiled.select("fp", where).select("fp", "w.tile", "w.own")
    # only tiles that hold fingerprints; a probe goes to every part, an own row to one
    split = sent.join(F.broadcast(parts), "tile")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    sequence = F.sequence(F.lit(0), F.col("parts") - 1)
    # parts of one tile are also compared with each other: an own row probes the parts before its own
    dealt = split.select("fp", "tile", "own", F.explode(F.when(F.col("own"), F.filter(sequence, lambda p: p <= part)).otherwise(sequence)).alias("part"), part.alias("home"))
    rows = dealt.select(F.col("fp"), (F.col("own") & (F.col("home") == F.col("part"))).alias("own"), "tile", "part")

    def run(key, group):
        fp = group.column("fp").to_numpy()
        own = group.column("own").to_numpy(zero_copy_only=False)
        fp = np.concatenate([np.sort(fp[own]), np.sort(fp[~own])])
        words = fp.view(np.uint64)[:, None]
        a, b = tile_links(words[: own.sum()], words[own.sum() :], radius)
        return pa.table({"a": fp[a], "b": fp[b]})

    return rows.groupBy("tile", "part").applyInArrow(run, "a long, b long")


def groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """prints: distinct fp, least (any value of it). fp, least, label: the component's smallest fingerprint."""
    labels = components(link_forest(prints.select("fp"), radius), "simhash-links")
    return prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable over links, itself included)."""
    rows = materialize(fingerprints(docs, size, seed, id_col, text_col), "simhash")
    prints = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    grouped = groups(prints, radius)
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    members = grouped.join(least, "label").select("fp", "component_id")
    return rows.join(members, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


def shingle_set(text: bytes, size: int = 5, cache: dict | None = None) -> np.ndarray:
    """The distinct hashes (uint64, increasing) of every run of `size` words; of the whole sequence if there are fewer."""
    cache = _Words() if cache is None else cache
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([cache[x] for x in words], np.uint64)
    width = min(size, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _sets(batches, size: int):
    cache = _Words()
    for b in batches:
        yield b, [shingle_set(t, size, cache) for t in raw_texts(b.column(b.num_columns - 1))]
        if len(cache) > 400_000:
            cache.clear()


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit fingerprints (rows of two uint64) of sets of hashes."""
    out = np.zeros((len(sets), 2), np.uint64)
    for k, s in enumerate(sets):
        for word, h in enumerate((s, (s ^ (s >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93))):
            if len(h):
                out[k, word] = _pack((2 * _bit_sums(h ^ (h >> np.uint64(32))) > len(h))[None, :])[0]
    return out


def parities(members: np.ndarray) -> bytes:
    """Of each bucket of hashes whether the set has an odd number of them, a bit each; a power of two of buckets, by PARITIES. Two sets' parities
    differ in no more bits than the sets differ in members."""
    each, fewest, most = PARITIES
    bits = min(max(fewest, 1 << (each * len(members)).bit_length()), most)
    odd = np.bincount(((members >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_rows(odd: list[bytes]) -> np.ndarray:
    """Rows of as many words (uint64) as the shortest has; longer ones are folded, which adds buckets up."""
    width = min(map(len, odd), default=8) // 8
    out = np.zeros((len(odd), width), np.uint64)
    for k, x in enumerate(odd):
        words = np.frombuffer(x, "<u8")
        out[k] = words if len(words) == width else np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)
    return out


def comparable(n: np.ndarray, least: float):
    """fits(i, j) for near_links: refuses pairs whose sizes rule out a similarity of `least`, and no others."""
    return lambda i, j: np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9


def possible(n: np.ndarray, odd: np.ndarray, least: float, at_once: int = 1 << 20):
    """fits(i, j) for tile_links: refuses pairs whose sizes or parities rule out a similarity of `least`, and no others."""
    sizes = comparable(n, least)

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = sizes(i, j)
        at, step = np.flatnonzero(keep), max(1, at_once // odd.shape[1])
        for k in range(0, len(at), step):
            part = at[k : k + step]
            x, y = i[part], j[part]
            keep[part] = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= (n[x] + n[y]) * ((1 - least) / (1 + least)) + 1e-6
        return keep

    return fits


def _key(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), 11)


def set_prints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, key (a hash of the shingle set), n (its size), f1, f2 (the set's 128-bit fingerprint), odd (its parities, compressed) of every whole text. One pass, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, sets in _sets(batches, size):
            keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
            prints = wide_prints(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([pack(parities(s)) for s in sets], pa.binary())], names=["id", "text_hash", "key", "n", "f1", "f2", "odd"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, key long, n long, f1 long, f2 long, odd binary")


def _grade(least: float) -> Column:
    """Class of sizes (n), the next one beginning at 1 / `least` times the size: a partner lies in the same or the next class."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(float(-np.log(least))) + 1e-9).cast("int")


def _dealt(prints: DataFrame, tile_rows: int) -> DataFrame:
    """prints' rows (key, region, own_tile, others) as they are sent to tiles of their region and parts of them (tile, part), and whether as own rows or as probes (own).

    A row goes to its own tile and as a probe to the next; a tile of more than about `tile_rows` is split by a hash, and what is compared with it is sent to each part."""
    # a row for each tile: some 60 classes of sizes of all rows or of a large cluster, and the buckets
    parts = prints.groupBy("region", F.col("own_tile").alias("tile")).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    sent = prints.withColumn("tile", F.explode(F.array(F.col("own_tile"), F.col("own_tile") + 1)))
    split = sent.join(F.broadcast(parts), ["region", "tile"]).withColumn("home", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    sequence = F.sequence(F.lit(0), F.col("parts") - 1)
    # parts of one tile are compared with each other once: a row also probes the parts before its own
    dealt = split.withColumn("own", F.col("tile") == F.col("own_tile")).withColumn("part", F.explode(F.when(F.col("own"), F.filter(sequence, lambda p: p <= F.col("home"))).otherwise(sequence)))
    return dealt.select(*[c for c in prints.columns if c not in ("region", "own_tile")], (F.col("own") & (F.col("home") == F.col("part"))).alias("own"), "region", "tile", "part")


def _ordered(group: pa.Table):
    """A tile part's keys, sizes, own and probing fingerprints, and the order that its rows are taken in."""
    key, n, f1, f2 = (group.column(c).to_numpy() for c in ("key", "n", "f1", "f2"))
    own = group.column("own").to_numpy(zero_copy_only=False)
    order = np.lexsort((key, ~own))
    words = np.stack([f1, f2], axis=1)[order].view(np.uint64)
    return key[order], n[order], words[: own.sum()], words[own.sum() :], order


def _opened(group: pa.Table, least: float):
    """A tile part's keys, own and probing fingerprints, fits, and the order that its rows are taken in."""
    key, n, own, probes, order = _ordered(group)
    unpack = zstandard.ZstdDecompressor().decompress
    odd = parity_rows([unpack(x) for x in group.column("odd").to_pylist()])[order]
    return key, own, probes, possible(n, odd, least), order


def clusters(prints: DataFrame, least: float = 0.8, radius: int = 36, tile_rows: int = 32_768) -> DataFrame:
    """prints: key, n, f1, f2, a row for each distinct set. node (a key), label: what the pairs within the radius connect whose sizes allow a similarity of `least`; keys without such a pair are left out."""

    def run(group: pa.Table) -> pa.Table:
        key, n, own, probes, _ = _ordered(group)
        a, b = near_links(own, probes, radius, comparable(n, least))
        return pa.table({"a": key[a], "b": key[b]})

    rows = _dealt(prints.select("key", "n", "f1", "f2", F.lit(0).cast("long").alias("region"), _grade(least).alias("own_tile")), tile_rows)
    return components(rows.groupBy("region", "tile", "part").applyInArrow(lean_group(run), "a long, b long"), "simhash-near")


def placed(prints: DataFrame, labels: DataFrame, least: float, tile_rows: int) -> DataFrame:
    """The rows of prints that are in a cluster (labels), with region and own_tile: a cluster of over an eighth of `tile_rows` is tiled by classes of size, the others
    are put whole into buckets of about that many rows (any two of a bucket are compared)."""
    near = materialize(prints.select("key", "n", "f1", "f2", "odd").join(labels, F.col("key") == F.col("node")).drop("node").withColumnRenamed("label", "cluster"), "simhash-near")
    held = max(1, tile_rows // 8)
    large = near.groupBy("cluster").count().filter(F.col("count") > held).select("cluster", F.lit(True).alias("large"))
    buckets = -(-near.count() // held) or 1
    rows = near.join(F.broadcast(large), "cluster", "left")
    region = F.when(F.col("large"), F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
    tile = F.when(F.col("large"), _grade(least)).otherwise(F.lit(0))
    return materialize(rows.select("key", "n", "f1", "f2", "odd", region.alias("region"), tile.alias("own_tile")), "simhash-placed")


def candidates(near: DataFrame, least: float = 0.8, radius: int = 36, tile_rows: int = 32_768) -> DataFrame:
    """near: placed()'s rows. a, b (keys): forests of the pairs within the radius whose sizes and parities allow a similarity of `least`."""

    def run(group: pa.Table) -> pa.Table:
        key, own, probes, fits, _ = _opened(group, least)
        a, b = tile_links(own, probes, radius, fits, FORESTS)
        return pa.table({"a": key[a], "b": key[b]})

    return _dealt(near, tile_rows).groupBy("region", "tile", "part").applyInArrow(lean_group(run), "a long, b long")


def parted(near: DataFrame, labels: DataFrame, starts: dict | None, least: float, radius: int, tile_rows: int, most: int) -> DataFrame:
    """a, b: the pairs that candidates() has its forests from, all whose labels (node, label; others are their own) differ. A tile part goes on with its number in `starts`
    (None: all from the beginning) and ends after about `most` pairs; a row with region, tile, part and next is where it is to go on."""
    named = near.join(labels, F.col("key") == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("label", "key"))
    kinds = {"region": pa.int64(), "tile": pa.int32(), "part": pa.int32(), "next": pa.int32()}

    def run(group: pa.Table) -> pa.Table:
        where = tuple(group.column(c)[0].as_py() for c in ("region", "tile", "part"))
        a, b, after = [], [], -1
        if starts is None or where in starts:
            key, own, probes, fits, order = _opened(group, least)
            a, b, after = parted_pairs(own, probes, group.column("label").to_numpy()[order], radius, fits, 0 if starts is None else starts[where], most)
            a, b = key[a], key[b]
        pairs = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())} | {c: pa.nulls(len(a), kind) for c, kind in kinds.items()})
        if after < 0:
            return pairs
        go_on = {c: pa.array([v], kind) for (c, kind), v in zip(kinds.items(), (*where, after), strict=True)}
        return pa.concat_tables([pairs, pa.table({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())} | go_on)])

    return _dealt(named, tile_rows).groupBy("region", "tile", "part").applyInArrow(lean_group(run), "a long, b long, region long, tile int, part int, next int")


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """rows (mark, others) whose mark is one of marks' (mark), and by chance a few others: a bitmap of marks is broadcast, of at most WORDS rows, whatever the input."""
    place = lambda df: df.withColumn("__word", F.col("mark").bitwiseAND(F.lit(WORDS - 1)).cast("int")).withColumn("__bit", F.expr("shiftleft(1L, cast(shiftrightunsigned(mark, 58) as int))"))
    bitmap = place(marks).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = place(rows).join(F.broadcast(bitmap), "__word").filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0)
    return found.select(*rows.columns)


def similar_links(docs: DataFrame, each: DataFrame, pairs: DataFrame, least: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `least` or more, exactly. Sets are made anew, for one text of each key in a pair: that of each's k (no_id, id, text_hash);
    other texts are left where they are, but for a few that a bitmap lets through."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    held = each.join(wanted, "key", "left_semi").select(F.xxhash64("k.id", "k.text_hash").alias("mark"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = marked(docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text)).alias("mark"), text.alias("text")), held).select("text")

    def run(batches):
        for _, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_key(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "members"])

    def check(batches):
        for t in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in c.to_pylist()] for c in t.columns[2:4])
            o = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            whole = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - o
            yield pa.RecordBatch.from_arrays(t.columns[:2], names=["a", "b"]).filter(pa.array(o >= least * whole - 1e-9, pa.bool_()))

    sets = materialize(texts.mapInArrow(lean(run), "key long, members binary").dropDuplicates(["key"]), "simhash-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lean(check), "a long, b long")


def keep_one(docs: DataFrame, least: float = 0.8, size: int = 5, radius: int = 36, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 32_768, most: int = 1_000_000) -> DataFrame:
    """docs, one row of each group of near copies: that with the smallest id, null ids last; of one group's rows of that id the text with the smallest
    hash, and of rows equal in both one. Rows of one id and of different groups are judged each in its own. All columns stay, whatever their names.

    Near copies are texts whose sets of `size`-word shingles have a Jaccard similarity of `least` or more, or a chain of such. The search is by
    128-bit fingerprints within `radius` bits, which a pair of similarity 0.8 exceeds about once in ten thousand times (and pairs of a few shingles each more often); links are then checked exactly. Of
    a group's links, three forests of least distances are checked first, fewer than three times its members for each tile pair; then, in rounds of about `most` a
    tile part, every pair that what has been found leaves unconnected. Pairs whose sizes or parities rule the similarity out need no check. Texts without words are
    copies of each other; null texts count as empty.
    """
    rows = set_prints(docs, size, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("k")
    # copies are one row from here on: a group of them is no hot key of a join
    each = materialize(rows.groupBy("key").agg(first, *[F.min(c).alias(c) for c in ("n", "f1", "f2", "odd")]), "simhash-distinct")
    near = placed(each, clusters(each, least, radius, tile_rows), least, tile_rows)
    pairs = materialize(candidates(near, least, radius, tile_rows), "simhash-candidates")
    links = materialize(similar_links(docs, each, pairs, least, size, id_col, text_col), "simhash-similar")
    labels, starts = components(links, "simhash-links"), None
    while starts is None or starts:
        rest = materialize(parted(near, labels, starts, least, radius, tile_rows, most), "simhash-rest")
        starts = {(r["region"], r["tile"], r["part"]): r["next"] for r in rest.filter("next is not null").select("region", "tile", "part", "next").collect()}  # a row for each tile part
        # what a forest had is known not to be similar
        new = materialize(rest.filter("next is null").select("a", "b").join(pairs, ["a", "b"], "left_anti"), "simhash-candidates")
        if not new.isEmpty():
            links = links.union(materialize(similar_links(docs, each, new, least, size, id_col, text_col), "simhash-similar"))
            labels = components(links, "simhash-links")
    named = each.join(labels, each["key"] == labels["node"], "left").select("k", F.coalesce("label", "key").alias("label"))
    first = named.groupBy("label").agg(F.min("k").alias("k"))
    kept = materialize(first.select(F.struct(F.col("k.id").alias("id")).alias("__quire_id"), F.col("k.text_hash").alias("__quire_text")), "simhash-kept")
    # null ids are equal within a struct; both steps have the same keys, so texts are sent once
    own = docs.withColumns({"__quire_id": F.struct(F.col(id_col).alias("id")), "__quire_text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    found = own.join(kept, ["__quire_id", "__quire_text"], "left_semi")
    return found.dropDuplicates(["__quire_id", "__quire_text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
