"""Suffix-array dedup (operator 10): prefix-free parsing over the whole corpus.

Every byte covered by a `length`-byte string that also starts in a document with a smaller id is removed.

1. Documents are dealt into blocks by a hash. Of the rolling hashes of `gram` bytes in each `length`-byte window the smallest (the first of
   equal ones) is its anchor: a trigger that depends on the window alone, so equal windows have equal anchors wherever they stand.
2. Anchors' hashes are dealt by value to shards, a block sending each at most twice (the second time for a second document), which return a bit for
   each: does it occur in another document?
3. For repeated anchors a block sends, to the shard of the anchor, its fragments (runs of windows with one anchor), each distinct one
   once, with the smallest id of the documents that hold it: a hot passage costs a block one row.
4. A shard orders the windows of its distinct fragments, all of them, by prefix-free parsing (see pfp.py); where neighbours' windows are equal, byte by
   byte, they form a group. Windows with different anchors differ, so a shard works in ranges of anchors. The smallest id of each window's
   group returns to the blocks, as runs.
5. A block marks the windows whose smallest id is below the document's own, and cuts the bytes they cover.

The shuffle of texts is made once and read three times; hashes, fragments and runs travel as packed blocks. Nothing is gathered
anywhere, and no group is compared pair by pair. Null texts count as empty; null ids as larger than all others. Documents with
equal ids do not make each other's bytes repeats. Matches never cross documents; within one document repeats stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import trim, utf8
from quire.llm.packing import pack, unpack
from quire.llm.pfp import PrefixFreeParse, mix_words, rolling, same_windows

NO_ID = np.iinfo(np.int64).max
CHUNK = 1 << 17


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """hash, row, first window start, number of windows: maximal runs of windows, inside one text, with one anchor."""
    width, found = length - gram + 1, []
    for lo in range(0, max(0, len(data) - length + 1), CHUNK):
        h = rolling(data[lo : lo + CHUNK + length - 1], gram)
        least = (h & ~np.uint64(0x3FFFF)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        at = (least & np.uint64(0x3FFFF)).astype(np.int64)
        start = np.arange(lo, lo + len(at))
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + length <= offsets[row + 1]
        at, start, row = at[inside], start[inside], row[inside]
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
            # the smallest of many hashes are small numbers: mixed again, they spread over the shards' ranges
            found.append((mix_words(h[at[first]]), row[first], start[first], np.diff(np.concatenate([first, [len(at)]]))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards hold ranges of hashes, so sorted hashes are in order of shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pieces(shard: np.ndarray):
    """(shard, from, to) of each run of a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(shard[a]), a, b


class Block:
    """A block's texts in order of id and text, and its anchors, sorted by hash; every stage that makes one makes the same."""

    def __init__(self, table: pa.Table, length: int, gram: int, anchors: bool = True):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = table.column("text")
        self.data, self.offsets = utf8(text.chunk(0) if text.num_chunks else pa.array([], pa.string()))
        self.known = table.column("id").is_valid().to_numpy(zero_copy_only=False)
        self.ids = table.column("id").fill_null(NO_ID).to_numpy()
        if anchors:
            h, row, start, count = anchor_runs(self.data, self.offsets, length, gram)
            order = np.argsort(h, kind="stable")
            self.hash, self.row, self.start, self.count = h[order], row[order], start[order], count[order]
            # entries: a hash's first id and first other id, two of a hash at most
            own = self.ids[self.row]
            new = np.ones(len(h), bool)
            new[1:] = self.hash[1:] != self.hash[:-1]
            other = ~new
            other[1:] &= own[1:] != own[:-1]
            before = np.cumsum(other) - other
            first = np.flatnonzero(new)
            self.entry = new | (other & (before == np.repeat(before[first], np.diff(np.append(first, len(h))))))

    def hashes(self, shards: int):
        """(shard, entries' hashes): 32 bits of each, the shard being told by other bits; this only sifts."""
        h = self.hash[self.entry]
        for s, a, b in _pieces(_shard(h, shards)):
            yield s, (h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def fragments(self, bits: dict[int, np.ndarray], shards: int, back: int, length: int):
        """Distinct fragments of repeated anchors by shard, and a table of where they stand.

        bits: for each shard of hashes(, back), a flag for each entry."""
        h = self.hash[self.entry]
        flags = np.zeros(len(h), bool)
        for s, a, b in _pieces(_shard(h, back)):
            flags[a:b] = bits[s]
        hot = np.flatnonzero(flags[np.cumsum(self.entry) - 1]) if len(h) else np.zeros(0, np.int64)
        whole = self.data.tobytes()
        shard = _shard(self.hash[hot], shards)
        sent, where = [], []
        for s, a, b in _pieces(shard):
            mine = hot[a:b]
            seen: dict[bytes, int] = {}
            number = np.array([seen.setdefault(whole[x : x + n], len(seen)) for x, n in zip(self.start[mine].tolist(), (self.count[mine] + length - 1).tolist(), strict=True)], np.int64)
            least = np.full(len(seen), NO_ID)
            np.minimum.at(least, number, self.ids[self.row[mine]])
            h_of = np.zeros(len(seen), np.uint64)
            h_of[number] = self.hash[mine]
            sizes = np.fromiter(map(len, seen), np.int64, len(seen))
            sent.append((s, [h_of, sizes.astype(np.uint32), least, np.frombuffer(b"".join(seen), np.uint8)]))
            where.append((np.full(len(mine), s, np.uint32), number.astype(np.uint32), self.row[mine].astype(np.uint32), self.start[mine]))
        return sent, [np.concatenate(x) for x in zip(*where, strict=True)] if where else [np.zeros(0, np.uint32)] * 3 + [np.zeros(0, np.int64)]


def repeated(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For each entry of each array: does its value occur again, in any of them?"""
    flat = np.concatenate(arrays)
    _, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    return np.split(counts[back] > 1, np.cumsum([len(a) for a in arrays])[:-1])


def least_ids(sent: list[list[np.ndarray]], length: int) -> list[list[np.ndarray]]:
    """sent: [hash, size, least id, bytes] of distinct fragments, from each block. Returns for each block: number of runs of each fragment, windows and smallest id of each run."""
    size, least = (np.concatenate([s[k] for s in sent]) for k in (1, 2))
    size = size.astype(np.int64)
    data = np.concatenate([s[3] for s in sent])
    ends = np.cumsum(size)
    whole, seen = data.tobytes(), {}
    which = np.array([seen.setdefault(whole[b - n : b], len(seen)) for b, n in zip(ends.tolist(), size.tolist(), strict=True)], np.int64)
    n = len(seen)
    first = np.full(n, NO_ID)
    np.minimum.at(first, which, least)
    texts = list(seen)
    windows = np.fromiter(map(len, texts), np.int64, n) - (length - 1)
    per_window = np.repeat(first, windows)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum(windows + length - 1)])
    slots = np.arange(windows.sum())
    positions = slots + np.repeat(begins[:-1] - (np.cumsum(windows) - windows), windows)
    slot_of = np.zeros(len(flat), np.int64)
    slot_of[positions] = slots
    order = PrefixFreeParse(flat, begins).order(positions, length)
    new = np.concatenate([[True], ~same_windows(flat, order[:-1], order[1:], length)])
    slots = slot_of[order]
    per_window[slots] = np.minimum.reduceat(per_window[slots], np.flatnonzero(new))[np.cumsum(new) - 1]
    begin = np.cumsum(windows) - windows
    change = np.ones(len(per_window), bool)
    change[1:] = per_window[1:] != per_window[:-1]
    change[begin] = True
    run_at = np.flatnonzero(change)
    run_length = np.diff(np.concatenate([run_at, [len(per_window)]]))
    runs = np.add.reduceat(change.astype(np.int64), begin)
    run_first = np.cumsum(runs) - runs
    out, at = [], 0
    for s in sent:
        mine = which[at : at + len(s[0])]
        at += len(s[0])
        r = runs[mine]
        take = np.repeat(run_first[mine] - (np.cumsum(r) - r), r) + np.arange(r.sum())
        out.append([r.astype(np.uint32), run_length[take].astype(np.uint32), per_window[run_at[take]]])
    return out


def least_ids_in_parts(sent: list[list[np.ndarray]], length: int, part: int = 8_000) -> list[list[np.ndarray]]:
    """least_ids(), for ranges of hashes with about `part` fragments each, so that sorting needs little memory. Fragments are sent in order of their hashes."""
    hashes = np.sort(np.concatenate([s[0] for s in sent]))
    cuts = np.unique(hashes[part::part])
    out: list[list[list[np.ndarray]]] = [[] for _ in sent]
    where = [np.concatenate([[0], np.searchsorted(s[0], cuts), [len(s[0])]]) for s in sent]
    ends = [np.concatenate([[0], np.cumsum(s[1].astype(np.int64))]) for s in sent]
    for k in range(len(cuts) + 1):
        mine = [j for j, w in enumerate(where) if w[k] < w[k + 1]]
        slices = [slice(where[j][k], where[j][k + 1]) for j in mine]
        parts = [[sent[j][0][x], sent[j][1][x], sent[j][2][x], sent[j][3][ends[j][x.start] : ends[j][x.stop]]] for j, x in zip(mine, slices, strict=True)]
        for j, found in zip(mine, least_ids(parts, length) if parts else [], strict=True):
            out[j].append(found)
    return [[np.concatenate(x) for x in zip(*found, strict=True)] for found in out]


def removed(block: Block, where: list[np.ndarray], answers: dict[int, list[np.ndarray]], length: int) -> np.ndarray:
    """A flag for each byte of the block."""
    steps = np.zeros(len(block.data) + 1, np.int64)
    shard, number, row, start = where
    for s, a, b in _pieces(shard):
        runs, windows, least = answers[s]
        runs, windows = runs.astype(np.int64), windows.astype(np.int64)
        first = np.cumsum(runs) - runs
        offset = np.cumsum(windows) - windows
        offset -= np.repeat(offset[first], runs)
        n = number[a:b].astype(np.int64)
        r = runs[n]
        take = np.repeat(first[n] - (np.cumsum(r) - r), r) + np.arange(r.sum())
        begin = np.repeat(start[a:b], r) + offset[take]
        gone = least[take] < np.repeat(block.ids[row[a:b]], r)
        begin, end = begin[gone], (begin + windows[take] + length - 1)[gone]
        np.add.at(steps, begin, 1)
        np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def tell(block: Block, gone: np.ndarray) -> pa.Table:
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    edges = block.offsets[:-1][block.offsets[:-1] < len(gone)]
    starts[edges] = gone[edges]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets])
    kept = block.data[~gone].tobytes()
    n, cut = np.diff(block.offsets), sums(gone)
    ends = np.cumsum(n - cut)
    digests = [hashlib.sha256(kept[b - k : b]).hexdigest() for b, k in zip(ends.tolist(), (n - cut).tolist(), strict=True)]
    return pa.table({"id": pa.array(block.ids, mask=~block.known), "n_bytes": n, "n_removed": cut, "n_spans": sums(starts), "kept_sha256": digests})


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, shard_anchors: int = 500_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every whole text.

    Blocks hold a thousandth of all bytes, but 2 to 12 million each (`block_bytes` sets another size); results don't depend on it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    block_bytes = min(max(total // 1000, 2_000_000), 12_000_000) if block_bytes is None else block_bytes
    blocks, shards = max(1, -(-total // block_bytes)), max(1, total * 2 // ((length - gram + 2) * shard_anchors))
    texts = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    names = ["block", "shard", "kind", "payload"]
    kind = "block int, shard int, kind tinyint, payload binary"

    def made(found: list[tuple[int, int, int, list[np.ndarray]]]) -> pa.Table:
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int8()), pa.array([p if isinstance(p, bytes) else pack(p) for p in columns[3]], pa.binary())], names=names)

    def lean(f):
        """What a group took goes back to the system before the next one comes: workers live on between tasks."""

        def run(*tables):
            try:
                return f(*tables)
            finally:
                trim()

        return run

    def number(table: pa.Table) -> int:
        return table.column("block")[0].as_py()

    def hashes(table: pa.Table) -> pa.Table:
        block = Block(table, length, gram)
        return made([(number(table), s, 0, [h]) for s, h in block.hashes(shards)])

    def sift(table: pa.Table) -> pa.Table:
        blocks_, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
        flags = repeated([unpack(p)[0] for p in payloads])
        s = table.column("shard")[0].as_py()
        return made([(b, s, 0, [np.packbits(f)]) for b, f in zip(blocks_, flags, strict=True)])

    def fragments(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return made([])
        block, b = Block(table, length, gram), number(table)
        bits = {s: np.unpackbits(unpack(p)[0]).astype(bool) for s, p in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist(), strict=True)}
        entries = {s: len(h) for s, h in block.hashes(shards)}
        sent, where = block.fragments({s: bits[s][:n] for s, n in entries.items()}, shards, shards, length)
        return made([*[(b, s, 0, p) for s, p in sent], (b, b % shards, 1, where)])

    def order(table: pa.Table) -> pa.Table:
        found = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
        through = [x for x in found if x[2] == 1]
        mine = [x for x in found if x[2] == 0]
        answers = least_ids_in_parts([unpack(p) for *_, p in mine], length) if mine else []
        return made([*[(b, s, 0, a) for (b, s, _, _), a in zip(mine, answers, strict=True)], *through])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, length, gram, anchors=False)
        found = list(zip(*(answers.column(c).to_pylist() for c in names), strict=True))
        where = next((unpack(p) for _, _, k, p in found if k == 1), None)
        gone = removed(block, where, {s: unpack(p) for _, s, k, p in found if k == 0}, length) if where is not None else np.zeros(len(block.data), bool)
        return tell(block, gone)

    # a number of partitions that adaptive execution doesn't lower: shards are small on the wire and long to work on
    by_shard = lambda rows: rows.repartitionById(shards, F.col("shard")).groupBy("shard")
    bits = by_shard(texts.groupBy("block").applyInArrow(lambda t: lean(hashes)(t), kind)).applyInArrow(lambda t: lean(sift)(t), kind)
    pieces = texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(lambda t, u: lean(fragments)(t, u), kind)
    least = by_shard(pieces).applyInArrow(lambda t: lean(order)(t), kind)
    out = texts.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(lambda t, u: lean(cut)(t, u), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
