"""Paired two-sided randomisation tests between systems: exact, Monte Carlo and seeded draw by draw."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import draws
from quire.session import materialize


def pairs(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """scores (system, sys_seq, qid, score): a row for each pair of systems and query that both have. keys: columns that make up the qid, if it isn't one."""
    by = keys or ["qid"]
    held = scores.groupBy(*by).agg(F.collect_list(F.struct("system", "sys_seq", "score")).alias("_s"))
    pair = lambda x, y: F.struct(x["system"].alias("a"), x["sys_seq"].alias("a_seq"), x["score"].alias("sa"), y["system"].alias("b"), y["sys_seq"].alias("b_seq"), y["score"].alias("sb"))
    both = F.flatten(F.transform("_s", lambda x: F.transform(F.filter("_s", lambda y: x["sys_seq"] < y["sys_seq"]), lambda y: pair(x, y))))
    qid = F.concat_ws(":", *by) if keys else F.col("qid")
    return held.select(qid.alias("qid"), F.explode(both).alias("_b")).filter("qid is not null").select("qid", "_b.*")


def summary(paired: DataFrame) -> DataFrame:
    """a, b, n_queries, mean_a, mean_b, observed_diff, n_discordant, net (sum of differences)."""
    d = F.col("sa") - F.col("sb")
    return paired.groupBy("a", "b").agg(
        F.count("*").alias("n_queries"), F.round(100 * F.avg("sa"), 2).alias("mean_a"), F.round(100 * F.avg("sb"), 2).alias("mean_b"), F.round(100 * F.avg(d), 2).alias("observed_diff"), F.count_if(d != 0).alias("n_discordant"), F.sum(d).alias("net")
    )


def log_factorial(n):
    """ln n! of a column: Stirling's series at n + 9, brought down by eight logarithms; good to about 1e-12."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return series - sum((F.log(n.cast("double") + float(k)) for k in range(1, 9)), F.lit(0.0))


def exact(paired: DataFrame) -> DataFrame:
    """summary with p_value = P(|2B - m| >= |net|), B ~ Bin(m, 1/2), for scores of 0 and 1; in logs, a row for each term of the sum, so any m will do."""
    rows = summary(paired)
    terms = rows.select("a", "b", F.col("n_discordant").alias("m"), F.abs("net").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), "n_discordant")).alias("k")).filter(F.abs(2 * F.col("k") - F.col("m")) >= F.col("d"))
    m, k = F.col("m"), F.col("k")
    p = terms.groupBy("a", "b").agg(F.sum(F.exp(log_factorial(m) - log_factorial(k) - log_factorial(m - k) - m * F.log(F.lit(2.0)))).alias("_p"))
    rows = rows.join(p, ["a", "b"]).withColumn("_p", F.when(F.col("n_discordant") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("_p"))))
    return rows.withColumn("p_value", F.round("_p", 6)).withColumn("significant", F.col("_p") < 0.05).drop("_p")


BITS = 60  # signs in a digest's first fifteen hexadecimal digits
TURNS = tuple([*row] for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)))
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


class Heads:
    """The first eight bytes, as one number, of the MD5 of something + each text: all texts of one length at once where they fit one block of 64 bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, lengths = texts, np.array([len(t) for t in texts], dtype=np.int64)
        self.groups = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
        self.bytes = [np.frombuffer(b"".join(texts[i] for i in at), dtype=np.uint8).reshape(len(at), n) for n, at in self.groups]
        self.laid: tuple[int, list] = (-1, [])

    def _words(self, before: int) -> list:
        """Each group's blocks as sixteen rows of words, with room for so many bytes before the texts."""
        if self.laid[0] != before:
            out = []
            for (n, at), x in zip(self.groups, self.bytes, strict=True):
                size = before + n
                if size > 55:
                    out.append(None)
                    continue
                block = np.zeros((len(at), 64), dtype=np.uint8)
                block[:, before:size] = x
                block[:, size] = 128
                block[:, 56:58] = (size * 8 & 255, size * 8 >> 8)
                out.append(np.ascontiguousarray(block.view("<u4").T))
            self.laid = (before, out)
        return self.laid[1]

    def after(self, before: bytes) -> np.ndarray:
        out, first = np.empty(len(self.texts), dtype=np.uint64), np.frombuffer(before + b"\0" * (-len(before) % 4), dtype="<u4")
        for (_, at), words in zip(self.groups, self._words(len(before)), strict=True):
            if words is None:
                out[at] = [int.from_bytes(hashlib.md5(before + self.texts[i], usedforsecurity=False).digest()[:8], "big") for i in at]
                continue
            for lo in range(0, len(at), 16_384):
                w = [words[k, lo : lo + 16_384] for k in range(16)]
                out[at[lo : lo + 16_384]] = _md5([x | first[k] if k < len(first) else x for k, x in enumerate(w)])
        return out


def _md5(w: list[np.ndarray]) -> np.ndarray:
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(w[0]), x, dtype=np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += w[g]
        f += np.uint32(SINES[i])
        r = TURNS[i // 16][i % 4]
        high = f >> np.uint32(32 - r)
        f <<= np.uint32(r)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (a + start[0]).byteswap().astype(np.uint64) << np.uint64(32) | (b + start[1]).byteswap()


TAKEN = 200_000  # rows whose digests are made together


def _gathered(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TAKEN:
            yield pa.Table.from_batches(held).to_pandas()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).to_pandas()


def _signed_sums(batches, blocks: int, seed: int):
    """a, b, block, t (a sum for each of the block's signs) over batches of (a, b, qid, d). A query's digest is made once for all its pairs."""
    totals: dict[tuple[str, str], np.ndarray] = {}
    for pdf in _gathered(batches):
        code, qids = pd.factorize(pdf["qid"])
        heads, parts = Heads([q.encode() for q in qids]), []
        for (a, b), one in pdf.groupby(["a", "b"]):
            at, d = code[one.index], one["d"].to_numpy()
            into = totals.setdefault((a, b), np.zeros((blocks, BITS)))
            if np.isin(d, (-1.0, 1.0)).all() and len(np.unique(at)) == len(at):
                masks = np.zeros((2, len(qids)), dtype=bool)
                masks[0, at[d > 0]] = masks[1, at[d < 0]] = True
                parts.append((into, *np.packbits(masks, axis=1), None))
            else:
                parts.append((into, at, d, len(qids)))
        for block in range(blocks):
            whole = np.ascontiguousarray(heads.after(f"{seed}:{block}:".encode()).astype("<u8").view(np.uint8).reshape(-1, 8).T)
            signs = np.stack([np.packbits(whole[j // 8] & np.uint8(1 << j % 8)) for j in range(64 - BITS, 64)])  # a row for each bit of the sixty, the lowest first
            for into, x, y, n in parts:
                if n is None:
                    plus, minus = (np.bitwise_count(signs & m).sum(axis=1, dtype=np.int64) for m in (x, y))
                    into[block] += 2.0 * (plus - minus) - (int(np.bitwise_count(x).sum(dtype=np.int64)) - int(np.bitwise_count(y).sum(dtype=np.int64)))
                else:
                    into[block] += np.unpackbits(signs, axis=1, count=n)[:, x] @ (2 * y) - y.sum()
    for (a, b), t in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([a] * blocks), pa.array([b] * blocks), pa.array(range(blocks), pa.int32()), pa.array(list(t), pa.list_(pa.float64()))], ["a", "b", "block", "t"])


def monte_carlo(paired: DataFrame, n_iter: int = 10_000, seed: int = 42) -> DataFrame:
    """summary with a sampled p_value: signs from a digest of (seed, 60 iterations, query), so partitioning has no say. Queries that agree add nothing and are left out.

    A query's digest holds its signs in 60 iterations. Tasks make the digests of many queries at once and pass on sums only: no row is made for a block or an iteration of a query."""
    blocks = -(-n_iter // BITS)
    d = paired.select("a", "b", "qid", (F.col("sa") - F.col("sb")).cast("double").alias("d")).filter("d <> 0")
    context = paired.sparkSession.sparkContext
    d = d.repartition(max(2 * context.defaultParallelism, int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "qid")  # much work for few bytes: not to be coalesced
    drawn = d.mapInArrow(lambda rows: _signed_sums(rows, blocks, seed), "a string, b string, block int, t array<double>")
    totals = drawn.groupBy("a", "b", "block").agg(*[F.sum(F.get("t", F.lit(j))).alias(f"t{j}") for j in range(BITS)])
    rows = summary(paired)
    hit = lambda j: ((F.col("block") * BITS + j < n_iter) & (F.abs(f"t{j}") >= F.abs("net") - 1e-9)).cast("long")
    hits = totals.join(F.broadcast(rows.select("a", "b", "net")), ["a", "b"]).groupBy("a", "b").agg(F.sum(sum((hit(j) for j in range(1, BITS)), hit(0))).alias("hits"))
    p = F.coalesce((F.col("hits") + 1) / F.lit(n_iter + 1), F.lit(1.0))
    return rows.join(hits, ["a", "b"], "left").withColumn("p_value", F.round(p, 4)).withColumn("significant", p < 0.05).drop("hits")


PIECE, SEGMENT, TURN = 1 << 18, 1 << 22, 200  # differences in a packed row, queries and iterations of a task


def _packed(paired: DataFrame) -> DataFrame:
    """a, b, start, n, net, some, whole, data: each pair's differences in the queries' order, in pieces: a byte each where all are -1, 0 or 1 (whole), else eight."""
    rows = materialize(paired.select("a", "b", "qid", (F.col("sa") - F.col("sb")).cast("double").alias("d")), "differences")
    schema = "a string, b string, part int, piece int, n long, net double, some boolean, whole boolean, data binary"

    def pack(batches):
        held, key, count = [], None, 0

        def row(d):
            whole = bool(np.isin(d, (-1.0, 0.0, 1.0)).all())
            return (*key, len(d), float(d.sum()), bool(d.any()), whole, (d.astype(np.int8) if whole else d).tobytes())

        for batch in batches:
            out, pdf = [], batch.to_pandas()
            for new, one in pdf.groupby(["a", "b", "part"], sort=False):
                if key is not None and (key[:3] != new or sum(map(len, held)) >= PIECE):
                    out.append(row(np.concatenate(held)))
                    held, count = [], count + 1
                key = (*new, count)
                held.append(one["d"].to_numpy())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in out], schema=ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row(np.concatenate(held)), strict=True))], schema=ARROW)

    ordered = rows.repartitionByRange("a", "b", "qid").sortWithinPartitions("a", "b", "qid").select("a", "b", F.spark_partition_id().alias("part"), "d")
    packed = materialize(ordered.mapInArrow(pack, schema), "packed")
    before = Window.partitionBy("a", "b").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = packed.select("a", "b", "part", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return packed.join(F.broadcast(starts), ["a", "b", "part", "piece"])  # a row for each quarter of a million queries


NAMES = ["a", "b", "part", "piece", "n", "net", "some", "whole", "data"]
ARROW = pa.schema(list(zip(NAMES, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.binary()], strict=True)))


def _totals(pieces: pd.DataFrame, of: int, segment: int, turn: int, n_iter: int, seed: int, size: int) -> pd.DataFrame:
    """a, b, i, total: the signed sums of a segment's differences in a turn's iterations. All pairs of `of` queries see the same draws."""
    first, stride = segment * size, 2 * of  # a draw takes two words
    m = min(size, of - first)
    found = {}
    for (a, b), rows in pieces.groupby(["a", "b"]):
        d = np.zeros(m, dtype=np.int8 if rows["whole"].all() else np.float64)
        for at, whole, data in zip(rows["start"], rows["whole"], rows["data"], strict=True):
            x = np.frombuffer(data, dtype=np.int8 if whole else np.float64)
            lo, hi = max(at, first), min(at + len(x), first + m)
            d[lo - first : hi - first] = x[lo - at : hi - at]
        found[a, b] = (d, np.packbits(d > 0), np.packbits(d < 0)) if d.dtype == np.int8 else (d, None, None)
    stream, buffer, out = draws.Stream(), np.empty(min(m, 1 << 15)), []
    state = draws.jump(draws.start(seed), draws.ahead(stride * turn * TURN + 2 * first)) if turn or first else draws.start(seed)
    stream.at(state)
    for i in range(turn * TURN, min(n_iter, (turn + 1) * TURN)):
        sums = dict.fromkeys(found, 0.0)
        for lo in range(0, m, len(buffer)):
            minus = stream.random(buffer[: min(len(buffer), m - lo)]) >= 0.5
            bits = np.packbits(minus)
            for key, (d, above, below) in found.items():
                if above is None:
                    part = d[lo : lo + len(minus)]
                    sums[key] += float(part.sum() - 2 * part[minus].sum())
                else:
                    at = slice(lo // 8, lo // 8 + len(bits))
                    flipped = int(np.bitwise_count(bits & above[at]).sum()) - int(np.bitwise_count(bits & below[at]).sum())
                    sums[key] -= 2 * flipped
        out += [(*key, i, t + float(d.sum(dtype=np.float64)) if above is not None else t) for (key, t), (d, above, _) in zip(sums.items(), found.values(), strict=True)]
        if of > m:  # past the other segments' draws
            state = draws.jump(state, draws.ahead(stride))
            stream.at(state)
    return pd.DataFrame(out, columns=["a", "b", "i", "total"])


def seeded(paired: DataFrame, n_iter: int = 10_000, seed: int = 42) -> DataFrame:
    """a, b, p_value with the draws of a seeded generator over queries in order, for each pair of systems anew; agreeing queries consume draws too.

    A task makes the draws of one segment of the queries and one turn of the iterations: the generator is set there without making those before."""
    packed = _packed(paired)
    whole = packed.groupBy("a", "b").agg(F.sum("n").alias("of"), F.sum("net").alias("net"), F.max("some").alias("some"))
    turns = F.sequence(F.lit(0), F.lit(-(-n_iter // TURN) - 1))
    parts = packed.join(F.broadcast(whole.filter("some").select("a", "b", "of")), ["a", "b"]).withColumn("segment", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.col("n") - 1) / SEGMENT))))
    parts = parts.select("of", "segment", F.explode(turns).alias("turn"), "a", "b", "start", "whole", "data")

    size = SEGMENT

    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        return _totals(pieces, int(key[0]), int(key[1]), int(key[2]), n_iter, seed, size)

    totals = parts.groupBy("of", "segment", "turn").applyInPandas(run, "a string, b string, i int, total double").groupBy("a", "b", "i").agg(F.sum("total").alias("total"))
    hit = F.abs(F.col("total") / F.col("of")) >= F.abs(F.col("net") / F.col("of")) - 1e-12
    hits = totals.join(F.broadcast(whole), ["a", "b"]).groupBy("a", "b").agg(F.count_if(hit).alias("hits"))
    p = F.coalesce((F.col("hits") + 1) / F.lit(n_iter + 1), F.lit(1.0))
    return whole.join(hits, ["a", "b"], "left").select("a", "b", F.round(p, 4).alias("p_value"), (p < 0.05).alias("significant"))
