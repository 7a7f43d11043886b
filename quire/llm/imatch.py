"""Document fingerprints (operator 3): I-Match with randomised lexicon subsets.

Terms are white-space separated, lower-cased and told apart by a 64-bit hash. The lexicon holds the terms whose document frequency lies in a band
of shares of all documents (`least_share` to `most_share`), that is, whose inverse document frequency lies in a band.
It is complete. Its size is bounded whatever the input: at most (mean distinct terms a document) / least_share
terms can reach the lower share; it is counted before it is sent, and more than `most_terms` are an error. Document frequencies cover all documents.

The reduced lexicons are the same for every text: each of `subsets` random draws keeps 1, 1/2, 1/4 ... of the lexicon's terms (`LEVELS` of them, nested).
For each draw and level a text's distinct terms of that reduced lexicon, all of them, are sorted and hashed. Likeness at a level is the share of draws
on which two texts have equal hashes, of those on which either has a term; likeness is its greatest value over the levels at which
both have a term in half the draws or more, as small texts say nothing at coarse levels. Equal texts have equal fingerprints; a text without any lexicon term
is fingerprinted by all its terms (level "x"), an empty or null one is "x" with no terms.

`edited_fingerprints` also fingerprints a copy of each text whose last third is replaced by the start of the next
document in descending id order. Nulls among ids come last; equal ids are ordered by their text.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import lean, raw_texts
from quire.session import materialize

LEVELS, STEP, DIGITS = 10, 1, 4  # levels keep 2^-k of the lexicon; hexadecimal digits of a hash
SEED = 11


def document_frequencies(docs: DataFrame, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """term (a hash, long), df long over all documents; counted inside each task before the shuffle."""

    def run(batches):
        schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])
        counts: Counter = Counter()

        def out():
            for k in range(0, len(counts), 50_000):
                part = list(counts.items())[k : k + 50_000]
                terms = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t, _ in part), np.uint64, len(part)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([n for _, n in part], pa.int64())], schema=schema)

        for b in batches:
            for text in raw_texts(b.column(0)):
                counts.update(set(text.lower().split()))
                if len(counts) >= flush:
                    yield from out()
                    counts.clear()
        yield from out()

    return docs.select(text_col).mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, n_docs: int, text_col: str = "text", least_share: float = 1e-4, most_share: float = 0.05, least_df: int = 2, most_terms: int = 5_000_000) -> np.ndarray:
    """The hashes (uint64, increasing) of the terms in the band; eight bytes each, and at most `most_terms`, or ValueError."""
    lo, hi = max(least_df, least_share * n_docs), max(least_df, most_share * n_docs)
    band = materialize(document_frequencies(docs, text_col).filter((F.col("df") >= lo) & (F.col("df") <= hi)).select("term"), "imatch-lexicon")
    if (n := band.count()) > most_terms:
        raise ValueError(f"a lexicon of {n} terms, more than {most_terms}: none is left out; narrow the band (least_share) or raise most_terms")
    return np.sort(band.toArrow().column(0).to_numpy().view(np.uint64))


class IMatch:
    """Fingerprints by a lexicon (increasing hashes of terms)."""

    def __init__(self, terms: np.ndarray, subsets: int = 16):
        self.terms, self.subsets = np.asarray(terms, np.uint64), subsets
        self.salts = np.array([xxhash.xxh64_intdigest(f"draw {k}", SEED) for k in range(subsets)], np.uint64)[:, None]

    def levels(self, terms: np.ndarray) -> np.ndarray:
        """For each draw and term the coarsest reduced lexicon that keeps it."""
        h = (terms[None, :] ^ self.salts) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        kept = np.zeros(h.shape, np.uint8)
        for level in range(1, LEVELS):
            kept += (h & np.uint64((1 << (STEP * level)) - 1)) == 0
        return kept

    def fingerprint(self, text: bytes) -> str:
        words = set(text.lower().split())
        own = np.sort(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)))
        if len(self.terms) and len(own):
            own = own[self.terms[np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)] == own]
        else:
            own = own[:0]
        if not len(own):
            return "x" + (xxhash.xxh64_hexdigest(b" ".join(sorted(words)), 1) if words else "")
        levels = self.levels(own)
        parts = [xxhash.xxh32_hexdigest(own.tobytes(), 0)[:DIGITS] * self.subsets]  # level 0 keeps all
        for level in range(1, LEVELS):
            for kept in levels >= level:
                chosen = own[kept]
                parts.append(xxhash.xxh32_hexdigest(chosen.tobytes(), level)[:DIGITS] if len(chosen) else "-" * DIGITS)
        return "".join(parts)

    def likeness(self, a: str, b: str) -> float:
        return likeness(a, b, self.subsets)


def likeness(a: str, b: str, subsets: int) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if "x" in (a[:1], b[:1]):
        return 0.0
    x, y = (np.frombuffer(f.encode(), f"S{DIGITS}").reshape(LEVELS, subsets) for f in (a, b))
    none = b"-" * DIGITS
    has_x, has_y = x != none, y != none
    equal = ((x == y) & has_x).sum(axis=1)
    either = (has_x | has_y).sum(axis=1)
    telling = (2 * has_x.sum(axis=1) >= subsets) & (2 * has_y.sum(axis=1) >= subsets)
    return float((equal / np.maximum(either, 1))[telling].max(initial=0.0))


def fingerprints(docs: DataFrame, model: IMatch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every whole text. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.fingerprint(t) for t in raw_texts(b.column(1))], pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def edited_fingerprints(docs: DataFrame, model: IMatch, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 4_000_000, most_groups: int = 20_000) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see the module's docstring.

    The order is made without a global window: ids are cut into ranges of about `group_chars` characters (at most `most_groups`
    ranges, whose cuts the driver holds; a larger range is a longer sorted stream, not more memory), by a table of the ids' lengths alone; each range is one sorted stretch of a task's stream, followed by the first document after it
    (and, after the last range, the first of all). Texts are shuffled once, compressed one by one; a task holds two of them at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    sizes = materialize(rows.select("id", "tie", F.length("text").alias("n")), "imatch-sizes")
    total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, min(total[0], -(-total[1] // group_chars), most_groups))
    # cuts: ids that begin a range; as many as ranges, from the quantiles of the ids
    known = sizes.filter("id is not null")
    cuts = known.approxQuantile("id", [k / groups for k in range(1, groups)], min(0.25 / groups, 0.01)) if groups > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)
    # range number: 0 holds the largest ids; nulls go to the last
    edges = spark.sparkContext.broadcast(np.array(cuts[::-1], np.int64))
    number = len(cuts)

    def place(batches):
        for b in batches:
            ids = b.column(0)
            at = number - np.searchsorted(edges.value, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "range"])

    first = F.struct(F.col("id").isNull().alias("no"), (-F.coalesce("id", F.lit(0))).alias("down"), "tie")
    heads = {r["range"]: r["first"] for r in sizes.mapInArrow(lean(place), "id long, tie long, n int, range int").groupBy("range").agg(F.min(first).alias("first")).collect()}  # a row for each range
    order = sorted(heads)
    # the head of each range is also sent, as context, to the range before it (that of the first to the last)
    sent = {tuple(heads[r]): order[k - 1] for k, r in enumerate(order)}
    cast = spark.sparkContext.broadcast({(None if no else -down, tie): to for (no, down, tie), to in sent.items()})

    def copies(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            ids = b.column(0)
            b = pa.RecordBatch.from_arrays([ids, pa.array([squeeze(t) for t in raw_texts(b.column(1))], pa.binary()), b.column(2)], names=["id", "text", "tie"])
            at = number - np.searchsorted(edges.value, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(np.zeros(b.num_rows, np.int8))], names=["id", "text", "tie", "range", "context"])
            extra = [(k, cast.value[key]) for k, key in enumerate(zip(ids.to_pylist(), b.column(2).to_pylist(), strict=True)) if key in cast.value]
            if extra:
                part = b.take(pa.array([k for k, _ in extra]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for _, t in extra], pa.int32()), pa.array([1] * len(extra), pa.int8())], names=["id", "text", "tie", "range", "context"])

    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        m, held = shared.value, None
        expand = zstandard.ZstdDecompressor().decompress

        def row(own, following):
            (_, key, text, print_), (nkey, ntext, nprint) = own, following
            n = len(text)
            part = min(n // 3, len(ntext))
            edited = (text[: n - n // 3] + ntext[:part]).encode()
            eprint = m.fingerprint(edited)
            return key, n, hashlib.sha256(edited).hexdigest(), print_, eprint, m.likeness(print_, eprint), m.likeness(print_, nprint)

        for b in batches:
            out = []
            for range_, context, key, small in zip(*(b.column(c).to_pylist() for c in ("range", "context", "id", "text")), strict=True):
                raw = expand(small)
                now = (range_, key, raw.decode(), m.fingerprint(raw))
                if held is not None and held[0] == range_:
                    out.append(row(held, now[1:]))
                held = None if context else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    down = [F.col("range"), F.col("context"), F.col("id").desc_nulls_last(), F.col("tie")]
    spread = rows.mapInArrow(lean(copies), "id long, text binary, tie long, range int, context tinyint")
    dealt = spread.repartitionById(number + 1, F.col("range")).sortWithinPartitions(*down)
    return dealt.select("range", "context", "id", "text").mapInArrow(lean(run), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
