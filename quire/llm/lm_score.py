"""LM scoring (operator 5): a model of order three in Elias-Fano tries, queried by successor search.

Counts cover all training texts. The unigram is discounted absolutely: p(w) = (c - d) / N for the V known words, and the
one class of unknown words gets d * V / N, d = n1 / (n1 + 2 * n2) from the numbers of words seen once and twice. Each higher
order is smoothed towards the one below: p(w | v) = (c(v, w) + m2 * p(w)) / (c(v) + m2), p(w | u, v) = (c(u, v, w) + m3 * p(w | v)) /
(c(u, v) + m3). Every word and every pair seen is a context, every n-gram seen is kept, and probabilities sum to one in every context.
A text begins after an end, and that after a begin.

1. Texts become blocks of at most `block_tokens` tokens (long texts are cut, two tokens of context going along), written once: a block's distinct words by
   hash, and its tokens as numbers of these. 2. Shards of words sum the blocks' counts and tell each block its words' counts
   and numbers. 3. A block sends its distinct n-grams, each once with its training count, to shards of pairs (v, w); a shard's sums become
   a trie w -> v -> u, a file that is mapped to answer the blocks with codes; no model or vocabulary is gathered. 4. Blocks add the answers up by text.

So a frequent word, pair or n-gram is one entry a block; and where both words of a pair are frequent (1 / `hot_share` of all
tokens, so at most that many words), the pair is spread by u over up to 64 shards, to each of which its total goes along.

fit() stores the tries (a row of a table for each shard) and score() maps stored ones; score_texts() makes and maps them in one
plan, so that n-grams are shuffled once. The results are the same.

log p(w | u, v) is log(c(u, v, w) + m3 * p(w | v)), which level 3 at (w, v, u) holds (relative to N + m3, so that it is a probability),
less log(c(u, v) + m3), which level 2 holds for v after u, as every pair's number of followers is its own count. Level 2 also holds p(w | v), level 1 p(w).

Tokens: runs of characters other than ASCII white space, A-Z lower-cased, then one end. Null and empty texts are one
end. Words are told apart by a 64-bit hash. Repeated rows count, and are scored, each. Null ids are training rows. Columns other than the id and
the text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import lean, lean_group, raw_texts
from quire.llm.elias_fano import NgramTrie, restore
from quire.llm.packing import pack, smallest, unpack
from quire.session import materialize

SEED = 5
UNKNOWN, BEGIN, FIRST = 0, 1, 2  # numbers of words
BITS = 21  # of a word's number within its block
KIND = "block long, shard int, kind tinyint, payload binary"
BODY, REQUEST, ANSWER, STATS, FOUND = range(5)


class _Numbers(dict):
    """Numbers of words, in the order in which they come; the end is an empty word, 0."""

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


@dataclass
class Totals:
    """What all shards share: numbers of the training texts, nothing that grows with them."""

    tokens: int
    vocabulary: int
    discount: float
    pair_mass: float
    triple_mass: float
    shards: int
    hot_share: int

    @property
    def least(self) -> float:
        """No logarithm that a trie holds is lower: it follows the corpus."""
        return -np.log10((self.tokens + self.vocabulary + self.pair_mass + self.triple_mass + 2) / (1 - self.discount))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """p of words seen c times; that of the unknown class for 0."""
        n = max(self.tokens, 1)
        return np.where(c > 0, (c - self.discount) / n, max(self.discount * self.vocabulary / n, 1 / (self.tokens + self.vocabulary + 1)))


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int8()), pa.array(columns[3], pa.binary())], names=["block", "shard", "kind", "payload"])


def _of_kind(table: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    """(block, shard, payload) of a kind, in that order."""
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "block", "shard", "payload")), strict=True)
    return sorted(x[1:] for x in rows if x[0] == kind)


def token_blocks(docs: DataFrame, training: Column, word_shards: int, id_col: str, text_col: str, block_tokens: int, most_words: int = 400_000) -> DataFrame:
    """BODY rows: parts of texts (row, id, null id, held out, tokens, of which context) with their tokens as numbers of the block's words, the frequent ones first;
    REQUEST rows: the block's words of a shard (increasing hashes) with their training counts. A block's rows are of one task's output. A task numbers its words anew
    after a block when there are more than `most_words`; nothing depends on it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(True)).alias("training"), F.col(text_col).alias("text"))

    def run(batches):
        cache, part = _Numbers({b"": 0}), TaskContext.get().partitionId() << 32
        block, row, size, held = part, part, 0, []

        def out():
            nonlocal block, size, held
            tokens = np.concatenate([h for *_, h in held])
            # numbers of the task's words become places among the block's, by hash
            met = np.flatnonzero(np.bincount(tokens, minlength=len(cache)))
            known = [*cache]
            words, place = np.unique(np.fromiter((xxhash.xxh64_intdigest(known[k], SEED) for k in met.tolist()), np.uint64, len(met)), return_inverse=True)
            of = np.empty(len(cache), np.int32)
            of[met] = place
            at = of[tokens]
            n = np.bincount(at, minlength=len(words))
            lengths = np.array([len(h) for *_, h in held])
            lead = np.array([x[3] for x in held])
            scored = np.ones(len(tokens), bool)
            starts = np.cumsum(lengths) - lengths
            scored[starts] = False
            scored[(starts + 1)[lead == 2]] = False
            learnt = scored & np.repeat(np.array([x[2] for x in held]), lengths)
            counts = np.bincount(at[learnt], minlength=len(words))
            order = np.argsort(-n, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            body = [np.array([x[0] for x in held], np.int64), np.array([x[1] or 0 for x in held], np.int64), np.array([x[1] is None for x in held], np.uint8), np.array([x[2] for x in held], np.uint8), smallest(lengths), lead.astype(np.uint8), smallest(order), smallest(number[at])]
            found = [(block, 0, BODY, pack(body))]
            shard = _word_shard(words, word_shards)
            for s, a, b in _pieces(shard):
                found.append((block, s, REQUEST, pack([*hash_steps(words[a:b]), smallest(counts[a:b])])))
            block, size, held = block + 1, 0, []
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in _rows(found).columns], names=["block", "shard", "kind", "payload"])

        for b in batches:
            for key, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2)), strict=True):
                found = text.lower().split()
                numbers = np.zeros(len(found) + 2, np.int32)
                numbers[1:-1] = np.fromiter(map(cache.__getitem__, found), np.int32, len(found))
                at, ended = 1, False
                while at < len(numbers):
                    own = numbers[max(0, at - 2) : at + block_tokens - size]
                    lead = min(at, 2)
                    held.append((row, key, learn, lead, own))
                    at += len(own) - lead
                    size += len(own) - lead
                    if size >= block_tokens:
                        yield out()
                        ended = True
                row += 1
                if ended and len(cache) > most_words:  # only this text has parts in the next block
                    known, cache = [*cache], _Numbers({b"": 0})
                    held = [(*x[:4], np.fromiter((cache[known[k]] for k in x[4].tolist()), np.int32, len(x[4]))) for x in held]
        if held:
            yield out()

    return rows.mapInArrow(lean(run), KIND)


def hash_steps(words: np.ndarray) -> list[np.ndarray]:
    """Increasing hashes as the first one and differences, in six bytes each where they fit."""
    d = np.diff(words)
    small = d < np.uint64(1 << 48)
    return [words[:1], np.where(small, d, 0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.ravel().copy(), np.flatnonzero(~small), d[~small]]


def _open_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, planes, at, large, counts = unpack(blob)
    d = np.zeros((len(planes) // 6, 8), np.uint8)
    d[:, :6] = planes.reshape(6, -1).T
    d = d.view("<u8")[:, 0]
    d[at] = large
    return np.cumsum(np.concatenate([first, d])), counts


def steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of numbers that increase from each `first` (flags) on; those themselves as they are."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return smallest(out)


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """steps() undone."""
    total = np.cumsum(x.astype(np.int64))
    at = np.flatnonzero(first)
    return total - np.repeat(total[at] - x[at].astype(np.int64), np.diff(np.append(at, len(x))))


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards hold ranges of hashes, so sorted hashes are in order of shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pieces(shard: np.ndarray):
    """(shard, from, to) of each run of a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(shard[a]), a, b


def number_words(blocks: DataFrame, word_shards: int) -> DataFrame:
    """ANSWER rows, one for each REQUEST: its words' numbers (frequent ones small, UNKNOWN without a training count) and counts. STATS rows: a shard's tokens, words, words seen once and twice."""

    def run(group: pa.Table) -> pa.Table:
        asked = [(b, s, *_open_words(p)) for b, s, p in _of_kind(group, REQUEST)]
        words, at = np.unique(np.concatenate([h for _, _, h, _ in asked]), return_inverse=True)
        c = np.bincount(at, np.concatenate([n for *_, n in asked]).astype(np.float64), len(words)).astype(np.int64)
        shard = asked[0][1]
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(words))
        number = np.where(c > 0, FIRST + rank * word_shards + shard, UNKNOWN)
        cuts = np.cumsum([len(h) for _, _, h, _ in asked])[:-1]
        out = [(b, s, ANSWER, _numbers(number[k], c[k])) for (b, s, *_), k in zip(asked, np.split(at, cuts), strict=True)]
        return _rows([*out, (-1, shard, STATS, pack([np.array([c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()], np.int64)]))])

    return blocks.filter(F.col("kind") == REQUEST).groupBy("shard").applyInArrow(lean_group(run), KIND)


def _numbers(number: np.ndarray, count: np.ndarray) -> bytes:
    """Words' numbers and counts; within a shard counts fall as numbers rise, so they go as differences in that order, the unknown last."""
    falling = count[np.lexsort((number, number == UNKNOWN))]
    return pack([smallest(number), smallest(-np.diff(falling, prepend=falling[:1])), falling[:1].astype(np.int64)])


def _open_numbers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    number, down, first = unpack(blob)
    count = np.empty(len(number), np.int64)
    count[np.lexsort((number, number == UNKNOWN))] = first - np.cumsum(down.astype(np.int64))
    return number.astype(np.int64), count


class Block:
    """A block's tokens with its words' numbers and counts; every stage that makes one makes the same."""

    def __init__(self, body: bytes, answers: list[bytes], t: Totals, scores: bool = False):
        """With `scores` the key of each scored token is kept (which), without it the keys' training counts (times, total)."""
        self.row, self.id, null, training, lengths, lead, order, tokens = unpack(body)
        self.null, self.training = null.astype(bool), training.astype(bool)
        number, count = (np.concatenate(x) for x in zip(*map(_open_numbers, answers), strict=True))
        # from here on words stand in order of their numbers; those without a training count are one
        self.word, place = np.unique(np.concatenate([[UNKNOWN, BEGIN], number]), return_inverse=True)
        self.count = np.zeros(len(self.word), np.int64)
        self.count[place[2:]] = count
        of_token = place[2:][order]
        lengths, tokens = lengths.astype(np.int64), tokens.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(len(tokens), bool)  # has a word before it
        inner[starts] = False
        scored = inner.copy()
        scored[(starts + 1)[lead == 2]] = False
        part = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        at = np.flatnonzero(inner)
        self.part, self.scored = part[at], scored[at]
        learnt = self.scored & self.training[self.part]
        tokens = of_token[tokens]
        key = np.where(inner[at - 1], tokens[np.maximum(at - 2, 0)], BEGIN)
        key |= tokens[at - 1] << BITS
        key |= tokens[at] << (2 * BITS)
        del tokens, part, inner, scored, at  # large: memory is bounded by the block's tokens, a few arrays of them at a time
        if scores:
            self.keys, which = np.unique(key, return_inverse=True)
            self.which = which.astype(np.int32)
            del key, which
        else:
            # 63 bits of a key and whether it counts
            both = np.sort((key.view(np.uint64) << np.uint64(1)) | learnt)
            del key
            self.keys = (both >> np.uint64(1)).view(np.int64)
            first = np.flatnonzero(np.diff(self.keys, prepend=-1))
            self.times = np.add.reduceat((both & np.uint64(1)).view(np.int64), first) if len(first) else np.zeros(0, np.int64)
            self.keys = self.keys[first]
            del both
        mask = (1 << BITS) - 1
        pairs = self.keys >> BITS
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        self.pair = np.cumsum(new) - 1  # of each key
        self.w, self.v = pairs[new] >> BITS, pairs[new] & mask  # of each pair
        self.u = self.keys & mask
        if not scores:
            self.total = np.bincount(self.pair, self.times, len(self.w)).astype(np.int64)
        # shards of pairs
        numbers = self.word
        mix = (numbers[self.w].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (numbers[self.v].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        base = ((mix >> np.uint64(32)) % np.uint64(t.shards)).astype(np.int64)
        frequent = self.count * t.hot_share >= max(t.tokens, 1)
        self.spread = min(t.shards, 64)
        self.hot = frequent[self.w] & frequent[self.v]
        by = ((numbers[self.u].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) % np.uint64(self.spread)
        self.base, self.shards = base, t.shards
        self.shard = (base[self.pair] + np.where(self.hot[self.pair], by.astype(np.int64), 0)) % t.shards  # of each key

    def requests(self):
        """(shard, keys' places, pairs' places). A frequent pair goes to all the shards it is spread over."""
        order = np.argsort(smallest(self.shard), kind="stable")  # of narrow numbers: by radix
        at = np.searchsorted(self.shard[order], np.arange(self.shards + 1))
        spread = np.flatnonzero(self.hot)
        more = np.repeat(spread, self.spread), ((self.base[spread][:, None] + np.arange(self.spread)) % self.shards).ravel()
        more_order = np.argsort(more[1], kind="stable")
        more_pair, more_at = more[0][more_order], np.searchsorted(more[1][more_order], np.arange(self.shards + 1))
        for s in range(self.shards):
            keys = order[at[s] : at[s + 1]]  # increasing, so by pair
            pairs = np.unique(np.concatenate([self.pair[keys], more_pair[more_at[s] : more_at[s + 1]]]))
            if len(pairs):
                yield s, keys, pairs

    def request(self, keys: np.ndarray, pairs: np.ndarray) -> bytes:
        sizes = np.bincount(np.searchsorted(pairs, self.pair[keys]), minlength=len(pairs))
        own = self.w[pairs], self.v[pairs], self.u[keys]
        met = np.zeros(len(self.word), bool)
        for x in own:
            met[x] = True
        words = np.flatnonzero(met)
        place = np.cumsum(met) - 1
        w, v, u = (place[x] for x in own)
        new = np.diff(w, prepend=-1) > 0
        return pack([steps(self.word[words], np.zeros(len(words), bool)), smallest(self.count[words]), steps(w, np.zeros(len(w), bool)), steps(v, new), smallest(sizes), smallest(self.total[pairs]), steps(u, _starts(sizes)), smallest(self.times[keys])])


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Flags of the first of each run."""
    out = np.zeros(int(sizes.sum()), bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


def open_request(blob: bytes) -> list[np.ndarray]:
    """Words' numbers and counts; of each pair w, v (indexes of words), number of keys and total; the keys' u and counts."""
    words, count, w, v, sizes, total, u, times = unpack(blob)
    w = np.cumsum(w.astype(np.int64))
    return [np.cumsum(words.astype(np.int64)), count.astype(np.int64), w, sums(v, np.diff(w, prepend=-1) > 0), sizes.astype(np.int64), total, sums(u, _starts(sizes.astype(np.int64))), times]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, increasing, and the sums of their n (both from 0 on); by one sort of both together, where they fit in 63 bits."""
    if not len(keys):
        return keys.astype(np.int64), np.zeros(0)
    bits = int(n.max()).bit_length()
    if int(keys.max()).bit_length() + bits > 63:
        keys, which = np.unique(keys, return_inverse=True)
        return keys, np.bincount(which, n.astype(np.float64), len(keys))
    both = np.sort((keys.astype(np.int64) << bits) | n.astype(np.int64))
    keys = both >> bits
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(both & ((1 << bits) - 1), first).astype(np.float64)


def build_trie(pieces: list[list[np.ndarray]], t: Totals) -> NgramTrie:
    """From a shard's requests."""
    own = [p[0] for p in pieces]
    words, first = np.unique(np.concatenate(own), return_index=True)
    counts = np.concatenate([p[1] for p in pieces])[first]
    n = len(words)
    own = [np.searchsorted(words, x) for x in own]
    each = [x[p[2]] * n + x[p[3]] for x, p in zip(own, pieces, strict=True)]
    pairs, totals = summed(np.concatenate([k[p[5] > 0] for k, p in zip(each, pieces, strict=True)]), np.concatenate([p[5][p[5] > 0] for p in pieces]))
    # a triple that counts is of a pair that counts
    triples, times = summed(
        np.concatenate([(np.repeat(np.searchsorted(pairs, k), p[4]) * n + x[p[6]])[p[7] > 0] for k, x, p in zip(each, own, pieces, strict=True)]), np.concatenate([p[7][p[7] > 0] for p in pieces])
    )
    p1 = t.unigram(counts)
    p2 = (totals + t.pair_mass * p1[pairs // n]) / (counts[pairs % n] + t.pair_mass) if n else totals
    whole = t.tokens + t.triple_mass
    p3 = (times + t.triple_mass * p2[triples // n]) / whole if n else times
    return NgramTrie.build(t.least, words, np.log10(p1), pairs, np.log10(p2), np.log10((totals + t.triple_mass) / whole), triples, np.log10(p3))


def look_up(trie: NgramTrie, piece: list[np.ndarray]) -> list[np.ndarray]:
    """For each key of a request the level at which it was found (3, 2, or 0) and that level's code; for each pair whether it was, and the code of its count."""
    at = trie.find(piece[0])
    pair = trie.pair(at[piece[2]], at[piece[3]])
    above = np.repeat(pair, piece[4])
    triple = trie.triple(above, at[piece[6]])
    code = lambda codes, k: codes[np.maximum(k, 0)] if len(codes) else np.zeros(len(k), np.uint16)
    level = np.where(triple >= 0, 3, np.where(above >= 0, 2, 0)).astype(np.uint8)
    found = np.where(triple >= 0, code(trie.triple_codes, triple), np.where(above >= 0, code(trie.pair_codes, above), 0)).astype(np.uint16)
    return [level, found, (pair >= 0).astype(np.uint8), np.where(pair >= 0, code(trie.after_codes, pair), 0).astype(np.uint16)]


def add_up(block: Block, answers: list[tuple[int, int, bytes]], t: Totals) -> tuple[np.ndarray, ...]:
    """For each part: tokens, known tokens, and the logarithms of both models."""
    level, code = np.zeros(len(block.keys), np.uint8), np.zeros(len(block.keys))
    seen, after = np.zeros(len(block.w), np.uint8), np.zeros(len(block.w))
    told = {s: unpack(p) for _, s, p in answers}
    for s, keys, pairs in block.requests():
        for column, where, x in zip((level, code, seen, after), (keys, keys, pairs, pairs), told[s], strict=True):
            column[where] = x
    whole = t.tokens + t.triple_mass
    p1 = t.unigram(block.count)
    backed = (np.log10(t.pair_mass * p1[block.w]) - np.log10(block.count[block.v] + t.pair_mass))[block.pair]
    lost = np.log10(t.triple_mass / whole)
    logs = np.where(level > 0, restore(code, t.least), backed) + np.where(level < 3, lost, 0.0)
    after = np.where(seen > 0, restore(after, t.least), lost)
    # the context (u, v) of each key: the pair v after u, or the begin, as often as there are texts
    after_of = (block.w << BITS) | block.v  # increasing
    context = (block.v[block.pair] << BITS) | block.u
    place = np.minimum(np.searchsorted(after_of, context), max(0, len(after_of) - 1))
    texts = block.count[block.v[block.pair]]
    logs -= np.where(block.u == BEGIN, np.log10((texts + t.triple_mass) / whole), after[place])
    base = np.log10((block.count + 1) / (t.tokens + t.vocabulary + 1))
    w = block.keys >> (2 * BITS)
    parts, part, which = len(block.row), block.part[block.scored], block.which[block.scored]
    by_part = lambda x: np.bincount(part, x[which], parts)
    return np.bincount(part, minlength=parts), by_part((block.count[w] > 0).astype(float)), by_part(base[w]), by_part(logs)


@dataclass
class Model:
    """tries: a row (block -1, shard, payload) for each shard; the payload is a trie's file."""

    totals: Totals
    tries: DataFrame


def prepare(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", pair_mass: float = 200.0, triple_mass: float = 10.0, block_tokens: int = 3 << 19, shard_bytes: int = 9_000_000, hot_share: int = 256) -> tuple[DataFrame, DataFrame, Totals]:
    """Blocks, their words' numbers, and totals: both tables are written to the shared folder."""
    if not 0 < block_tokens <= (1 << BITS) - 8:
        raise ValueError(f"block_tokens must be positive and at most {(1 << BITS) - 8}")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    word_shards = -(-shards // 4)
    blocks = materialize(token_blocks(docs, training, word_shards, id_col, text_col, block_tokens), "lm-blocks")
    numbers = materialize(number_words(blocks, word_shards), "lm-words")

    def stats(batches):
        for b in batches:
            got = [unpack(p)[0] for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in got], pa.int64()) for k in range(4)], names=["n", "v", "one", "two"])

    told = numbers.filter(F.col("kind") == STATS).select("payload").mapInArrow(stats, "n long, v long, one long, two long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "one", "two")]).first()
    n, v, one, two = map(int, told)
    return blocks, numbers.filter(F.col("kind") == ANSWER), Totals(n, v, one / (one + 2 * two) if one else 0.5, pair_mass, triple_mass, shards, hot_share)


def _met(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """block, body, numbers (its shards' answers): a row for each block."""
    told = numbers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "payload"))).alias("numbers"))
    return blocks.filter(F.col("kind") == BODY).select("block", F.col("payload").alias("body")).join(told, "block")


def _block(met: pa.Table, t: Totals, scores: bool = False) -> Block:
    return Block(met.column("body")[0].as_py(), [x["payload"] for x in met.column("numbers")[0].as_py()], t, scores)


def _requests(met: DataFrame, shared) -> DataFrame:
    """The blocks' REQUEST rows; each shard is a partition."""

    def run(one: pa.Table) -> pa.Table:
        block, b = _block(one, shared.value), one.column("block")[0].as_py()
        return _rows([(b, s, REQUEST, block.request(keys, pairs)) for s, keys, pairs in block.requests()])

    return met.groupBy("block").applyInArrow(lean_group(run), KIND).repartitionById(shared.value.shards, F.col("shard"))


def _add_up(met: DataFrame, answers: DataFrame, shared, id_col: str) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def tell(one: pa.Table, told: pa.Table) -> pa.Table:
        if not one.num_rows:
            return schema.empty_table()
        block = _block(one, shared.value, True)
        n, known, base, logs = add_up(block, _of_kind(told, FOUND), shared.value)
        return pa.table([pa.array(block.row), pa.array(block.id, mask=block.null), pa.array(~block.training), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs)], schema=schema)

    parts = met.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_group(tell), "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # a text's parts: one, unless it is longer than a block
    whole = parts.groupBy("row").agg(F.first("id").alias(id_col), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select(id_col, "held_out", "n_tokens", "n_known", F.lit(shared.value.tokens).cast("long").alias("train_tokens"), "base_score", F.round("score", 6).alias("score"))


def _answers(group: pa.Table, trie: NgramTrie) -> pa.Table:
    return _rows([(b, s, FOUND, pack(look_up(trie, open_request(p)))) for b, s, p in _of_kind(group, REQUEST)])


def _built(group: pa.Table, t: Totals) -> bytes:
    return build_trie([open_request(p) for *_, p in _of_kind(group, REQUEST)], t).dump()


def fit(blocks: DataFrame, numbers: DataFrame, t: Totals) -> Model:
    """The model of the blocks' training parts, written to the shared folder."""
    shared = blocks.sparkSession.sparkContext.broadcast(t)

    def run(group: pa.Table) -> pa.Table:
        return _rows([(-1, group.column("shard")[0].as_py(), STATS, _built(group, shared.value))])

    return Model(t, materialize(_requests(_met(blocks, numbers), shared).groupBy("shard").applyInArrow(lean_group(run), KIND), "lm-tries"))


def score(blocks: DataFrame, numbers: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text of the blocks, by a stored model of the same numbers."""
    shared = blocks.sparkSession.sparkContext.broadcast(model.totals)

    def run(group: pa.Table, tries: pa.Table) -> pa.Table:
        return _answers(group, NgramTrie.mapped(tries.column("payload")[0].as_py())) if group.num_rows else _rows([])

    met = _met(blocks, numbers)
    answers = _requests(met, shared).groupBy("shard").cogroup(model.tries.groupBy("shard")).applyInArrow(lean_group(run), KIND)
    return _add_up(met, answers, shared, id_col)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text, by the model of those not held out. Texts are read once; parameters: prepare()'s."""
    blocks, numbers, totals = prepare(docs, ~F.coalesce(held_out, F.lit(False)), id_col, text_col, **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(totals)

    def run(group: pa.Table) -> pa.Table:
        return _answers(group, NgramTrie.mapped(_built(group, shared.value)))

    met = _met(blocks, numbers)
    return _add_up(met, _requests(met, shared).groupBy("shard").applyInArrow(lean_group(run), KIND), shared, id_col)
