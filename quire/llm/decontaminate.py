"""Benchmark decontamination (operator 4): pigeonhole edit matching.

Items and texts are normalised: lower case, runs of ASCII characters other than letters and digits to one space. An item of
m characters may differ from a passage by budget = floor(m * rate) edits. It is cut into budget + 1 pieces: by the
pigeonhole principle a passage within the budget holds one of them unchanged. All pieces are searched in one pass
(Aho-Corasick) over the whole text; each hit's surroundings are verified with Myers' bit-parallel distance. So every
passage within the budget is found, and nothing else.

Items shorter than `word_chars` when normalised count only where they stand as whole words, as they would also occur inside of others; null and empty
items hold nothing to find. Null and empty texts hold no passage. Repeated items and rows give repeated hits. Items are read in blocks of about
`block_bytes`; each block is one pass over the texts, and only a block is sent to the executors.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.arrow import lean

_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().translate(_SPACES).split()).decode()


def origins(text: str) -> tuple[list[int], list[int], Sequence[int]]:
    """Starts of the words in the normalised text and in the lowered one, and the place in the text of each character of the lowered one."""
    low = text.lower()
    places = range(len(text)) if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
    at, inner, outer = 0, [], []
    for m in _WORDS.finditer(low):
        inner.append(at)
        outer.append(m.start())
        at += m.end() - m.start() + 1
    return inner, outer, places


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Least distance of the pattern to any stretch of the text, and the (first) end of such a stretch."""
    m = len(pattern)
    if masks is None:
        masks = pattern_masks(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    get = masks.get
    for k, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
            if score < best:
                best, end = score, k + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best, end


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    return dict(masks)


class PassageFinder:
    """items: (id, text) pairs."""

    def __init__(self, items, rate: float = 1 / 16, word_chars: int = 40):
        self.items: list[tuple] = []
        self.word_chars = word_chars
        self.pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            norm = normalise(text)
            if not norm:
                continue
            budget = int(len(norm) * rate)
            number, n = len(self.items), budget + 1
            self.items.append((key, norm, budget))
            cuts = [len(norm) * k // n for k in range(n + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.pieces[norm[a:b]].append((number, a))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for piece in self.pieces:
                self._automaton.add_word(piece, piece)
            self._automaton.make_automaton()
            self._masks = [(pattern_masks(norm), pattern_masks(norm[::-1])) for _, norm, _ in self.items]
        return self._automaton

    def find(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(item's number, start, end, distance) of passages in a normalised text; of overlapping ones of an item the first found with its least distance."""
        if not self.pieces:
            return []
        automaton = self.automaton()
        seen: dict[tuple[int, str], tuple[int, int]] = {}
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        tried: set[tuple[int, int]] = set()
        for end, piece in automaton.iter(norm):
            start = end + 1 - len(piece)
            for number, offset in self.pieces[piece]:
                at = start - offset
                if (number, at) in tried or any(s <= start < e for s, e, _ in out[number]):
                    continue
                tried.add((number, at))
                _, pattern, budget = self.items[number]
                lo = max(0, at - budget)
                window = norm[lo : at + len(pattern) + budget]
                if (got := seen.get((number, window))) is None:
                    got = seen[number, window] = myers(pattern, window, self._masks[number][0])
                distance, stop = got
                if distance <= budget:
                    _, back = myers(pattern[::-1], window[:stop][::-1], self._masks[number][1])
                    first, last = lo + stop - back, lo + stop
                    if len(pattern) >= self.word_chars or ((not first or norm[first - 1] == " ") and norm[last : last + 1] in ("", " ")):
                        out[number].append((first, last, distance))
        return [(number, *x) for number, found in out.items() for x in found]


def passage_blocks(benchmark: DataFrame, rate: float, word_chars: int, item_col: str, text_col: str, block_bytes: int):
    """One finder for each block of items; a block is what is collected and sent."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark.filter(part == k).select(item_col, text_col).toArrow()
        yield PassageFinder(sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1] or "")), rate, word_chars)


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = 1 / 16, word_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """id, item, start, end (code points of the text, end exclusive), distance: a row for each passage found. A pass for each block of items, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    spark = docs.sparkSession
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def search(finder: PassageFinder) -> DataFrame:
        shared = spark.sparkContext.broadcast(finder)

        def run(batches):
            names = ["id", "item", "start", "end", "distance"]
            for b in batches:
                own, found = [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    if not text or not (hits := shared.value.find(normalise(text))):
                        continue
                    inner, outer, places = origins(text)
                    to = lambda p: places[outer[w := bisect_right(inner, p) - 1] + p - inner[w]]  # noqa: B023, E731
                    for number, s, e, d in sorted(hits, key=lambda h: (h[1], h[0])):
                        own.append(k)
                        found.append((shared.value.items[number][0], to(s), to(e - 1) + 1, d))
                if own:
                    items, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(items, item_type), *[pa.array(x, pa.int32()) for x in rest]], names=names)

        return rows.mapInArrow(lean(run), f"id {kinds[0]}, item {kinds[1]}, start int, end int, distance int")

    out = reduce(DataFrame.unionAll, [search(f) for f in passage_blocks(benchmark, rate, word_chars, item_col, item_text_col, block_bytes)])
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 1 / 16, word_chars: int = 40, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """docs without the rows that hold a passage; all columns. A pass for each block of items, no shuffle."""
    at, schema = docs.columns.index(text_col), docs.schema
    for finder in passage_blocks(benchmark, rate, word_chars, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(finder)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not (t and shared.value.find(normalise(t))) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(lean(run), schema)
    return docs
