"""Token counts (operator 9): overlap resynchronisation.

A text of up to `chunk` characters is encoded at once. A longer one is encoded in overlapping chunks, each token
with its offset; neighbours are spliced at a boundary that both encodings share and that is proven stable, so the
spliced sequence is the one that encoding the whole text gives. Where no such boundary lies in the overlap the
overlap is doubled, at last to the whole rest of the text.

Why a boundary is stable: the byte-level pre-tokenizer's pattern matches white space only at the start of a match
or in matches of nothing but white space. A match that holds a character other than white space therefore ends
before the next white space, whatever stands to its left, and merges never leave a match. Added special strings
hold no white space, so no such boundary lies inside one. Encoding restarted there cannot differ.

Null and empty texts count 0 tokens. Nothing is truncated; special strings in a text count as the library's default
counts them (one token). Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import batch, lean

#: A position between a character that isn't white space and white space.
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
_loaded: dict = {}


class RankTokenizer:
    """Byte-level BPE from a rank file, with the special strings of the JSON form of the same vocabulary.

    `tests/llm/test_texts.py` holds the counts against the JSON file's own library; the two were also compared on
    every Unicode code point (beside letters, digits, punctuation and spaces) without a difference.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        for token, rank in special.items():
            self.width[rank] = len(token.encode())

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def ends(self, text: str) -> tuple[list[int], np.ndarray]:
        """The tokens and the byte offset at which each ends."""
        tokens = self.encode(text)
        return tokens, np.cumsum(self.width[np.array(tokens, np.int64)])


def load_tokenizer(path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> RankTokenizer:
    """One tokenizer for each worker process."""
    if (key := (path, pattern, special)) not in _loaded:
        _loaded[key] = RankTokenizer(path, pattern, dict(special))
    return _loaded[key]


def encode_resynchronised(text: str, tokenizer: RankTokenizer, chunk: int, overlap: int) -> list[int]:
    """The tokens of the whole text, from chunks of about `chunk` characters."""
    if len(text) <= chunk:
        return tokenizer.encode(text)
    out: list[int] = []
    start = 0
    while start < len(text):
        stop = start + chunk
        if stop >= len(text):
            out += tokenizer.encode(text[start:])
            break
        left, left_ends = tokenizer.ends(text[start:stop])
        splice, wide = None, min(overlap, chunk)
        while splice is None:
            lo, hi = max(start, stop - wide), stop + wide
            # the right chunk begins inside the left one; what follows hi only serves as right context
            right_ends = set((tokenizer.ends(text[lo:hi])[1] + len(text[start:lo].encode())).tolist())
            right_ends.add(len(text[start:lo].encode()))
            for m in reversed(list(STABLE.finditer(text, lo, min(stop, len(text))))):
                if not start < m.start() < stop:
                    continue
                at = len(text[start : m.start()].encode())
                k = int(np.searchsorted(left_ends, at))
                if k < len(left_ends) and left_ends[k] == at and at in right_ends:
                    splice = (m.start(), k + 1)
                    break
            else:
                if lo > start:
                    wide *= 2
                elif stop >= len(text):
                    splice = (len(text), len(left))
                else:  # no stable boundary at all so far: a longer left chunk
                    stop = min(len(text), start + 2 * (stop - start))
                    left, left_ends = tokenizer.ends(text[start:stop])
                    wide = overlap
        out += left[: splice[1]]
        start = splice[0]
    return out


def count_tokens(docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None, chunk: int = 16_384, overlap: int = 512, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text; repeated rows give repeated rows. One pass, no shuffle."""
    special_items = tuple(sorted((special or {}).items()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType

    def run(batches):
        tokenizer = load_tokenizer(path, pattern, special_items)
        schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            counts = [len(encode_resynchronised(t, tokenizer, chunk, overlap)) for t in texts]
            done = batch(schema, [sizes, counts])
            yield pa.RecordBatch.from_arrays([b.column(0), *done.columns], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(lean(run), f"id {id_type.simpleString()}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
