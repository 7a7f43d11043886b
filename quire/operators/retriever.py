"""Constrained generation as a retriever: a trie held by a task, the callback that keeps a generator inside it, prompts and backends."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import render, trie


class TokenTrie:
    """One book's identifiers as token sequences."""

    def __init__(self, sequences: Iterable[Iterable[int]] = ()):
        self.root: dict = {}
        self.count = 0
        for s in sequences:
            self.add(s)

    def add(self, tokens: Iterable[int]) -> None:
        node = self.root
        for t in tokens:
            node = node.setdefault(int(t), {})
        self.count += None not in node
        node[None] = {}

    def _at(self, prefix: Iterable[int]) -> dict | None:
        node = self.root
        for t in prefix:
            if (node := node.get(int(t))) is None:
                return None
        return node

    def next_tokens(self, prefix: Iterable[int]) -> list[int]:
        return sorted(t for t in self._at(prefix) or {} if t is not None)

    def is_complete(self, prefix: Iterable[int]) -> bool:
        return None in (self._at(prefix) or {})

    def __len__(self) -> int:
        return self.count


def allowed_tokens(tries: TokenTrie, prompt_lengths: int | list[int]) -> Callable[[int, list[int]], list[int]]:
    """The callback of a generator: what may follow in batch row i. A dead end repeats the last token; callers check is_complete()."""

    def allowed(i: int, ids: list[int]) -> list[int]:
        own = ids[prompt_lengths if isinstance(prompt_lengths, int) else prompt_lengths[i] :]
        return tries.next_tokens(own) or [ids[-1]]

    return allowed


def encode(docids: DataFrame, tokenizer: Callable[[str], list[int]], eos: int | None = None) -> DataFrame:
    """docids (book_id, docid) with toks: the tokenizer's ids, then eos if given; each once."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(toks=[[*tokenizer(d), *([] if eos is None else [eos])] for d in pdf["docid"]])

    return docids.select("book_id", "docid").distinct().mapInPandas(run, "book_id string, docid string, toks array<int>")


def decode(sequences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """sequences (book_id, toks), vocabulary (token, piece): toks as stripped text."""
    rows = sequences.withColumn("_id", F.xxhash64("book_id", "toks")).select("book_id", "_id", F.posexplode("toks").alias("at", "token"))
    joined = rows.join(vocabulary, "token").groupBy("book_id", "_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return joined.select("book_id", F.trim(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("docid"))


def prompts(queries: DataFrame, sections: DataFrame, instruction: str, budget: int = 4000, with_toc: bool = True) -> DataFrame:
    """queries (book_id, qid, text) with the prompt that a generator gets: the book's fitted table of contents, then the question."""
    if not with_toc:
        return queries.withColumn("prompt", F.concat(F.lit(f"{instruction}\n\nQuestion: "), "text", F.lit("\n\nSection:")))
    tocs = render.fit_toc(sections, budget).select("book_id", "toc")
    return queries.join(tocs, "book_id").withColumn("prompt", F.concat(F.lit(f"{instruction}\n\nTable of contents:\n"), "toc", F.lit("\n\nQuestion: "), "text", F.lit("\n\nSection:"))).drop("toc")


def run(sections: DataFrame, queries: DataFrame, tokenizer: Callable[[str], list[int]], scorer: trie.Scorer, k: int = 3) -> DataFrame:
    """book_id, qid, ranked for all queries; every identifier exists, so the hallucination rate is 0."""
    found = trie.beam_search(encode(sections, tokenizer), queries, scorer, k)
    return found.groupBy("book_id", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda x: x["docid"]).alias("ranked"))


def paced(backend: Callable[[str], str], seconds: float = 0.7) -> Callable[[str], str]:
    """At least so long between the starts of two calls in one process."""
    last = [0.0]

    def call(prompt: str) -> str:
        wait = last[0] + seconds - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        last[0] = time.monotonic()
        return backend(prompt)

    return call


def retrying(backend: Callable[[str], str], tries: int, again: Callable[[Exception], bool], most_wait: float = 90.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls again, up to `tries` times, after errors for which `again` holds; waits double, up to most_wait."""

    def call(prompt: str) -> str:
        for k in range(tries):
            try:
                return backend(prompt)
            except Exception as e:  # noqa: BLE001  the caller says which to retry
                if k == tries - 1 or not again(e):
                    raise
                sleep(min(most_wait, 2.0**k))
        raise ValueError("tries must be positive")

    return call

