"""Prefix tries over token sequences as tables, and a constrained beam search with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(sequences: DataFrame) -> DataFrame:
    """sequences (book_id, toks). Distinct (book_id, prefix, next); a prefix that ends a sequence is in complete()."""
    places = F.sequence(F.lit(0), F.size("toks") - 1)
    steps = F.transform(places, lambda i: F.struct(F.slice("toks", F.lit(1), i).alias("prefix"), F.element_at("toks", i + 1).alias("next")))
    return sequences.filter(F.size("toks") > 0).select("book_id", F.explode(steps).alias("e")).select("book_id", "e.prefix", "e.next").distinct()


def next_tokens(sequences: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes (book_id, prefix) with nexts: sorted children, empty for unknown prefixes."""
    found = prefixes.join(edges(sequences), ["book_id", "prefix"], "left").groupBy("book_id", "prefix")
    return found.agg(F.array_sort(F.collect_set("next")).alias("nexts"))


def complete(sequences: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes with is_complete: is it a whole sequence?"""
    whole = sequences.select("book_id", F.col("toks").alias("prefix"), F.lit(True).alias("_w")).distinct()
    return prefixes.join(whole, ["book_id", "prefix"], "left").select("book_id", "prefix", F.coalesce("_w", F.lit(False)).alias("is_complete"))


def size(sequences: DataFrame) -> DataFrame:
    """Number of distinct complete sequences of each book."""
    return sequences.groupBy("book_id").agg(F.countDistinct("toks").alias("n"))


Scorer = Callable[[str, tuple[int, ...], list[int]], list[float]]


def beam_search(sequences: DataFrame, queries: DataFrame, scorer: Scorer, k: int = 3, beams: int | None = None, max_steps: int = 64) -> DataFrame:
    """book_id, qid, rank, docid: constrained decoding of each query; only whole sequences are returned, so none is invented.

    sequences (book_id, docid, toks), queries (book_id, qid, text); scorer(text, prefix, nexts) gives log probabilities of
    the allowed next tokens. A book's trie meets its queries in one task (cogroup); both are a book's size.
    """
    width = beams or max(k, 3)

    def run(tries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        for docid, toks in zip(tries["docid"], tries["toks"], strict=True):
            node = root
            for t in toks:
                node = node.setdefault(int(t), {})
            node.setdefault(None, docid)
        out = []
        for book, qid, text in zip(asked["book_id"], asked["qid"], asked["text"], strict=True):
            live, done = [(0.0, (), root)], []
            for _ in range(max_steps + 1):
                grown = []
                for score, prefix, node in live:
                    if None in node:
                        done.append((score, prefix, node[None]))
                    nexts = sorted(t for t in node if t is not None)
                    if nexts:
                        grown += [(score + s, (*prefix, t), node[t]) for t, s in zip(nexts, scorer(text, prefix, nexts), strict=True)]
                live = sorted(grown, key=lambda x: (-x[0], x[1]))[:width]
                if not live:
                    break
            ranked = list(dict.fromkeys(d for _, _, d in sorted(done, key=lambda x: (-x[0], x[1])) if d))[:k]
            out += [(book, qid, r + 1, d) for r, d in enumerate(ranked)]
        return pd.DataFrame(out, columns=["book_id", "qid", "rank", "docid"])

    return sequences.groupBy("book_id").cogroup(queries.groupBy("book_id")).applyInPandas(run, "book_id string, qid string, rank int, docid string")
