"""Tables of contents as text, and the least lossy one that fits a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import est_tokens


def _listing(rows: DataFrame, line: Column) -> DataFrame:
    """One text a book, lines in order."""
    return rows.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("toc"))


def _prefixes(sections: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Each distinct path prefix once, where it is first seen."""
    depths = F.sequence(F.lit(1), F.size("path") if max_depth is None else F.least(F.size("path"), F.lit(max_depth)))
    rows = sections.filter(F.size("path") > 0).select("book_id", "seq", F.explode(F.transform(depths, lambda d: F.slice("path", F.lit(1), d))).alias("prefix"))
    return rows.groupBy("book_id", "prefix").agg(F.min("seq").alias("seq")).select("book_id", F.struct("seq", F.size("prefix").alias("depth")).alias("at"), F.element_at("prefix", -1).alias("title"))


def _indent(title: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.col("at.depth") - 1), title)


def full(sections: DataFrame) -> DataFrame:
    return _listing(_prefixes(sections), _indent(F.col("title")))


def full_lines(sections: DataFrame) -> DataFrame:
    """book_id, at, line: full() line by line, to be read in order of `at`."""
    return _prefixes(sections).select("book_id", "at", _indent(F.col("title")).alias("line")).filter("line is not null")


def full_sizes(sections: DataFrame) -> DataFrame:
    """book_id, toc_chars: the length of full(), which isn't put together."""
    return full_lines(sections).groupBy("book_id").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("toc_chars"))


def leaves_only(sections: DataFrame) -> DataFrame:
    rows = sections.groupBy("book_id", "docid").agg(F.min("seq").alias("seq")).select("book_id", F.struct("seq").alias("at"), "docid")
    return _listing(rows, F.col("docid"))


def truncated(sections: DataFrame, max_title_chars: int = 48) -> DataFrame:
    short = F.concat(F.regexp_replace(F.substring("title", 1, max_title_chars - 1), r"(?U)[\s\x1c-\x1f]+$", ""), F.lit("…"))
    return _listing(_prefixes(sections), _indent(F.when(F.length("title") > max_title_chars, short).otherwise(F.col("title"))))


def depth_capped(sections: DataFrame, max_depth: int = 3) -> DataFrame:
    return _listing(_prefixes(sections, max_depth), _indent(F.col("title")))


STRATEGIES = (("full", full), ("truncated", truncated), ("leaves_only", leaves_only), ("depth_capped_3", depth_capped))


def fit_toc(sections: DataFrame, budget: int, tokens: Callable[[Column], Column] = est_tokens) -> DataFrame:
    """A row a book: the first strategy within the budget, else the last with fits false (null when it fits); attempts lists those tried. tokens counts a text's tokens: an estimate by length, or a tokenizer's expression."""
    tries = reduce(DataFrame.unionByName, [f(sections).select("book_id", F.lit(i).alias("prio"), F.lit(name).alias("strategy"), "toc", tokens(F.col("toc")).alias("tokens")) for i, (name, f) in enumerate(STRATEGIES)])
    chosen = tries.groupBy("book_id").agg(
        F.coalesce(F.min(F.when(F.col("tokens") <= budget, F.struct("prio", "strategy", "toc", "tokens"))), F.max(F.struct("prio", "strategy", "toc", "tokens"))).alias("c"),
        F.array_sort(F.collect_list(F.struct("prio", "strategy", "tokens"))).alias("all"),
    )
    leaves = sections.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.size("path") <= 3).alias("shallow"))
    rows = chosen.join(leaves, "book_id")
    addressable = F.when(F.col("c.strategy") == "depth_capped_3", F.col("shallow")).otherwise(F.col("n"))
    return rows.select(
        "book_id", "c.strategy", "c.toc", "c.tokens", F.lit(budget).alias("budget"), (F.col("c.strategy") == "full").alias("lossless"),
        F.when(F.col("c.tokens") > budget, F.lit(False)).alias("fits"), addressable.alias("addressable_leaves"), F.round(100 * addressable / F.greatest(F.lit(1), F.col("n")), 2).alias("recall_ceiling"),
        F.transform(F.filter("all", lambda x: x["prio"] <= F.col("c.prio")), lambda x: F.struct(x["strategy"].alias("name"), x["tokens"].alias("tokens"))).alias("attempts"),
    )
