"""Sections (book_id, seq, docid, path, page_start, page_end, text): hygiene, identifiers and statistics. book_id is in every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import CHARS_PER_TOKEN, is_front_matter, page_lines, squeeze, whole_size, whole_text
from quire.operators import render, toc


def drop_front_matter(sections: DataFrame) -> DataFrame:
    return sections.filter(~F.exists("path", is_front_matter))


def at_least(sections: DataFrame, min_chars: int = 200) -> DataFrame:
    return sections.filter(F.length("text") >= min_chars) if min_chars else sections


def path_docid(path: Column) -> Column:
    return F.array_join(path, " > ")


def disambiguate(sections: DataFrame) -> DataFrame:
    """docid made unique within a book: repeated ones become their path, and what still repeats gets ' [n]'. was_fixed tells which became paths.

    A literal docid that looks like a suffixed one can still collide, as in the reference.
    """
    same = Window.partitionBy("book_id", "docid")
    rows = sections.withColumn("was_fixed", F.count("*").over(same) > 1)
    rows = rows.withColumn("docid", F.when(F.col("was_fixed"), path_docid(F.col("path"))).otherwise(F.col("docid")))
    n = F.row_number().over(same.orderBy("seq"))
    return rows.withColumn("_n", n).withColumn("docid", F.when(F.col("_n") > 1, F.concat("docid", F.lit(" ["), F.col("_n").cast("string"), F.lit("]"))).otherwise(F.col("docid"))).drop("_n")


def leaf_titles(leaves: DataFrame) -> DataFrame:
    """leaves (book_id, seq, leaf_id, title) with docid: squeezed title or the leaf_id, ' [n]' from the second on; of a repeated leaf_id the last title holds for all."""
    title = F.coalesce(F.nullif(squeeze(F.coalesce("title", "leaf_id")), F.lit("")), F.col("leaf_id"))
    rows = leaves.withColumn("_t", title)
    n = F.row_number().over(Window.partitionBy("book_id", "_t").orderBy("seq"))
    rows = rows.withColumn("_n", n).withColumn("_d", F.when(F.col("_n") > 1, F.concat("_t", F.lit(" ["), F.col("_n").cast("string"), F.lit("]"))).otherwise(F.col("_t")))
    last = F.last("_d").over(Window.partitionBy("book_id", "leaf_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("docid", last).select(*leaves.columns, "docid")


def corpus_stats(sections: DataFrame) -> DataFrame:
    """One row a book; the median is the upper one. A book's lengths are one array: books are small."""
    n = F.length("text")
    rendered = render.full(sections).select("book_id", F.length("toc").alias("toc_prompt_chars"))
    return (
        sections.groupBy("book_id")
        .agg(
            F.count("*").alias("n_leaves"),
            F.max(F.size("path")).alias("max_depth"),
            F.round(F.avg(F.size("path")), 2).alias("mean_depth"),
            F.floor(F.avg(n)).cast("long").alias("mean_chars"),
            F.array_sort(F.collect_list(n)).alias("_n"),
            F.count_if(n < 200).alias("empty_sections"),
            F.round(100 * F.count_if(n < 200) / F.count("*"), 1).alias("empty_pct"),
            (F.count("*") - F.countDistinct("docid")).alias("duplicate_titles"),
        )
        .withColumn("median_chars", F.element_at("_n", F.floor(F.size("_n") / 2).cast("int") + 1))
        .drop("_n")
        .join(rendered, "book_id")
    )


def _titled(entries: DataFrame, n_pages: DataFrame, front_matter: bool, levels: list[int] | None) -> DataFrame:
    rows = toc.section_spans(toc.normalise(entries), n_pages, levels).select("book_id", "seq", F.col("title").alias("docid"), "path", "page_start", "page_end")
    return drop_front_matter(rows) if front_matter else rows


def build_corpus(entries: DataFrame, pages: DataFrame, n_pages: DataFrame, front_matter: bool = True, unique_docids: bool = True, min_chars: int = 200, levels: list[int] | None = None) -> DataFrame:
    """From flat entries and pages to sections; filters run before identifiers are made, which is part of the meaning. Books without entries give nothing. A page is cleaned once, whatever shares it."""
    lines = pages.select("book_id", "page_idx", page_lines(F.col("text")).alias("text"))
    rows = at_least(toc.in_order(_titled(entries, n_pages, front_matter, levels), lines, n_pages, "text", whole_text), min_chars)
    return disambiguate(rows) if unique_docids else rows


def corpus_sizes(entries: DataFrame, sizes: DataFrame, n_pages: DataFrame, min_chars: int = 200, levels: list[int] | None = None) -> DataFrame:
    """build_corpus() with n_chars in place of text. sizes (book_id, page_idx, n_chars): page_size(page_lines(text)) of every page.

    A section can have most of a book's pages (the last one has all that are left): their texts never meet in a row."""
    rows = toc.in_order(_titled(entries, n_pages, True, levels), sizes, n_pages, "n_chars", whole_size)
    return disambiguate(rows.filter(F.col("n_chars") >= min_chars))


def manifest(raw: DataFrame, clean: DataFrame, budget: int = 4000) -> DataFrame:
    """A row a book of what was kept, from the sections before and after cleaning."""
    count = lambda rows, tag: rows.groupBy("book_id").agg(F.count("*").alias(f"leaves_{tag}"), (F.count("*") - F.countDistinct("docid")).alias(f"dup_titles_{'before' if tag == 'raw' else 'after'}"))
    fit = render.fit_toc(clean, budget).select("book_id", F.col("strategy").alias("toc_strategy"), "recall_ceiling")
    stats = corpus_stats(clean).select("book_id", "max_depth", "mean_chars", (F.col("toc_prompt_chars") / F.lit(CHARS_PER_TOKEN)).cast("int").alias("toc_tokens"))
    rows = count(raw, "raw").join(count(clean, "kept"), "book_id").join(stats, "book_id").join(fit, "book_id")
    return rows.withColumn("dropped", F.col("leaves_raw") - F.col("leaves_kept"))
