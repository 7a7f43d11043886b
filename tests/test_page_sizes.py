"""Pages told one by one give the length and digest of the text that they make together."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import sections as so
from quire.operators import toc

LINES = ["", " ", "\x1f", "12", "xiv", "Page 3 of 9", "a-", "  -", "-", "word", "  indented", "B-", "tail \t", "chapter 7", " wide", "é-"]


def books(spark):
    r = random.Random(5)
    page = lambda: r.choice(["\n", "\r\n", "\r", "\x0b"]).join(r.choice(LINES) for _ in range(r.randint(0, 4))) + r.choice(["", "", "\n", "\r", "\n\n"])
    pages = [(f"b{b}", p, page()) for b in range(60) for p in range(r.randint(1, 9))] + [("b0", 9, None)]
    entries = [(f"b{b}", s, r.randint(1, 2), f"t{s}", 1 + s * 2) for b in range(60) for s in range(3)]
    return pages, spark.createDataFrame(pages, "book_id string, page_idx int, text string"), spark.createDataFrame(entries, "book_id string, seq int, level int, title string, page int")


def test_lengths_and_texts_of_spans(spark):
    _, pages, entries = books(spark)
    n = pages.groupBy("book_id").agg(F.count("*").cast("int").alias("n_pages"))
    spans = toc.section_spans(entries, n)
    want = {(r.book_id, r.seq): r.t for r in toc.page_text(spans, pages, n).select("book_id", "seq", fx.clean_text(F.col("text")).alias("t")).collect()}
    assert {(r.book_id, r.seq): r.text for r in so.build_corpus(entries, pages, n, min_chars=0, unique_docids=False).collect()} == want
    sizes = pages.select("book_id", "page_idx", fx.page_size(fx.page_lines(F.col("text"))).alias("n_chars"))
    assert {(r.book_id, r.seq): r.n_chars for r in so.corpus_sizes(entries, sizes, n, min_chars=0).collect()} == {k: len(t) for k, t in want.items()}
    assert len({len(t) for t in want.values()}) > 20


def test_digests_of_spans(spark):
    _, pages, entries = books(spark)
    n = pages.groupBy("book_id").agg(F.count("*").cast("int").alias("n_pages"))
    spans = toc.section_spans(entries, n)
    want = {(r.book_id, r.seq): (len(r.text), hashlib.md5(r.text.encode()).hexdigest()) for r in toc.page_text(spans, pages, n).collect()}
    assert {(r.book_id, r.seq): (r.n_chars, r.digest) for r in toc.page_digests(spans, pages, n).collect()} == want


def test_next_page_of_a_long_book_takes_one_pass(spark):
    """A frame to the book's end took the square: 40,000 entries of one book didn't end in minutes."""
    entries = spark.range(40_000).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("seq"), F.lit(1).alias("level"), F.lit("t").alias("title"), (F.col("id") / 3).cast("int").alias("page"))
    n = spark.createDataFrame([("b", 20_000)], "book_id string, n_pages int")
    got = toc.section_spans(entries, n, [1])
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert got.filter("page_end <> page_start + 1 and page_start < 13333").count() == 0 and got.count() == 40_000
