"""Hierarchies from flat tables of contents: parents, leaves, paths and page spans.

Entries have (book_id, seq, level, title, page); seq is the document order. All operators are windows over one
partitioning and order, so a book is shuffled and sorted once; no self-join. Levels are few (a table of contents' depth).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import squeeze

def _book():
    return Window.partitionBy("book_id").orderBy("seq")


def normalise(entries: DataFrame) -> DataFrame:
    """Titles squeezed; entries without a title vanish before anything is nested."""
    return entries.withColumn("title", squeeze(F.col("title"))).filter("title <> ''")


def _levels(entries: DataFrame) -> list[int]:
    """The distinct levels: as many rows as a table of contents is deep."""
    return sorted(r[0] for r in entries.select("level").distinct().collect())


def hierarchy(entries: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """entries with parent_seq (null for roots), is_leaf and path (titles from the root, its own last).

    An ancestor of a row is the latest earlier row of a smaller level, of those levels whose latest row is later than
    the latest rows of all smaller levels: just what a stack would hold. levels: the distinct levels, if they are known; else they are
    collected first (as many rows as a table of contents is deep).
    """
    levels = _levels(entries) if levels is None else levels
    before = _book().rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("seq", "title")), ignorenulls=True).over(before).alias(f"_l{i}") for i, k in enumerate(levels)]
    rows = entries.select("*", F.coalesce(F.lead("level").over(_book()) <= F.col("level"), F.lit(True)).alias("is_leaf"), *last)
    own = F.filter(F.array(*[F.when(F.lit(k) < F.col("level"), F.col(f"_l{i}")) for i, k in enumerate(levels)]), lambda x: x.isNotNull())
    rows = rows.withColumn("_own", own)
    open_ = F.filter("_own", lambda x, i: F.forall(F.slice(F.col("_own"), F.lit(1), i), lambda y: y["seq"] < x["seq"]))
    rows = rows.withColumn("_open", open_)
    parent = F.when(F.size("_open") > 0, F.element_at("_open", -1)["seq"])
    path = F.concat(F.transform("_open", lambda x: x["title"]), F.array("title"))
    return rows.select(*entries.columns, parent.alias("parent_seq"), "is_leaf", path.alias("path"))


def section_spans(entries: DataFrame, n_pages: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Leaves with page_start and page_end (exclusive): up to the first larger page of any following entry, else the book's end.

    n_pages: (book_id, n_pages). Output order is (page, level, seq).
    """
    # pages downwards: a frame that only grows takes one pass, one that shrinks to the end is summed anew for every row
    by_page = Window.partitionBy("book_id").orderBy(F.desc("page")).rangeBetween(Window.unboundedPreceding, -1)
    rows = hierarchy(entries, levels).withColumn("_next", F.min("page").over(by_page)).join(n_pages, "book_id")
    return rows.filter("is_leaf").select("book_id", "seq", "level", "title", "path", F.col("page").alias("page_start"), F.coalesce("_next", F.col("n_pages") + 1).alias("page_end"))


def ranges(spans: DataFrame, n_pages: DataFrame) -> DataFrame:
    """spans with _lo and _hi: their pages are [max(0, start - 1), min(n, max(start, end - 1)))."""
    s = spans.join(n_pages, "book_id").withColumn("_lo", F.greatest(F.lit(0), F.col("page_start") - 1))
    return s.withColumn("_hi", F.least("n_pages", F.greatest(F.col("_lo") + 1, F.col("page_end") - 1)))


def pages_of(ranged: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, _lo, _hi, page_idx and the pages' other columns for each distinct range; leaves of one page share theirs.

    pages: (book_id, page_idx from 0, ...). An equi-join on (book, page) after a sequence of pages, so a large book spreads."""
    wanted = ranged.filter("_lo < _hi").select("book_id", "_lo", "_hi").distinct().select("*", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("page_idx"))
    return wanted.join(pages, ["book_id", "page_idx"])


def in_order(spans: DataFrame, pages: DataFrame, n_pages: DataFrame, page: str, made: Callable[[Column], Column]) -> DataFrame:
    """spans with made(array of their pages' column `page`, in order; nulls left out, empty for none) under that name."""
    s = ranges(spans, n_pages)
    found = pages_of(s, pages.select("book_id", "page_idx", F.col(page).alias("_t")).filter("_t is not null"))
    each = found.groupBy("book_id", "_lo", "_hi").agg(F.array_sort(F.collect_list(F.struct("page_idx", "_t"))).alias("_a"))
    each = each.select("book_id", "_lo", "_hi", made(F.transform("_a", lambda x: x["_t"])).alias(page))
    none = made(F.array().cast(f"array<{pages.schema[page].dataType.simpleString()}>"))
    return s.join(each, ["book_id", "_lo", "_hi"], "left").withColumn(page, F.coalesce(page, none)).select(*spans.columns, page)


def page_text(spans: DataFrame, pages: DataFrame, n_pages: DataFrame) -> DataFrame:
    """spans with the text of their pages (ranges()), joined by newlines; '' for none. pages: (book_id, page_idx from 0, text)."""
    return in_order(spans, pages, n_pages, "text", lambda texts: F.array_join(texts, "\n"))


def page_digests(spans: DataFrame, pages: DataFrame, n_pages: DataFrame) -> DataFrame:
    """spans with n_chars and digest (MD5) of page_text()'s text, page by page in order: no text is put together, however many pages a span has."""
    s = ranges(spans, n_pages)

    def run(batches):
        key, md5, n = None, None, 0
        for batch in batches:
            out = []
            for *new, text in zip(*(batch.column(c).to_pylist() for c in ("book_id", "_lo", "_hi", "_t")), strict=True):
                if new != key:
                    if key is not None:
                        out.append((*key, n, md5.hexdigest()))
                    key, md5, n = new, hashlib.md5(usedforsecurity=False), -1
                else:
                    md5.update(b"\n")
                md5.update(text.encode())
                n += 1 + len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TOLD, strict=True)], ["book_id", "_lo", "_hi", "n_chars", "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, n, md5.hexdigest()), TOLD, strict=True)], ["book_id", "_lo", "_hi", "n_chars", "digest"])

    by = ["book_id", "_lo", "_hi"]
    found = pages_of(s, pages.select("book_id", "page_idx", F.col("text").alias("_t")).filter("_t is not null"))
    told = found.repartition(*by).sortWithinPartitions(*by, "page_idx").select(*by, "_t").mapInArrow(run, "book_id string, _lo int, _hi int, n_chars long, digest string")
    none = F.lit(hashlib.md5(usedforsecurity=False).hexdigest())
    rows = s.join(told, by, "left")
    return rows.select(*spans.columns, F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("digest", none).alias("digest"))


TOLD = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
