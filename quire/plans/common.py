"""How the driver tables stand for books: a source is a book, a document a leaf section, its first line the title."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.split("text", "\n")[0]
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("seq"), title.alias("docid"), F.array("source", "lang", title).alias("path"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), "text")


SECTIONS = """sections AS (
  SELECT source AS book_id, doc_id AS seq, split_part(text, chr(10), 1) AS docid, [source, lang, split_part(text, chr(10), 1)] AS path, text FROM documents)"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asked of every book."""
    books = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("item_id").alias("seq"), "text")
    return items.join(books)


SYSTEMS = [("by_line", 0), ("by_quantity", 1), ("by_part", 2)]


def rankings(spark: SparkSession, sf_dir: str, kept: bool = False, held: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, gold and valid ids from orders: an order asks for its dearest line's supplier; three systems rank its suppliers.

    All come from one list of lines an order, so one shuffle serves them; kept: it is written, for queries of several jobs. held: predictions have a row for each query (_p: system, sys_seq, ranked)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.struct("l_linenumber", "l_quantity", "l_partkey", "l_extendedprice", F.col("l_suppkey").cast("string").alias("docid")).alias("line")
    lines = lines.select(F.col("o_orderpriority").alias("book_id"), F.col("l_orderkey").cast("string").alias("qid"), line)
    orders = dict(zip((s for s, _ in SYSTEMS), (("l_linenumber",), ("l_quantity", "l_linenumber"), ("l_partkey", "l_linenumber")), strict=True))
    by = lambda cols: F.arrays_zip(*[F.col(f"lines.{c}") for c in (*cols, "docid")])
    rank = lambda cols: F.array_distinct(F.sort_array(by(cols))["docid"])
    ranked = lines.groupBy("book_id", "qid").agg(F.collect_list("line").alias("lines"))
    if kept:
        ranked = materialize(ranked, "rankings")
    each = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(i).alias("sys_seq"), rank(c).alias("ranked")) for i, (s, c) in enumerate(orders.items())])
    # no filter: it would be pushed below the shuffle, which then serves predictions only
    asked = F.when(F.col("qid").cast("long") % 10 != 3, each).otherwise(F.array().cast("array<struct<system:string,sys_seq:int,ranked:array<string>>>"))
    predictions = ranked.select("book_id", "qid", asked.alias("_p")) if held else ranked.select("book_id", "qid", F.explode(asked).alias("s")).select("book_id", "qid", "s.system", "s.sys_seq", "s.ranked")
    gold = ranked.select("book_id", "qid", F.array_max(by(("l_extendedprice", "l_linenumber")))["docid"].alias("docid"))
    valid = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("docid")).join(F.broadcast(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("book_id")).distinct()))
    return predictions, gold, valid


RANKINGS = """lines AS (
  SELECT o_orderpriority AS book_id, CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_suppkey AS VARCHAR) AS docid, l_linenumber, l_quantity, l_extendedprice, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
each AS (
  SELECT book_id, qid, docid, 'by_line' AS system, 0 AS sys_seq, row_number() OVER (PARTITION BY book_id, qid ORDER BY l_linenumber, docid) AS r FROM lines
  UNION ALL SELECT book_id, qid, docid, 'by_quantity', 1, row_number() OVER (PARTITION BY book_id, qid ORDER BY l_quantity, l_linenumber, docid) FROM lines
  UNION ALL SELECT book_id, qid, docid, 'by_part', 2, row_number() OVER (PARTITION BY book_id, qid ORDER BY l_partkey, l_linenumber, docid) FROM lines),
firsts AS (SELECT book_id, qid, system, sys_seq, docid, min(r) AS r FROM each GROUP BY ALL),
predictions AS (
  SELECT book_id, qid, system, sys_seq, docid, row_number() OVER (PARTITION BY book_id, qid, system ORDER BY r) AS rank FROM firsts WHERE CAST(qid AS BIGINT) % 10 <> 3),
gold AS (
  SELECT book_id, qid, docid FROM (SELECT *, row_number() OVER (PARTITION BY book_id, qid ORDER BY l_extendedprice DESC, l_linenumber DESC, docid DESC) AS g FROM lines) WHERE g = 1),
systems AS (SELECT DISTINCT system, sys_seq FROM each),
valid AS (SELECT CAST(s_suppkey AS VARCHAR) AS docid FROM supplier WHERE s_acctbal > 0),
judged AS (
  SELECT s.system, s.sys_seq, g.book_id, g.qid, p.rank, EXISTS (SELECT 1 FROM predictions q WHERE q.system = s.system AND q.book_id = g.book_id AND q.qid = g.qid) AS answered,
         t.docid AS top, t.docid IN (SELECT docid FROM valid) AS top_valid
  FROM gold g CROSS JOIN systems s
  LEFT JOIN predictions p ON p.system = s.system AND p.book_id = g.book_id AND p.qid = g.qid AND p.docid = g.docid
  LEFT JOIN predictions t ON t.system = s.system AND t.book_id = g.book_id AND t.qid = g.qid AND t.rank = 1)"""
