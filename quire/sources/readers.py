"""Sources and sinks: JSON lines with explicit schemas, listings, caches and settings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.sections import leaf_titles

LEAVES = T.StructType([T.StructField("leaf_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType())])
QUESTIONS = T.StructType([T.StructField("leaf_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("split", T.StringType())])
SECTIONS = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("docid", T.StringType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()), T.StructField("text", T.StringType())])
CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("response", T.StringType())])


def read_lines(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST", appended: bool = False) -> DataFrame:
    """JSON lines in file order (seq); blank lines are skipped, malformed ones raise (or are dropped with mode DROPMALFORMED).

    seq increases with the file's path (with `appended`, its time of writing first), then the line: splits are ranked by path and offset (a table of splits, not of rows), and rows
    numbered within their split, however Spark deals the splits.
    """
    rows = spark.read.schema(schema).option("mode", mode).json(path)
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_offset")]
    time = F.col("_metadata.file_modification_time") if appended else F.lit(0)
    splits = rows.select(*split, time.alias("_time")).distinct().withColumn("_split", F.row_number().over(Window.orderBy("_time", "_file", "_offset")) - 1).drop("_time")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.select("*", *split, within.alias("_row")).join(splits, ["_file", "_offset"])
    return numbered.select(*[f.name for f in schema], F.shiftleft(F.col("_split").cast("long"), 33).bitwiseOR(F.col("_row")).alias("seq"))


def exists(spark: SparkSession, path: str) -> bool:
    """Is there something at the path, in whatever store?"""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listing(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """at, file, book_id (the name without its ending, 60 characters at most) of the files that match, in order of their names; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    return named.select((F.row_number().over(Window.orderBy("file", "path")) - 1).alias("at"), "file", F.substring(F.regexp_replace("file", r"\.[^.]*$", ""), 1, 60).alias("book_id"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Predictions (system, qid, ranked) that write_run() left under the path."""
    return spark.read.parquet(f"{path}/predictions")


def pick_books(sections: DataFrame, part: str | None = None, first: int = 0) -> DataFrame:
    """Sections of the books whose id holds `part`, the first n of each book in order (0: all)."""
    rows = sections if part is None else sections.filter(F.contains("book_id", F.lit(part)))
    return first_of(rows, first, ["book_id"])


def first_of(rows: DataFrame, n: int, by: list[str], order: str = "seq") -> DataFrame:
    """The first n rows of each group in order; 0: all."""
    if not n:
        return rows
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_at") <= n).drop("_at")


def best_for(history: DataFrame) -> DataFrame:
    """history (book, variant, epoch, dev_r1): the best of each cell that has been run."""
    return history.groupBy("book", "variant").agg(F.max("dev_r1").alias("best_dev_r1"))


def load_subset(spark: SparkSession, leaves: DataFrame, questions: DataFrame, split: str | None = "test") -> dict[str, DataFrame]:
    """leaves, questions: LEAVES and QUESTIONS with book_id and seq. sections, queries, gold, valid_docids and skipped (questions without a leaf).

    Gold is the leaf's title made unique; qids count all of a book's questions, those of other splits too.
    """
    named = leaf_titles(leaves)
    sections = named.select("book_id", "seq", "docid", F.array("docid").alias("path"), F.coalesce("page_start", F.lit(0)).alias("page_start"), F.coalesce("page_end", F.lit(0)).alias("page_end"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("seq")) - 1
    asked = questions.withColumn("qid", F.concat_ws(":", "book_id", n)).filter(F.lit(split is None) | F.col("split").eqNullSafe(F.lit(split)))
    titles = named.select("book_id", "leaf_id", "docid").distinct()
    found = asked.join(titles, ["book_id", "leaf_id"])
    return {
        "sections": sections,
        "queries": found.select("book_id", "qid", "seq", F.col("query").alias("text")),
        "gold": found.select("book_id", "qid", "docid"),
        "valid_docids": sections.select("book_id", "docid").distinct(),
        "skipped": asked.join(titles, ["book_id", "leaf_id"], "left_anti"),
    }


def split_queries(queries: DataFrame, gold: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and gold restricted to keep (qid)."""
    q = queries.join(keep.select("qid"), "qid", "left_semi")
    return q, gold.join(q.select("qid"), "qid", "left_semi")


def save_sections(sections: DataFrame, path: str) -> None:
    sections.write.mode("overwrite").json(path)


def append_cache(responses: DataFrame, path: str) -> None:
    responses.filter("response is not null").select("key", "response").write.mode("append").json(path)


def html_headings(pages: DataFrame, book: str = "book_id", html: str = "html") -> DataFrame:
    """toc entries (book_id, seq, level, title, page) from h1 to h6, in order; page is 1."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    rows = pages.select(F.col(book).alias("book_id"), F.posexplode(found).alias("seq", "h"))
    title = F.regexp_replace("h", r"(?s)<[^>]*>", " ")
    return rows.select("book_id", "seq", F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"), F.lit(1).alias("page"))


def pdf_tables(spark: SparkSession, path: str, reader) -> DataFrame:
    """book_id, kind ('toc' or 'page'), seq, level, title, page, text from PDF files; reader(bytes) -> (toc entries, page texts) is a plug-in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches):
        columns = ["book_id", "kind", "seq", "level", "title", "page", "text"]
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                book = name.rsplit("/", 1)[-1].rsplit(".", 1)[0][:60]
                toc, pages = reader(bytes(content))
                out += [(book, "toc", i, lv, t, p, None) for i, (lv, t, p) in enumerate(toc)]
                out += [(book, "page", i, None, None, i, x) for i, x in enumerate(pages)]
            yield pd.DataFrame(out, columns=columns)

    return files.mapInPandas(run, "book_id string, kind string, seq int, level int, title string, page int, text string")


def settings(lines: DataFrame) -> DataFrame:
    """lines (seq, value) of KEY=VALUE: name, setting, the first of each name; blanks, comments and lines without '=' are skipped, quotes stripped."""
    rows = lines.select("seq", F.trim("value").alias("v")).filter(~F.col("v").startswith("#") & F.col("v").contains("="))
    parts = F.split("v", "=", 2)
    rows = rows.select("seq", F.trim(parts[0]).alias("name"), F.regexp_replace(F.trim(parts[1]), "^[\"']+|[\"']+$", "").alias("setting"))
    return rows.groupBy("name").agg(F.min_by("setting", "seq").alias("setting"))


def read_state(spark: SparkSession, path: str) -> dict:
    """A small JSON state file; what can't be read is an empty state."""
    try:
        text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).limit(1).collect())
        return json.loads(text)
    except Exception:  # noqa: BLE001  missing or broken: start anew
        return {"done": [], "failed": []}
