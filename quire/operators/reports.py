"""Reports over runs: sweeps, early stopping, printed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep_pivot(history: DataFrame, variants: tuple[str, str] = ("toc", "no-toc")) -> DataFrame:
    """history (book, variant, epoch, dev_r1): book, first, second and gap: a row a book with the best of both variants and their difference, null where one is missing."""
    first, second = (F.max(F.when(F.col("variant") == v, F.col("dev_r1"))) for v in variants)
    return history.groupBy("book").agg(first.alias("first"), second.alias("second"), F.round(first - second, 2).alias("gap"))


def cells(books: DataFrame, variants: tuple[str, ...] = ("toc", "no-toc")) -> DataFrame:
    """books (book, at): cell "book:variant" for every book, in order, and variant."""
    return books.select("book", "at", F.posexplode(F.array(*map(F.lit, variants))).alias("nth", "variant")).select(F.concat_ws(":", "book", "variant").alias("cell"), "book", "variant", (F.col("at") * len(variants) + F.col("nth")).alias("place"))


def early_stop(history: DataFrame, patience: int = 3) -> DataFrame:
    """history with best_so_far, improved (strictly), bad (epochs since) and kept (up to the epoch at which bad reaches patience)."""
    w = Window.partitionBy("book", "variant").orderBy("epoch")
    before = F.max("dev_r1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("improved", before.isNull() | (F.col("dev_r1") > before)).withColumn("best_so_far", F.max("dev_r1").over(w))
    rows = rows.withColumn("_run", F.sum(F.col("improved").cast("int")).over(w))
    rows = rows.withColumn("bad", (F.row_number().over(Window.partitionBy("book", "variant", "_run").orderBy("epoch")) - 1).cast("int"))
    stopped = F.max((F.col("bad") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("kept", F.coalesce(stopped, F.lit(0)) == 0).drop("_run")


def undone(cells: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return cells if force else cells.join(done, "cell", "left_anti")


def epoch_order(examples: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """The order of an epoch: by a digest, so partitioning has no say."""
    return examples.orderBy(epoch_digest(seed, epoch, key), key)


def epoch_digest(seed: int, epoch: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string")))


def total_kept(manifest: DataFrame) -> DataFrame:
    """manifest (book_id, n_leaves): sections kept over all books."""
    return manifest.agg(F.count("*").alias("books"), F.sum("n_leaves").alias("total_kept"))


def metric_lines(metrics: DataFrame, columns: tuple[str, ...] = ("r1", "r3", "ndcg3", "hallucination_rate"), width: int = 24) -> DataFrame:
    """metrics (system and columns): system, line: its name and its figures in fields of one width, a missing one blank."""
    figures = [F.lpad(F.coalesce(F.format_string("%.2f", F.col(c).cast("double")), F.lit("")), 12, " ") for c in columns]
    blank = [F.when(F.col(c).isNull(), F.lpad(F.lit(""), 12, " ")).otherwise(f) for c, f in zip(columns, figures, strict=True)]
    return metrics.select("system", F.concat(F.rpad(F.col("system"), width, " "), *blank).alias("line"))


def comparison_lines(compared: DataFrame) -> DataFrame:
    """a, b, line: the verdict on each pair."""
    verdict = F.when(F.col("significant"), "SIGNIFICANT").otherwise("not significant — consistent with noise")
    sign = F.when(F.col("observed_diff") < 0, "").otherwise("+")
    return compared.select("a", "b", F.concat(F.rpad(F.concat_ws(" vs ", "a", "b"), 26, " "), F.lpad(F.concat(sign, F.format_string("%.2f", "observed_diff")), 9, " "), F.lpad(F.format_string("%.4f", "p_value"), 9, " "), F.lit("  "), verdict).alias("line"))


#: The report's head and the width of its rule.
HEAD = (("comparison", -26), ("diff", 9), ("p", 9))
RULE = 62


def comparison_report(compared: DataFrame) -> DataFrame:
    """at, line: a head, a rule and a line for each pair of systems, by name. Pairs without a p-value (they share no query) have no line."""
    spark = compared.sparkSession
    head = "".join(word.ljust(-n) if n < 0 else word.rjust(n) for word, n in HEAD) + "  verdict"
    lines = comparison_lines(compared.filter("p_value is not null"))
    numbered = lines.select((F.row_number().over(Window.orderBy("a", "b")) + 1).alias("at"), "line")  # a row for each pair of systems
    return spark.createDataFrame([(0, head), (1, "-" * RULE)], "at int, line string").unionByName(numbered)


def audit(rendered: DataFrame, budgets: tuple[int, ...] = (14_000, 8_000, 4_000)) -> DataFrame:
    """rendered (book_id, toc): estimated tokens and whether they are below each budget."""
    from quire.functions.text import est_tokens

    rows = rendered.select("book_id", est_tokens(F.col("toc")).alias("tokens"))
    return rows.select("*", *[(F.col("tokens") < b).alias(f"below_{b}") for b in budgets])


def cache_counts(probed: DataFrame) -> DataFrame:
    return probed.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
