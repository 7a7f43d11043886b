"""Retrieval metrics and their aggregates. Gold is left-joined: a query without predictions is a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ndcg_at, recall_at


def each_system(predictions: DataFrame, gold: DataFrame, systems: list[tuple[str, int]]) -> DataFrame:
    """gold (book_id, qid, docid) once for each system (system, sys_seq) with what it ranked, empty for none. Predictions meet gold once a query, whatever the number of systems. They may come so already: (book_id, qid, _p)."""
    held = predictions if "_p" in predictions.columns else predictions.groupBy("book_id", "qid").agg(F.collect_list(F.struct("system", "ranked")).alias("_p"))
    rows = for_systems(gold.join(held, ["book_id", "qid"], "left"), systems)
    own = F.transform(F.filter("_p", lambda x: x["system"] == F.col("system")), lambda x: x["ranked"])
    rows = rows.withColumn("ranked", F.explode_outer(own)).drop("_p")
    return rows.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))


def per_query(predictions: DataFrame, gold: DataFrame, keys: list[str], k: int = 1, systems: list[tuple[str, int]] | None = None) -> DataFrame:
    """predictions (keys + ranked), gold (keys + docid): a score of 1 or 0 for each gold row. systems: gold is without them and scored for each."""
    rows = gold.join(predictions, keys, "left") if systems is None else each_system(predictions, gold, systems)
    return rows.select(*keys, recall_at(F.coalesce("ranked", F.array().cast("array<string>")), F.col("docid"), k).alias("score"))


def evaluate(predictions: DataFrame, gold: DataFrame, by: list[str], valid: DataFrame | None = None, systems: list[tuple[str, int]] | None = None) -> DataFrame:
    """predictions (by, book_id, qid, ranked), gold (by, book_id, qid, docid), valid (book_id, docid): one row for each `by`. systems: gold is without them and judged for each."""
    keys = list(dict.fromkeys([*by, "book_id", "qid"]))
    rows = gold.join(predictions, keys, "left") if systems is None else each_system(predictions, gold, systems)
    rows = rows.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>"))).withColumn("_top", F.get("ranked", F.lit(0)))
    answered = F.size("ranked") > 0
    if valid is not None:
        ids = valid.select("book_id", F.col("docid").alias("_top"), F.lit(True).alias("_valid")).distinct()
        rows = rows.join(ids, ["book_id", "_top"], "left")
    mean = lambda c: F.round(100 * F.avg(c), 2)
    out = [F.count("*").alias("n_queries"), mean(recall_at(F.col("ranked"), F.col("docid"), 1)).alias("r1"), mean(recall_at(F.col("ranked"), F.col("docid"), 3)).alias("r3"), mean(ndcg_at(F.col("ranked"), F.col("docid"), 3)).alias("ndcg3"), F.count_if(answered).alias("answered")]
    if valid is not None:
        wrong = F.count_if(answered & F.col("_valid").isNull())
        out.append(F.round(100 * wrong / F.greatest(F.lit(1), F.count_if(answered)), 4).alias("hallucination_rate"))
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*out)


def systems_of(predictions: DataFrame, most: int = 1000) -> list[tuple[str, int]]:
    """The systems (name, order) of a run: a handful, which is checked."""
    order = F.min("sys_seq") if "sys_seq" in predictions.columns else F.lit(0)
    found = predictions.groupBy("system").agg(order.alias("o")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} systems")
    return sorted(((r["system"], r["o"]) for r in found), key=lambda x: (x[1], x[0]))


def for_systems(gold: DataFrame, systems: list[tuple[str, int]]) -> DataFrame:
    """gold once for each system (system, sys_seq): rows are multiplied in place, nothing is joined."""
    each = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("sys_seq")) for s, k in systems])
    return gold.withColumn("_s", F.explode(each)).select(*gold.columns, "_s.system", "_s.sys_seq")


def evaluate_dev(predictions: DataFrame, gold: DataFrame, by: list[str], n: int, order: str = "seq", systems: list[tuple[str, int]] | None = None) -> DataFrame:
    """evaluate() over the first n gold queries of each book, in order; 0: all."""
    from quire.sources.readers import first_of

    kept = first_of(gold.select("book_id", "qid", order).distinct(), n, ["book_id"], order).select("book_id", "qid")
    return evaluate(predictions, gold.join(kept, ["book_id", "qid"], "left_semi").drop(order), by, systems=systems)


def over_published(metrics: DataFrame, published: DataFrame, by: list[str]) -> DataFrame:
    """Metrics over all published queries, those without a section in the corpus counted as failures; rounded from the rounded ones."""
    rows = metrics.join(published, by)
    return rows.select(*by, *[F.round(F.col(c) * F.col("n_queries") / F.col("published"), 2).alias(f"{c}_all") for c in ("r1", "r3", "ndcg3")])


def orphans(questions: DataFrame, leaves: DataFrame) -> DataFrame:
    """questions (book_id, leaf_id), leaves (book_id, leaf_id): questions without their leaf, in one pass."""
    known = leaves.select("book_id", "leaf_id").distinct().withColumn("_k", F.lit(True))
    rows = questions.join(known, ["book_id", "leaf_id"], "left")
    return rows.groupBy("book_id").agg(F.count_if(F.col("_k").isNull()).alias("orphans"), F.count("*").alias("total"))


def macro(metrics: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over books of the books' metrics."""
    return metrics.groupBy(*(by or [])).agg(*[F.round(F.avg(c), 2).alias(f"macro_{c}") for c in columns])


def orphan_rates(counted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Percent of published questions without a section, over what orphans() counted."""
    return counted.groupBy(*(by or [])).agg(F.sum("orphans").alias("orphans"), F.sum("total").alias("total"), F.round(100 * F.sum("orphans") / F.sum("total"), 2).alias("orphan_pct"))


def shared_coverage(queries: DataFrame, old: DataFrame, least: float = 0.8) -> DataFrame:
    """Old runs (system, qid) that answer at least that share of the queries (qid)."""
    n = queries.select(F.countDistinct("qid").alias("n_queries"))
    shared = old.join(queries.select("qid").distinct(), "qid", "left_semi").groupBy("system").agg(F.countDistinct("qid").alias("n_shared"))
    return shared.join(F.broadcast(n)).filter(F.col("n_shared") >= least * F.col("n_queries"))


def compare(predictions: DataFrame, gold: DataFrame, k: int = 1, systems: list[tuple[str, int]] | None = None) -> DataFrame:
    """Every pair of systems (system, sys_seq) on gold (book_id, qid, docid): the exact test on hits at k. systems: if they are known; else they are looked up."""
    from quire.operators import significance

    scores = per_query(predictions, gold, ["system", "sys_seq", "book_id", "qid"], k, systems or systems_of(predictions))
    return significance.exact(significance.pairs(scores, ["book_id", "qid"])).withColumn("k", F.lit(k))
