"""Whole jobs put together from the operators: build, audit, generate, evaluate, compare with old runs. Each writes what later ones read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import metrics, querygen, render, reports
from quire.operators import sections as so
from quire.session import materialize
from quire.sources import readers, sinks


def build_corpora(entries: DataFrame, pages: DataFrame, n_pages: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Sections of all books, written, and their manifest (raw against kept), written: (sections, manifest)."""
    raw = so.build_corpus(entries, pages, n_pages, front_matter=False, unique_docids=False, min_chars=0)
    kept = so.build_corpus(entries, pages, n_pages)
    readers.save_sections(kept, f"{out}/sections")
    sinks.write_manifest(so.manifest(raw, kept), f"{out}/manifest")
    spark, schema = entries.sparkSession, so.manifest(raw, kept).schema
    return spark.read.schema(kept.schema).json(f"{out}/sections"), spark.read.schema(schema).json(f"{out}/manifest")


def audit_books(sections: DataFrame, budgets: tuple[int, ...] = (14_000, 8_000, 4_000)) -> DataFrame:
    """Statistics of each book, its table of contents' tokens and the budgets they fit."""
    return so.corpus_stats(sections).join(reports.audit(render.full(sections), budgets), "book_id")


def generate_queries(spark: SparkSession, sections: DataFrame, template: str, backend: querygen.Backend, cache_path: str, out: str, part: str | None = None, first: int = 0, n: int = 3) -> DataFrame:
    """Questions of the chosen books' sections, written by book; answers go to the cache and come from it. Returns the statistics."""
    chosen = readers.pick_books(sections, part, first)
    cache = querygen.load_cache(readers.read_lines(spark, cache_path, readers.CACHE, "DROPMALFORMED", appended=True)) if readers.exists(spark, cache_path) else None
    parsed, failed, new = querygen.generate(chosen, template, backend, n, cache=cache)
    sinks.write_queries(querygen.with_ids(parsed), out)
    stats = querygen.generation_stats(parsed, failed)
    readers.append_cache(new, cache_path)
    return stats


def evaluate_runs(spark: SparkSession, predictions: DataFrame, gold: DataFrame, published: int, out: str, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """predictions (system, sys_seq, book_id, qid, ranked): (metrics of each system, also over all published queries; comparisons of every pair), written with the run."""
    systems = metrics.systems_of(predictions)
    found = materialize(metrics.evaluate(predictions, gold, ["system"], systems=systems), "metrics")  # a row a system, read by what follows
    every = metrics.over_published(found, found.select("system", F.lit(published).alias("published")), ["system"])
    sinks.write_run(predictions, found.join(every, "system"), metrics.compare(predictions, gold, k, systems), out)
    return spark.read.parquet(f"{out}/metrics"), spark.read.parquet(f"{out}/comparisons")


def zero_shot(spark: SparkSession, gold: DataFrame, old: list[str], least: float = 0.8) -> DataFrame:
    """Metrics on gold of the old runs (paths of written ones; missing paths are passed over) that answer `least` of its queries."""
    found = [readers.read_run(spark, p).select("system", "book_id", "qid", "ranked") for p in old if readers.exists(spark, p)]
    if not found:
        raise ValueError("none of the old runs exists")
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    used = metrics.shared_coverage(gold.select("qid"), runs.select("system", "qid"), least).select("system")
    kept = runs.join(used, "system", "left_semi")
    return metrics.evaluate(kept, gold, ["system"], systems=metrics.systems_of(kept))
