"""The stages of the corpus pipeline: language ID, near-dedup, decontamination, secret scan, mixing.

Each takes (spark, docs, sf_dir), docs with the columns of documents, and works on all rows it is given. In every stage null texts count as
empty, empty tables give empty results, texts are read whole, repeated rows are repeated rows (but for near-dedup, which keeps one), and further columns
pass through, whatever their names (but for mixing, whose rows are draws).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language, mixing, secrets_scan, simhash
from quire.session import ship, small_batches, table


def _ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence settles stay; the rest go. Rows of equal text and evidence are judged alike."""
    _ready(spark)
    return language.identify(docs, language.train_text_model(docs), text=F.col("text"), declared=F.col("lang"), host=F.col("source"), keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays: that with the smallest id, then the smallest text hash."""
    _ready(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, within its error budget, go."""
    _ready(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place (n_chars follows); every document stays."""
    _ready(spark)
    return secrets_scan.redact_secrets(docs, secrets_scan.MarkovPair.train(secrets_scan.labelled_samples()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row (id, source, tokens, weight, epoch, block, at) for each time a document is drawn. Equal ids are ordered by their tokens."""
    _ready(spark)
    return mixing.mix(docs)
