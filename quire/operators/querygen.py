"""Query generation: prompts, a response cache, a pluggable backend, parsing and the title-leak filter."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import cache_key, leaks_title, parse_questions
from quire.session import materialize

Backend = Callable[[str], str]


def prompts(sections: DataFrame, template: str, n: int = 3, max_chars: int = 4000) -> DataFrame:
    """Sections of 200 characters or more with prompt and key; the template has {n} and {text}."""
    parts = template.replace("{n}", str(n)).split("{text}")
    cols: list[Column] = []
    for k, part in enumerate(parts):
        cols += ([F.substring("text", 1, max_chars)] if k else []) + [F.lit(part)]
    rows = sections.filter(F.length("text") >= 200).withColumn("prompt", F.concat(*cols))
    return rows.withColumn("key", cache_key(F.col("prompt")))


def load_cache(rows: DataFrame) -> DataFrame:
    """rows (seq, key, response), nulls being malformed lines: the last response of each key."""
    return rows.filter(F.col("key").isNotNull() & F.col("response").isNotNull()).groupBy("key").agg(F.max_by("response", "seq").alias("response"))


def probe(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked with response and hit."""
    return asked.join(cache, "key", "left").withColumn("hit", F.col("response").isNotNull())


def respond(misses: DataFrame, backend: Backend) -> DataFrame:
    """key, response, error for each distinct prompt; a failure is a row, not a failed job. The caller appends the responses to the cache."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["key"], pdf["prompt"], strict=True):
                try:
                    out.append((key, backend(prompt), None))
                except Exception as e:  # noqa: BLE001  a backend may fail in any way
                    out.append((key, None, f"{type(e).__name__}: {e}"[:90]))
            yield pd.DataFrame(out, columns=["key", "response", "error"])

    return misses.dropDuplicates(["key"]).select("key", "prompt").mapInPandas(run, "key string, response string, error string")


def questions(answered: DataFrame, n: int = 3) -> DataFrame:
    """answered (book_id, seq, docid, response): kept questions with qid (book:section:question, numbered after the filter) and what was dropped."""
    rows = answered.withColumn("_q", parse_questions(F.col("response"), n))
    kept = F.filter("_q", lambda q: ~leaks_title(q, F.col("docid")))
    return rows.withColumn("kept", kept).withColumn("dropped", F.size("_q") - F.size("kept")).drop("_q")


def with_ids(parsed: DataFrame) -> DataFrame:
    """book_id, qid, text, docid: a row for each kept question."""
    return parsed.select("book_id", "seq", "docid", F.posexplode("kept").alias("j", "text")).select("book_id", F.concat_ws(":", "book_id", "seq", "j").alias("qid"), "text", "docid")


def generate(sections: DataFrame, template: str, backend: Backend, n: int = 3, max_chars: int = 4000, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed, failed, new): questions() of every section that was answered, the sections that weren't (book_id, seq, error), and the
    responses to append to the cache (key, response). Only what the cache lacks goes to the backend, each prompt once; new is written, so it is asked once."""
    asked = prompts(sections, template, n, max_chars)
    held = asked.withColumn("response", F.lit(None).cast("string")) if cache is None else probe(asked, cache).drop("hit")
    new = materialize(respond(held.filter("response is null"), backend), "responses")
    rows = held.join(new.select("key", F.col("response").alias("_new"), "error"), "key", "left").withColumn("response", F.coalesce("response", "_new")).drop("_new")
    failed = rows.filter("response is null").select("book_id", "seq", "error")
    return questions(rows.filter("response is not null").drop("error"), n), failed, new.filter("response is not null").select("key", "response")


def generation_stats(parsed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    rows = parsed.groupBy("book_id").agg(F.count("*").alias("sections"), F.sum(F.size("kept")).alias("queries"), F.sum("dropped").alias("dropped_title_leakage"))
    if failed is None:
        return rows.withColumn("failed_sections", F.lit(0).cast("long"))
    return rows.join(failed.groupBy("book_id").agg(F.count("*").alias("failed_sections")), "book_id", "left").na.fill(0, ["failed_sections"])
