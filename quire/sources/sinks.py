"""Sinks: sections, manifests, predictions, metrics, caches, histories and sweep states."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").partitionBy("book_id").json(path)


def write_run(predictions: DataFrame, metrics: DataFrame, comparisons: DataFrame, path: str) -> None:
    """Predictions are kept, so a comparison never makes them anew."""
    for name, rows in (("predictions", predictions), ("metrics", metrics), ("comparisons", comparisons)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def append_history(epochs: DataFrame, path: str) -> None:
    epochs.write.mode("append").json(path)


def write_queries(queries: DataFrame, path: str) -> None:
    queries.write.mode("overwrite").partitionBy("book_id").json(path)


def write_state(state: DataFrame, path: str) -> None:
    """state (cell, status, code): small, rewritten whole."""
    state.coalesce(1).write.mode("overwrite").json(path)
