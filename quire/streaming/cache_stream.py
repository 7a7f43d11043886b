"""The response cache and the epoch log as streams: both only ever grow by appended JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.readers import CACHE

HISTORY = "book string, variant string, epoch int, dev_r1 double"


def cache_upserts(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Appends each new response once to a Parquet cache: a batch's last response of each key, with the batch as its order."""
    rows = spark.readStream.schema(CACHE).json(in_dir).filter("key is not null and response is not null")

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("key").agg(F.last("response").alias("response"))
        # a path of its own for each batch: a batch that is run again writes the same rows over its own
        latest.withColumn("seq", F.lit(number)).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_epochs(spark: SparkSession, in_dir: str, name: str, checkpoint: str) -> StreamingQuery:
    """A running table of each cell's best score and last epoch, from the epoch log."""
    rows = spark.readStream.schema(HISTORY).json(in_dir)
    best = rows.groupBy("book", "variant").agg(F.max("dev_r1").alias("best"), F.max("epoch").alias("last_epoch"))
    return best.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
