"""Connected components of links, by alternating large and small stars; everything stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the smallest of its neighbours and itself.
    Small star: so is every neighbour that isn't larger, and the node itself."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """links: a, b (long). Returns node, label: the smallest node reachable, for every node that has a link.

    Each round is written to the shared folder. Self links and nulls are left out; repeated links do no harm. Rounds
    needed grow with the logarithm of a component's size; if `most_rounds` did not suffice, an error is raised.
    """
    links = materialize(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), tag)
    before = None
    for _ in range(most_rounds):
        links = materialize(_star(_star(links, True), False), tag)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now
    raise RuntimeError("components did not converge")
