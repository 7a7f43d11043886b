"""Mixing sources to target weights (operator 7): temperature mixing with budgeted block permutations.

Weights are the sources' token shares to the power of an exponent, normalised. The exponent is the largest in [0, 1]
whose weights have at least `entropy_share` of the greatest possible entropy, unless a source would then be repeated
more than `most_repeats` times; then it is the smallest that keeps this limit (bisection; each round of aggregation
halves the interval five times). An exponent of 1 leaves the shares as they are.

A budget of `budget_share` of all tokens is dealt by the weights. Each source's documents are hashed into blocks of
about `block_tokens` tokens (65,536 blocks at most). Each epoch of a source is a permutation of its blocks, of its
own; full epochs hold every document, the last one the blocks and documents that fit what is left of the source's
budget. `at` tells how far through its source's budget a row stands (0 to 1): the order by `at` has the target weights throughout.

Null sources are one source. Null and empty texts have no tokens; a source without tokens is drawn once. Equal ids are
ordered by their tokens. Only ids, sources and counts are shuffled, by source and block; nothing but sums reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

HALVINGS, ROUNDS = 5, 8


def words(text_col: str = "text") -> Column:
    """Tokens: runs of characters other than white space."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x09-\x0D]", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def draw(*parts) -> Column:
    """A number below 2^32 from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 8), 16, 10).cast("long")


def exponent(shares: DataFrame, budget_share: float, entropy_share: float, most_repeats: float) -> float:
    """shares: a row for each source with p > 0. Sums for 31 exponents at a time; nothing else is collected."""
    count = shares.count()
    if count < 2:
        return 1.0
    target = entropy_share * math.log(count)

    def look(grid):
        cols = []
        for k, a in enumerate(grid):
            cols += [F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"l{k}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"r{k}")]
        got = shares.agg(*cols).first()
        return [(math.log(got[f"z{k}"]) - a * got[f"l{k}"] / got[f"z{k}"], got[f"r{k}"] / got[f"z{k}"] * budget_share) for k, a in enumerate(grid)]

    def largest(holds, lo=0.0, hi=1.0) -> float:
        """The end of the interval, from 0, on which holds(entropy, repeats); halved HALVINGS times a round."""
        if holds(*look([hi])[0]):
            return hi
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * k / 2**HALVINGS for k in range(1, 2**HALVINGS)]
            seen = [holds(*x) for x in look(grid)]
            k = seen.index(False) if False in seen else len(seen)
            lo, hi = (grid[k - 1] if k else lo), (grid[k] if k < len(grid) else hi)
        return lo

    alpha = largest(lambda h, r: h >= target)
    # repeats fall as the exponent rises
    return alpha if look([alpha])[0][1] <= most_repeats else min(1.0, largest(lambda h, r: r > most_repeats) + (2.0 ** -(HALVINGS * ROUNDS)))


def mix(docs: DataFrame, tokens: Column | None = None, entropy_share: float = 0.95, most_repeats: float = 4.0, budget_share: float = 1.0, block_tokens: int = 1 << 16, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """id, source, n_tokens, weight, epoch, block, at: a row for each time a document is drawn."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(words() if tokens is None else tokens, F.lit(0)).cast("long").alias("n")), "mix-counts")
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    totals = materialize(rows.groupBy("key").agg(F.sum("n").alias("t")), "mix-totals")
    whole = totals.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    shares = totals.filter("t > 0").select("key", (F.col("t") / F.lit(float(max(whole, 1)))).alias("p"))
    alpha = exponent(shares, budget_share, entropy_share, most_repeats)
    z = shares.agg(F.coalesce(F.sum(F.pow("p", F.lit(alpha))), F.lit(1.0))).first()[0]
    p = F.col("t") / F.lit(float(max(whole, 1)))
    quota = F.floor(F.col("weight") * whole * budget_share + 1e-6).cast("long")  # a sum of shares may miss 1 by a rounding
    plan = (
        totals.withColumn("weight", F.when(F.col("t") > 0, F.pow(p, F.lit(alpha)) / F.lit(z)).otherwise(0.0))
        .withColumn("q", quota)
        .withColumn("full", F.when(F.col("t") > 0, F.floor(F.col("q") / F.col("t"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("q") - F.col("full") * F.col("t"))
        .withColumn("nb", F.least(F.lit(65_536), F.greatest(F.lit(1), F.ceil(F.col("t") / block_tokens))).cast("long"))
    )
    placed = rows.join(plan.select("key", "nb"), "key").withColumn("block", F.pmod(draw(F.lit(seed), F.col("key"), F.col("id")), F.col("nb")).cast("int")).drop("nb")
    # blocks: sums only, 65,536 of a source at most
    blocks = placed.groupBy("key", "block").agg(F.sum("n").alias("bt")).join(plan, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    order = Window.partitionBy("key", "epoch").orderBy(draw(F.lit(seed), F.col("key"), F.col("epoch"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    drawn = blocks.withColumn("start", F.coalesce(F.sum("bt").over(order), F.lit(0)))
    drawn = drawn.filter((F.col("epoch") < F.col("full")) | (F.col("start") <= F.col("rest"))).select("key", "block", "epoch", "start", "full", "rest", "t", "q", "weight")
    inside = Window.partitionBy("key", "block").orderBy(draw(F.lit(seed), F.lit("doc"), F.col("id")), "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    stood = placed.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = stood.join(drawn, ["key", "block"])
    out = out.filter((F.col("epoch") < F.col("full")) | (F.col("start") + F.col("before") + F.col("n") <= F.col("rest")))
    at = F.when(F.col("q") > 0, (F.col("epoch") * F.col("t") + F.col("start") + F.col("before")) / F.col("q")).otherwise(0.0)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("n").alias("n_tokens"), F.round("weight", 9).alias("weight"), "epoch", "block", F.round(at, 9).alias("at"))
