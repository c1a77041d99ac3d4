"""Chains of runs, recomputation by receipts, recall and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.sources.scratch import cut


def roots(runs: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, root, depth``: the run that a chain of parents ends at; cycles end where they would repeat.

    Pointers are doubled each round, so a chain of n runs takes log n rounds; each round cuts
    its lineage.  A parent that doesn't exist is the root itself; runs in a cycle get the
    smallest key of their cycle and depth -1.
    """
    step = cut(runs.select(F.col(key).alias("k"), F.col(parent).alias("p")).groupBy("k").agg(F.min("p").alias("p")).select("k", F.coalesce("p", "k").alias("at"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("p").isNull().alias("done"), F.least("k", F.coalesce("p", "k")).alias("low")))
    limit = max(1, step.count()).bit_length() + 1
    for _ in range(limit):
        if step.where("NOT done").isEmpty():
            break
        other = step.select(F.col("k").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"), F.col("low").alias("lower"))
        step = cut(
            step.join(other, "at", "left").select(
                "k",
                F.when(F.col("done") | F.col("next").isNull(), F.col("at")).otherwise(F.col("next")).alias("at"),
                F.when(F.col("done") | F.col("next").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"),
                (F.col("done") | F.col("next").isNull() | F.coalesce("ends", F.lit(False))).alias("done"),
                F.least("low", F.coalesce("lower", "low")).alias("low"),
            )
        )
    return step.select(F.col("k").alias(key), F.when(F.col("done"), F.col("at")).otherwise(F.col("low")).alias("root"), F.when(F.col("done"), F.col("depth")).otherwise(-1).alias("depth"))


def to_recompute(current: DataFrame, receipts: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Rows of ``current`` without a passed receipt of the same key and fingerprint."""
    good = receipts.where("passed").select(*keys, fingerprint)
    return current.join(good, [*keys, fingerprint], "left_anti")


def recall(gold: DataFrame, found: DataFrame, on: list[str], by: str) -> DataFrame:
    """``by, gold, hit``: gold rows by group and how many of them were found (each gold row counts)."""
    hits = found.select(*on).distinct().withColumn("__hit", F.lit(1))
    return gold.join(hits, on, "left").groupBy(by).agg(F.count("*").alias("gold"), F.count("__hit").alias("hit"))


def reductions(df: DataFrame, group: str, variant: str, value: str, base: str, other: str) -> DataFrame:
    """``group, base, other, reduction``: medians by variant and the share saved (0 where the base is 0)."""
    m = df.groupBy(group).agg(F.median(F.when(F.col(variant) == base, F.col(value))).alias("base"), F.median(F.when(F.col(variant) == other, F.col(value))).alias("other"))
    return m.withColumn("reduction", F.when(F.col("base") == 0, 0.0).otherwise(1 - F.col("other") / F.col("base")))
