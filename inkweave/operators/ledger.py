"""Append-only ledgers: current state, change sets, merges, repeated states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of the named columns (ties by the whole row's hash).

    A partial maximum is taken before the shuffle, so a key of any size meets no single task.
    """
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]).alias("tie"))
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("__r"))
    return top.select(*key, *[F.col("__r")[c].alias(c) for c in rest])


def change_set(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed or changed; a null value is a value."""
    a = current.select(key, F.col(value).alias("new"), F.lit(True).alias("here"))
    b = previous.select(key, F.col(value).alias("old"), F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(~F.col("new").eqNullSafe(F.col("old")), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where(F.col("change").isNotNull())


def upsert(current: DataFrame, submitted: DataFrame, key: str, payload: Column, bound: str) -> DataFrame:
    """Merge a submission: equal payload keeps the revision, another raises it, a new key starts at 1.

    An equal payload bound to another ``bound`` value (a source hash) keeps the revision and
    is marked ``rebound``.  ``key, revision, action``; rows of ``current`` that weren't
    submitted stay as ``kept``.
    """
    c = current.select(key, F.col("revision").alias("had"), payload.alias("old"), F.col(bound).alias("old_bound"))
    s = submitted.select(key, payload.alias("new"), F.col(bound).alias("new_bound"), F.lit(True).alias("given"))
    same = F.col("old").eqNullSafe(F.col("new"))
    action = (
        F.when(F.col("given").isNull(), "kept").when(F.col("had").isNull(), "inserted").when(~same, "revised").when(~F.col("old_bound").eqNullSafe(F.col("new_bound")), "rebound").otherwise("unchanged")
    )
    revision = F.when(F.col("had").isNull(), 1).when(action == "revised", F.col("had") + 1).otherwise(F.col("had"))
    return c.join(s, key, "full").select(key, revision.cast("int").alias("revision"), action.alias("action"))


def submission_diff(expected: DataFrame, submitted: DataFrame, key: str) -> DataFrame:
    """``key, problem``: missing, extra or duplicate keys of a submission."""
    s = submitted.groupBy(key).agg(F.count("*").alias("n"))
    e = expected.select(key).distinct().withColumn("wanted", F.lit(True))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return e.join(s, key, "full").select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with multiplicity, less those of ``b``."""
    return a.exceptAll(b)


def resolve(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Issues with the state of their resolution (type 1: overwritten); a resolution of an unknown issue is an error, one without an id says nothing."""
    resolutions = resolutions.where("issue_id IS NOT NULL")
    unknown = resolutions.join(issues, "issue_id", "left_anti").select("issue_id").first()
    if unknown is not None:
        raise ValueError(f"there is no issue {unknown[0]}")
    r = resolutions.select("issue_id", F.col("status").alias("s"), F.col("resolution").alias("r"))
    kept = [c for c in issues.columns if c not in ("status", "resolution")]
    return issues.join(r, "issue_id", "left").select(*kept, F.coalesce("s", "status").alias("status"), F.coalesce("r", "resolution").alias("resolution"))
