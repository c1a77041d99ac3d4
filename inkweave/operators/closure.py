"""Dependency closure: continuation chains and shared sidebars, followed to a fixed point.

Chains are collapsed to islands first (one pass, no iteration), so the loop only alternates
between islands and sidebars and ends after as many rounds as sidebars are chained.  Each
round cuts its lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.sequence import continuation_islands
from inkweave.sources.scratch import cut


def components(units: DataFrame) -> DataFrame:
    """``project_id, unit_id, pos, component``: the smallest position that a unit depends on, directly or not."""
    chain = continuation_islands(units)
    side = units.select("project_id", "unit_id", F.col("sidebar_id").alias("sidebar"))
    nodes = cut(chain.join(side, ["project_id", "unit_id"]).select("project_id", "unit_id", "pos", "island", "sidebar"))
    edges = cut(nodes.where(F.col("sidebar").isNotNull()).select("project_id", "island", "sidebar").distinct())
    labels = nodes.groupBy("project_id", "island").agg(F.min("pos").alias("label"))
    while not edges.isEmpty():
        over = edges.join(labels, ["project_id", "island"]).groupBy("project_id", "sidebar").agg(F.min("label").alias("low"))
        reach = edges.join(over, ["project_id", "sidebar"]).groupBy("project_id", "island").agg(F.min("low").alias("low"))
        new = labels.join(reach, ["project_id", "island"], "left").select("project_id", "island", F.least("label", F.coalesce("low", "label")).alias("label"), (F.col("low") < F.col("label")).alias("moved"))
        new = cut(new)
        labels = new.select("project_id", "island", "label")
        if new.where("moved").isEmpty():
            break
    return nodes.join(labels, ["project_id", "island"]).select("project_id", "unit_id", "pos", F.col("label").alias("component"))


def closure(units: DataFrame, seeds: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``project_id, unit_id, pos``: the seeds, their neighbours inside ``scope``, and all they depend on.

    ``seeds(unit_id)``; unknown seeds are dropped.  ``scope(unit_id, batch_id)`` limits the step
    to the neighbours; without it all neighbours count.
    """
    base = units.select("project_id", "unit_id", "pos")
    s = base.join(seeds.select("unit_id").distinct(), "unit_id", "left_semi")
    near = s.select("project_id", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"), F.col("unit_id").alias("seed"))
    first = near.join(base, ["project_id", "pos"]).select("project_id", "unit_id", "pos", "seed")
    if scope is not None:
        own = scope.select("unit_id", "batch_id").distinct()
        first = first.join(own, "unit_id").join(own.select(F.col("unit_id").alias("seed"), F.col("batch_id").alias("seed_batch")), "seed").where("batch_id = seed_batch OR unit_id = seed")
    parts = components(units)
    reached = parts.join(first.select("project_id", "unit_id").distinct(), ["project_id", "unit_id"], "left_semi").select("project_id", "component").distinct()
    return parts.join(reached, ["project_id", "component"], "left_semi").select("project_id", "unit_id", "pos")
