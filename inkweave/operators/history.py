"""Version history of changing attributes (slowly changing dimension, type 2).

The rows of an entity are folded by a higher-order function over a sorted array of
structs that keeps a version only where the state changes.  So that one entity may own
any share of the rows, the fold runs over *chunks*: the rows are range-partitioned by
(entity, time), a chunk is what one entity owns in one range partition, and neighbouring
chunks are stitched by a window over one narrow row per chunk and joined back to their runs.  No array is longer than
a range partition, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.sources.scratch import cut

OPEN_END = -1


def _fold(rows: Column) -> Column:
    """Array of (t, state) in time order -> array of the runs' first elements.

    An element stays where its state isn't that of the element before it, so the fold takes one
    look per element, however many versions there are.
    """
    return F.filter(rows, lambda x, i: (i == 0) | ~F.get(rows, i - 1)["state"].eqNullSafe(x["state"]))


def versions(
    df: DataFrame, key: str, state: list[str], at: str, order: str, partitions: int | None = None
) -> DataFrame:
    """Versions ``key, *state, valid_from_us, valid_to_us`` of each entity.

    * rows whose ``key`` or ``at`` is null don't count;
    * of an entity's rows with equal ``at`` the one with the largest ``order`` counts (null
      orders lose; of fully tied rows the largest state counts, so repeated rows are harmless);
    * a version is a longest run, in the order of ``at``, of equal ``state`` (nulls are equal);
    * ``valid_to_us`` of an entity's last version is ``-1``.

    Columns other than the named ones are ignored, so clashing names do no harm.  An empty
    table gives an empty result.
    """
    s = F.struct(*[F.col(c) for c in state])
    rows = (
        df.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .select(F.col(key).alias("k"), F.unix_micros(at).alias("t"), F.struct(F.col(order).alias("o"), s.alias("state")).alias("v"))
        .groupBy("k", "t")
        .agg(F.max("v").alias("v"))
        .select("k", "t", F.col("v.state").alias("state"))
    )
    ranged = rows.repartitionByRange(partitions, "k", "t") if partitions else rows.repartitionByRange("k", "t")
    chunks = (
        ranged.withColumn("chunk", F.spark_partition_id())
        .groupBy("k", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("t", "state"))).alias("rows"))
        .select("k", "chunk", _fold(F.col("rows")).alias("runs"))
    )
    chunks = cut(chunks)
    edges = chunks.select(
        "k", "chunk",
        F.col("runs")[0]["state"].alias("first"),
        F.element_at("runs", -1)["state"].alias("last"),
        F.col("runs")[0]["t"].alias("t1"),
        F.get("runs", F.lit(1))["t"].alias("t2"),
    )
    per = Window.partitionBy("k").orderBy("chunk")
    goes_on = F.coalesce(F.lag(F.lit(True)).over(per), F.lit(False)) & F.col("first").eqNullSafe(F.lag("last").over(per))
    edges = edges.withColumn("merged", goes_on)
    later = per.rowsBetween(1, Window.unboundedFollowing)
    start = F.when(F.col("merged"), F.col("t2")).otherwise(F.col("t1"))
    links = edges.select("k", "chunk", "merged", F.first(start, ignorenulls=True).over(later).alias("next"))
    own = F.when(F.col("merged"), F.slice("runs", F.lit(2), F.size("runs"))).otherwise(F.col("runs"))
    ended = chunks.join(links, ["k", "chunk"]).select("k", own.alias("runs"), "next")
    ends = F.concat(F.transform(F.slice("runs", F.lit(2), F.size("runs")), lambda r: r["t"]), F.array("next"))
    return (
        ended.where(F.size("runs") > 0)
        .select("k", F.explode(F.arrays_zip(F.col("runs").alias("run"), ends.alias("until"))).alias("x"))
        .select(
            F.col("k").alias(key),
            *[F.col("x.run.state")[c].alias(c) for c in state],
            F.col("x.run.t").alias("valid_from_us"),
            F.coalesce(F.col("x.until"), F.lit(OPEN_END)).cast("long").alias("valid_to_us"),
        )
    )
