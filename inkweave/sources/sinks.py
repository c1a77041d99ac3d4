"""Sinks: JSON lines, atomic publication, content-addressed packets, ownership and pruning checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line without nulls; the committer makes the output appear as a whole."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def publish(spark: SparkSession, outputs: dict[str, DataFrame], root: str) -> None:
    """All or nothing: every output is written beside the root, then one rename shows them.

    A root that exists is moved aside first and moved back if the rename fails.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    staged, old = f"{root}.staged", f"{root}.old"
    fs.delete(path(staged), True)
    try:
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{staged}/{name}")
    except Exception:
        fs.delete(path(staged), True)
        raise
    fs.delete(path(old), True)
    had = fs.exists(path(root))
    if had and not fs.rename(path(root), path(old)):
        raise RuntimeError(f"can't move {root} aside")
    if not fs.rename(path(staged), path(root)):
        if had:
            fs.rename(path(old), path(root))
        raise RuntimeError(f"can't publish {root}")
    fs.delete(path(old), True)


def packets(units: DataFrame, batch: str, order: str, fingerprint: str) -> DataFrame:
    """``batch, packet_id, units``: the id is the digest of the ordered content, so equal content is one packet."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(":", "unit_id", fingerprint).alias("l"))))
    return units.groupBy(batch).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), 256).alias("packet_id"), F.count("*").alias("units"))


def new_packets(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned packets that aren't written yet."""
    return planned.join(existing.select("packet_id"), "packet_id", "left_anti")


def foreign_outputs(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """``output, owner``: outputs that exist and belong to another batch than the one that plans them."""
    owners = existing.select("output", F.col("batch_id").alias("owner"))
    return planned.join(owners, "output").where("owner <> batch_id").select("output", "owner")


def prunable(packet_units: DataFrame, evidence: DataFrame) -> DataFrame:
    """``packet_id``: packets all of whose (unit, fingerprint, lens) stand in the evidence (relational division)."""
    keys = ["unit_id", "fp", "lens"]
    open_ = packet_units.join(evidence.select(*keys).distinct(), keys, "left_anti").select("packet_id").distinct()
    return packet_units.select("packet_id").distinct().join(open_, "packet_id", "left_anti")
