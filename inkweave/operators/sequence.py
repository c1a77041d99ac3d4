"""Order-dependent steps over positions, without sorting a whole group in one task.

Positions are dense inside a group (``pos`` counts from 1), so neighbours are found by an
equi-join on the position, and running totals by two levels: inside chunks of consecutive
positions, and over one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def with_neighbour(df: DataFrame, group: str, pos: str, columns: list[str], offset: int, prefix: str) -> DataFrame:
    """``df`` with the named columns of the row ``offset`` positions away (null beyond the ends)."""
    other = df.select(F.col(group).alias("__g"), (F.col(pos) - offset).alias("__p"), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(other, (F.col(group) == F.col("__g")) & (F.col(pos) == F.col("__p")), "left").drop("__g", "__p")


def running_total(df: DataFrame, group: str, pos: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in the order of ``pos``."""
    d = df.withColumn("__v", value.cast("long")).withColumn("__c", F.floor(F.col(pos) / chunk))
    totals = d.groupBy(group, "__c").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(group).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(group).alias("__g"), F.col("__c").alias("__k"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__b"))
    inside = Window.partitionBy(group, "__c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = d.withColumn("__s", F.sum("__v").over(inside))
    return summed.join(bases, (F.col(group) == F.col("__g")) & (F.col("__c") == F.col("__k"))).withColumn(name, F.col("__s") + F.col("__b")).drop("__v", "__c", "__s", "__b", "__g", "__k")


def islands(df: DataFrame, group: str, pos: str, starts: Column, name: str) -> DataFrame:
    """``df`` with the number of the island of each row: a new one begins where ``starts`` holds."""
    return running_total(df, group, pos, F.when(starts, 1).otherwise(0), name)


def page_gaps(units: DataFrame) -> DataFrame:
    """Rows before which more than one page is skipped: ``project_id, unit_id, page, previous_page``."""
    d = with_neighbour(units.select("project_id", "unit_id", "pos", "page"), "project_id", "pos", ["page"], -1, "previous_")
    return d.where(F.col("page") - F.col("previous_page") > 1).select("project_id", "unit_id", "page", "previous_page")


def continuation_islands(units: DataFrame) -> DataFrame:
    """``project_id, unit_id, pos, island``: units that a chain of continuation flags joins.

    A row goes on with the one before it if that says ``continued_to_next`` or it says itself
    ``continues_from_previous``; null flags are false.
    """
    cols = ["project_id", "unit_id", "pos", "continues_from_previous", "continued_to_next"]
    d = with_neighbour(units.select(*cols), "project_id", "pos", ["continued_to_next"], -1, "p_")
    goes_on = F.coalesce("continues_from_previous", F.lit(False)) | F.coalesce("p_continued_to_next", F.lit(False))
    first = F.col("pos") == 1
    return islands(d, "project_id", "pos", first | ~goes_on, "island").select("project_id", "unit_id", "pos", "island")


def parent_headings(units: DataFrame) -> DataFrame:
    """``unit_id, heading``: the last heading before a unit on its page (null before the first)."""
    w = Window.partitionBy("project_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return units.select("unit_id", F.last(F.when(F.col("kind") == "heading", F.col("unit_id")), ignorenulls=True).over(w).alias("heading"))


def joined_runs(units: DataFrame, kind: str, same: str) -> DataFrame:
    """``first_unit, parts, text``: consecutive units of a kind that continue each other, joined.

    Both flags must agree and the column ``same`` must not change; runs of one are kept.
    """
    cols = ["project_id", "unit_id", "pos", "kind", "source_text", "continues_from_previous", "continued_to_next", same]
    d = with_neighbour(units.select(*cols), "project_id", "pos", ["kind", "continued_to_next", same], -1, "p_")
    goes_on = (F.col("kind") == kind) & (F.col("p_kind") == kind) & F.coalesce("p_continued_to_next", F.lit(False)) & F.coalesce("continues_from_previous", F.lit(False)) & F.col("p_" + same).eqNullSafe(F.col(same))
    run = islands(d, "project_id", "pos", (F.col("pos") == 1) | ~F.coalesce(goes_on, F.lit(False)), "run").where(F.col("kind") == kind)
    parts = F.array_sort(F.collect_list(F.struct("pos", "unit_id", "source_text")))
    return run.groupBy("project_id", "run").agg(parts.alias("p")).select(F.col("p")[0]["unit_id"].alias("first_unit"), F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["source_text"]), "\n").alias("text"))
