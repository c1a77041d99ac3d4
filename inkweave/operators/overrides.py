"""Ordered layout patches over units: matched by id, else by box, else by kind and pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.nested import overlap

PATCHED = ("kind", "source_text", "source_markdown", "latex", "code_language", "translatable", "render_policy", "sidebar_id", "sidebar_role")


#: Patches that are broadcast at most; more are joined by their keys.
BROADCAST_PATCHES = 10_000


def _keyed(patches: DataFrame, u: DataFrame, kind: str | None) -> DataFrame:
    """Patches beside the units of their project, and of their page or kind as far as they name them."""
    if patches.limit(BROADCAST_PATCHES + 1).count() <= BROADCAST_PATCHES:
        return u.join(F.broadcast(patches), "project_id")
    same = (patches.project_id == u.project_id) & (F.lit(True) if kind is None else patches[kind] == u.u_kind)
    paged = patches.page == u.u_page
    one = patches.join(u, same & paged).drop(u.project_id)
    return one.unionByName(patches.where("page IS NULL").join(u, same & patches.page.isNull()).drop(u.project_id))


def matched(units: DataFrame, patches: DataFrame, least: float = 0.5) -> DataFrame:
    """``unit_id, ord, patch fields``: which patch hits which unit.

    ``patches(project_id, ord, unit_id, page, bbox, current_kind, text_regex, ...)``; a patch
    with an id hits that unit alone; one with a box the units of its page that it covers by more
    than ``least``; one with a kind the units of that kind whose text matches its pattern.
    Patches are a person's work and few per project; the join is keyed by project and page or id.
    """
    u = units.select("project_id", "unit_id", "page", F.col("bbox").alias("u_bbox"), F.col("kind").alias("u_kind"), F.col("source_text").alias("u_text"))
    by_id = patches.where("unit_id IS NOT NULL").join(u.select("project_id", "unit_id"), ["project_id", "unit_id"])
    rest = patches.where("unit_id IS NULL").drop("unit_id")
    here = F.col("page").isNull() | (F.col("page") == F.col("u_page"))
    u = u.withColumnRenamed("page", "u_page")
    boxes, kinds = rest.where("bbox IS NOT NULL"), rest.where("bbox IS NULL AND current_kind IS NOT NULL")
    boxed = _keyed(boxes, u, None).where(here & (overlap(F.col("u_bbox"), F.col("bbox")) > least))
    kinds = _keyed(kinds, u, "current_kind").where(here & (F.col("current_kind") == F.col("u_kind")) & (F.col("text_regex").isNull() | F.expr("u_text rlike text_regex")))
    fields = [c for c in PATCHED if c in patches.columns]
    keep = ["unit_id", "ord", "ignore", *fields]
    return by_id.select(*keep).unionByName(boxed.select(*keep)).unionByName(kinds.select(*keep))


def apply(units: DataFrame, patches: DataFrame) -> DataFrame:
    """Units after all patches in their order: later fields win, ignored units are dropped, positions are kept dense per project.

    Null fields of a patch change nothing; units without a patch stay as they are.
    """
    hits = matched(units, patches)
    fields = [c for c in PATCHED if c in patches.columns]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias("p_" + c) for c in fields]
    folded = hits.groupBy("unit_id").agg(F.max(F.coalesce("ignore", F.lit(False))).alias("dropped"), *last)
    j = units.join(folded, "unit_id", "left").where(~F.coalesce("dropped", F.lit(False)))
    for c in fields:
        j = j.withColumn(c, F.coalesce(F.col("p_" + c), F.col(c)))
    return j.drop("dropped", *["p_" + c for c in fields])


def stale_records(before: DataFrame, after: DataFrame, meaning: list[str]) -> DataFrame:
    """``unit_id, effect``: records whose unit is gone (``removed``) or means something else (``invalidated``)."""
    a = before.select("unit_id", F.struct(*meaning).alias("a"))
    b = after.select("unit_id", F.struct(*meaning).alias("b"), F.lit(True).alias("here"))
    effect = F.when(F.col("here").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "invalidated")
    return a.join(b, "unit_id", "left").select("unit_id", effect.alias("effect")).where(F.col("effect").isNotNull())
