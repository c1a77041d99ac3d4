"""Fragments of one block that extraction tore apart: merged in the order of a page.

Adjacent fragments are islands over the previous block's box (a window per page, so no group
grows with the corpus); captions take the nearest paragraph below them by a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (least gap, most gap, most shift of the left edge) in points by kind.
RULES = {"code": (0.0, 16.0, 30.0), "note": (-1.0, 12.0, 18.0), "footnote": (-4.0, 4.0, 30.0), "equation": (-5.0, 5.0, 1e9)}


def _fits(kind: Column, gap: Column, shift: Column) -> Column:
    test = F.lit(False)
    for name, (low, high, most) in RULES.items():
        test = test | ((kind == name) & (gap >= low) & (gap < high) & (shift < most))
    return test


def merged(blocks: DataFrame) -> DataFrame:
    """``project_id, page, first_block, kind, parts, text, bbox``: runs of fragments of one kind.

    Blocks of other kinds stand alone; texts are joined by line breaks, boxes by their union.
    """
    page = Window.partitionBy("project_id", "page").orderBy(F.round("bbox.y0", 1), F.col("bbox.x0"), "block_id")
    b = blocks.select("project_id", "page", "block_id", "kind", "text", "bbox")
    before = F.lag(F.struct("kind", "bbox")).over(page)
    b = b.withColumn("before", before)
    fits = (F.col("before.kind") == F.col("kind")) & _fits(F.col("kind"), F.col("bbox.y0") - F.col("before.bbox.y1"), F.abs(F.col("bbox.x0") - F.col("before.bbox.x0")))
    b = b.withColumn("start", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).withColumn("place", F.row_number().over(page))
    b = b.withColumn("run", F.sum("start").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("place", "block_id", "text")))
    box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    g = b.groupBy("project_id", "page", "run").agg(parts.alias("p"), F.first("kind").alias("kind"), box.alias("bbox"))
    return g.select("project_id", "page", F.col("p")[0]["block_id"].alias("first_block"), "kind", F.size("p").alias("parts"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "bbox")


def caption_bodies(blocks: DataFrame, most_words: int = 5, reach: float = 14.0) -> DataFrame:
    """``caption, paragraph``: the nearest paragraph at most ``reach`` points below a short caption of its page."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    c = blocks.where((F.col("kind") == "caption") & (words <= most_words)).select("project_id", "page", F.col("block_id").alias("caption"), F.col("bbox.y1").alias("bottom"))
    p = blocks.where("kind = 'paragraph'").select("project_id", "page", F.col("block_id").alias("paragraph"), F.col("bbox.y0").alias("top"))
    near = c.join(p, ["project_id", "page"]).where((F.col("top") - F.col("bottom")).between(0.0, reach))
    return near.groupBy("caption").agg(F.min_by("paragraph", F.struct(F.col("top") - F.col("bottom"), "paragraph")).alias("paragraph"))


def indented(lines: DataFrame) -> DataFrame:
    """``block_id, text``: code lines with the indentation that their left edges show.

    ``lines(block_id, no, text, x0, x1)``; one space per median character width beyond the
    leftmost line; lines that have their own indentation keep it.
    """
    w = F.when(F.length(F.trim("text")) > 0, (F.col("x1") - F.col("x0")) / F.length("text"))
    shape = lines.groupBy("block_id").agg(F.min("x0").alias("left"), F.coalesce(F.median(w), F.lit(5.0)).alias("width"))
    j = lines.join(shape, "block_id")
    spaces = F.greatest(F.lit(0), F.round((F.col("x0") - F.col("left")) / F.greatest("width", F.lit(1.0))).cast("int"))
    text = F.when(F.col("text").rlike(r"^[ \t]") | (F.rtrim("text") == ""), F.rtrim("text")).otherwise(F.concat(F.repeat(F.lit(" "), spaces), F.rtrim("text")))
    rows = j.select("block_id", "no", text.alias("t")).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("no", "t"))).alias("l"))
    return rows.select("block_id", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), r"\n+$", "").alias("text"))
