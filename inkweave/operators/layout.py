"""Page layout: repeated margins, overlaps, reading order, coverage of a page's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.classify import marginal_key
from inkweave.functions.nested import overlap
from inkweave.functions.text import COVERAGE_TOKEN, matches


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """``project_id, key, blocks, pages, repeated``: masked texts of the top and bottom 11 % of the pages.

    ``repeated`` holds from half the project's pages on, two blocks at least.
    """
    pages = blocks.groupBy("project_id").agg(F.countDistinct("page").alias("pages"))
    marginal = (F.col("bbox.y1") < F.col("page_height") * 0.11) | (F.col("bbox.y0") > F.col("page_height") * 0.89)
    keyed = blocks.where(marginal).select("project_id", marginal_key(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("key"))
    counted = keyed.where((F.length("key") > 0) & (F.length("key") < 220)).groupBy("project_id", "key").agg(F.count("*").alias("blocks"))
    return counted.join(pages, "project_id").select("project_id", "key", "blocks", "pages", (F.col("blocks") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2))).alias("repeated"))


def inspect(blocks: DataFrame) -> DataFrame:
    """``project_id, page, blocks, chars, manual``: pages with fewer than 20 characters need a look."""
    return blocks.groupBy("project_id", "page").agg(F.count("*").alias("blocks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars")).withColumn("manual", F.col("chars") < 20)


def overlapping(blocks: DataFrame, least: float = 0.72) -> DataFrame:
    """``project_id, page, a, b``: blocks of a page of which ``a`` (earlier) is covered by ``b``; figures aside."""
    b = blocks.where("kind <> 'figure'").select("project_id", "page", "ord", "block_id", "bbox")
    x, y = b.alias("x"), b.alias("y")
    on = (F.col("x.project_id") == F.col("y.project_id")) & (F.col("x.page") == F.col("y.page")) & (F.col("x.ord") < F.col("y.ord"))
    return x.join(y, on).where(overlap(F.col("x.bbox"), F.col("y.bbox")) > least).select("x.project_id", "x.page", F.col("x.block_id").alias("a"), F.col("y.block_id").alias("b"))


def page_geometry(blocks: DataFrame) -> DataFrame:
    """``project_id, page``: union of the boxes and median font size."""
    box = [f(F.col("bbox")[c]).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return blocks.groupBy("project_id", "page").agg(*box, F.median("font_size").alias("median_size"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``block_id, place``: two columns are read one after the other between full-width separators.

    A page has columns if two blocks at least lie on either side of its middle; otherwise its
    blocks are read from top to bottom.  Ties go to the smaller id.
    """
    page = Window.partitionBy("project_id", "page")
    mid = F.col("page_width") / 2
    b = blocks.select("project_id", "page", "block_id", "bbox", "page_width")
    left = (F.col("bbox.x1") < mid + 8) & (F.col("bbox.x0") < mid - 25)
    right = (F.col("bbox.x0") > mid - 8) & (F.col("bbox.x1") > mid + 25)
    side = F.when(left, 1).when(right, 2).otherwise(0)
    b = b.withColumn("side", side)
    b = b.withColumn("columns", (F.count_if(F.col("side") == 1).over(page) >= 2) & (F.count_if(F.col("side") == 2).over(page) >= 2))
    down = page.orderBy(F.col("bbox.y0"), "block_id").rowsBetween(Window.unboundedPreceding, -1)
    segment = F.coalesce(F.count_if(F.col("side") == 0).over(down), F.lit(0))
    b = b.withColumn("segment", F.when(F.col("columns"), segment).otherwise(0)).withColumn("column", F.when(F.col("columns"), F.when(F.col("side") == 0, 3).otherwise(F.col("side"))).otherwise(0))
    y = F.when(F.col("columns"), F.col("bbox.y0")).otherwise(F.round(F.col("bbox.y0"), 1))
    return b.select("block_id", F.row_number().over(page.orderBy("segment", "column", y, F.col("bbox.x0"), "block_id")).alias("place"))


def token_coverage(blocks: DataFrame, units: DataFrame, least: float = 0.72) -> DataFrame:
    """``project_id, page, tokens, captured, enough``: tokens of a page's blocks that its units hold too.

    Tokens are counted with multiplicity; a page without tokens is covered.
    """
    def counts(df: DataFrame, text: str, name: str) -> DataFrame:
        t = df.select("project_id", "page", F.explode(matches(F.lower(F.col(text)), COVERAGE_TOKEN)).alias("token"))
        return t.groupBy("project_id", "page", "token").agg(F.count("*").alias(name))

    a, b = counts(blocks, "text", "n"), counts(units, "source_text", "m")
    per = a.join(b, ["project_id", "page", "token"], "left").groupBy("project_id", "page").agg(F.sum("n").alias("tokens"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("captured"))
    return per.withColumn("enough", F.col("captured") >= F.col("tokens") * least)


def outside(boxes: DataFrame, regions: DataFrame, least: float = 0.55) -> DataFrame:
    """Boxes of which no region of their page covers more than ``least`` (anti-join keyed by page)."""
    r = regions.select(F.col("project_id").alias("__p"), F.col("page").alias("__g"), F.col("bbox").alias("__r"))
    return boxes.join(r, (F.col("project_id") == F.col("__p")) & (F.col("page") == F.col("__g")) & (overlap(F.col("bbox"), F.col("__r")) > least), "left_anti")


def caption_regions(blocks: DataFrame) -> DataFrame:
    """``figure, caption``: the nearest caption below a figure with no other caption between them.

    Of the captions of a page that begin below a figure the first one is nearest, so none lies
    between; ties go to the smaller id.
    """
    f = blocks.where("kind = 'figure'").select("project_id", "page", F.col("block_id").alias("figure"), F.col("bbox.y1").alias("bottom"))
    c = blocks.where("kind = 'caption'").select("project_id", "page", F.col("block_id").alias("caption"), F.col("bbox.y0").alias("top"))
    below = f.join(c, ["project_id", "page"]).where(F.col("top") >= F.col("bottom"))
    return below.groupBy("figure").agg(F.min_by("caption", F.struct("top", "caption")).alias("caption"))


def outline(entries: DataFrame) -> DataFrame:
    """``project_id, page, titles`` of ``entries(project_id, ord, page, title)``, in order; pages count from 1."""
    kept = entries.where("page > 0").groupBy("project_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("t"))
    return kept.select("project_id", "page", F.transform("t", lambda x: x["title"]).alias("titles"))


def context_units(units: DataFrame, pages: DataFrame) -> DataFrame:
    """``project_id, unit_id, pos``: the units of the pages, and whole the sidebars that reach into them."""
    u = units.select("project_id", "unit_id", "pos", "page", "sidebar_id")
    own = u.join(pages.select("project_id", "page").distinct(), ["project_id", "page"], "left_semi")
    reached = own.where("sidebar_id IS NOT NULL").select("project_id", "sidebar_id").distinct()
    spans = u.join(reached, ["project_id", "sidebar_id"]).groupBy("project_id", "sidebar_id").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    inside = spans.select("project_id", F.explode(F.sequence("a", "z")).alias("pos"))
    return own.select("project_id", "pos").unionByName(inside).distinct().join(u.select("project_id", "unit_id", "pos"), ["project_id", "pos"]).select("project_id", "unit_id", "pos")
