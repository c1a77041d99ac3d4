"""Units and their targets as Markdown, and reports assembled in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.functions.nested import table_markdown


def _quoted(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def target_markdown() -> Column:
    """Markdown of one row with the unit's columns and ``target_text`` (null: the source stands in)."""
    given = F.col("target_text")
    raw = F.coalesce(F.nullif(F.when(F.col("kind") == "caption", T.normalize_zh_caption(given)).otherwise(given), F.lit("")), F.col("source_text"))
    safe = T.escape_prose(raw)
    ordinal = T.list_ordinal(F.col("source_text"))
    marker = F.coalesce(F.concat(ordinal.cast("string"), F.lit(".")), F.lit("-"))
    variant = T.note_variant(F.col("source_text"), F.col("callout_kind"))
    label = F.when(given.isNotNull(), "新增内容").otherwise("What's New")
    shell = F.when(variant == "whats-new", F.concat(F.lit("> **"), label, F.lit("**\n"))).otherwise(F.concat(F.lit("> [!"), F.upper(variant), F.lit("]\n")))
    number = F.coalesce(F.concat(F.lit(" \\tag{"), F.col("equation_number"), F.lit("}")), F.lit(""))
    labels = F.transform(
        F.filter("figure_labels", lambda x: F.coalesce(x["target"], F.lit("")) != ""),
        lambda x: F.concat(F.lit("- "), F.when(F.contains(x["source"], F.lit("$")), x["source"]).otherwise(F.concat(F.lit("`"), x["source"], F.lit("`"))), F.lit("："), x["target"]),
    )
    assets = F.array_join(F.transform("asset_refs", lambda a: F.concat(F.lit("![figure - PDF page "), F.col("page").cast("string"), F.lit("](../"), a["path"], F.lit(")"))), "\n")
    figure = F.concat(
        F.coalesce(F.nullif(assets, F.lit("")), F.concat(F.lit("`[figure: PDF page "), F.col("page").cast("string"), F.lit("]`"))),
        F.when(F.size(labels) > 0, F.concat(F.lit("\n\n**图中文字：**\n\n"), F.array_join(labels, "\n"))).otherwise(""),
    )
    plain = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("## "), safe))
        .when(F.col("kind") == "list_item", F.concat(marker, F.lit(" "), T.escape_prose(T.list_body(raw))))
        .when(F.col("kind") == "note", F.concat(shell, _quoted(T.escape_prose(T.note_body(raw)))))
        .when(F.col("kind") == "code", T.fenced_code(F.col("source_text"), F.col("code_language")))
        .when(F.col("kind") == "equation", F.concat(F.lit("$$\n"), F.coalesce(F.nullif("latex", F.lit("")), "source_text"), number, F.lit("\n$$")))
        .when(F.col("kind") == "figure", figure)
        .when((F.col("kind") == "table") & F.col("table_data").isNotNull(), table_markdown(F.col("table_data")))
        .when(F.col("kind") == "caption", F.concat(F.lit("*"), safe, F.lit("*")))
        .when(F.col("kind") == "footnote", F.concat(F.lit("> **脚注：** "), safe))
        .otherwise(safe)
    )
    return F.when(F.col("sidebar_role") == "title", F.concat(F.lit("> **"), safe, F.lit("**"))).when(F.col("sidebar_role") == "body", _quoted(plain)).otherwise(plain)


def pages(units: DataFrame, current: DataFrame) -> DataFrame:
    """``project_id, page, units, markdown``: each page's units in reading order; omitted units are left out."""
    j = units.where("render_policy = 'include'").join(current.select("unit_id", "target_text"), "unit_id", "left")
    rows = j.select("project_id", "page", "pos", target_markdown().alias("md"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "md")))
    return rows.groupBy("project_id", "page").agg(F.count("*").alias("units"), F.array_join(F.transform(ordered, lambda x: x["md"]), "\n\n").alias("markdown"))


def source_representation() -> Column:
    """All texts of a unit that are translated: text, differing Markdown, cells, figure labels."""
    other = F.when(F.col("source_markdown") != F.col("source_text"), F.col("source_markdown"))
    cells = F.coalesce(F.flatten("table_data.row_cells"), F.array().cast("array<string>"))
    labels = F.coalesce(F.transform("figure_labels", lambda x: x["source"]), F.array().cast("array<string>"))
    parts = F.concat(F.array("source_text", other), cells, labels)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def unresolved(current: DataFrame, issues: DataFrame) -> DataFrame:
    """``unit_id, kind, entry``: uncertainties of the current records and open issues."""
    u = current.select("unit_id", F.lit("uncertainty").alias("kind"), F.explode("uncertainties").alias("entry"))
    i = issues.where("status = 'open'").select("unit_id", F.lit("issue").alias("kind"), F.concat_ws(": ", "severity", "explanation").alias("entry"))
    return u.unionByName(i).distinct()
