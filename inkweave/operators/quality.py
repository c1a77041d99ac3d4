"""Deterministic quality rules over aligned units and records: rule codes to column predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.functions.classify import target_structure_error
from inkweave.functions.nested import effective_labels
from inkweave.functions.python import comparison_text_udf


def aligned(units: DataFrame, current: DataFrame, projects: DataFrame) -> DataFrame:
    """Translatable units with their current record (null without one) and the project's languages."""
    r = current.select("unit_id", F.col("target_text"), F.col("target_table"), F.col("source_hash").alias("bound_hash"), F.lit(True).alias("has_record"))
    p = projects.select("project_id", "source_language", "target_language")
    return units.where("translatable").join(r, "unit_id", "left").join(p, "project_id", "left")


def row_rules(a: DataFrame) -> DataFrame:
    """``unit_id, code, severity``: findings of the rules that look at one row."""
    rows = F.transform(F.col("target_table.row_cells"), lambda r: F.array_join(r, " | "))
    target = F.when(F.col("target_table").isNotNull(), F.concat("target_text", F.lit("\n"), F.array_join(rows, "\n"))).otherwise(F.col("target_text"))
    a = a.withColumn("effective", target)
    has = F.coalesce("has_record", F.lit(False))
    ratio_low = F.when((F.col("source_language") == "en") & (F.col("target_language") == "zh-CN"), 0.15).otherwise(0.25)
    ratio = F.length("effective") / F.greatest(F.length("source_text"), F.lit(1))
    into_chinese = (F.col("source_language") == "en") & (F.col("target_language") == "zh-CN") & (F.col("kind") != "code")
    words = F.size(T.matches(F.col("source_text"), "[A-Za-z]{2,}"))
    same = (F.length("source_text") >= 80) & (words >= 8) & (T.strip(F.col("target_text")) == T.strip(F.col("source_text")))
    shape = (F.col("target_table.column_count") != F.col("table_data.column_count")) | (F.size("target_table.row_cells") != F.size("table_data.row_cells"))
    leak = F.col("target_text").contains("<!-- unit:") | F.col("target_text").contains("```json") | F.col("target_text").contains("![")
    rules = [
        ("missing-translation", "error", ~has),
        ("source-hash-mismatch", "error", has & (F.col("bound_hash") != F.col("source_hash"))),
        ("empty-translation", "error", has & (T.strip(F.col("effective")) == "")),
        ("target-structural-markup", "error", target_structure_error(F.col("kind"), F.col("target_text")).isNotNull()),
        ("length-outlier", "warning", has & ((ratio < ratio_low) | (ratio > 2.2))),
        ("missing-target-table", "error", has & (F.col("kind") == "table") & F.col("target_table").isNull()),
        ("table-shape-mismatch", "error", (F.col("kind") == "table") & shape),
        ("agent-analysis-leak", "error", leak),
        ("untranslated-target", "error", into_chinese & same),
        ("target-language-suspect", "warning", into_chinese & ~same & (words >= 12) & ~F.col("target_text").rlike("[㐀-鿿]")),
        ("inline-math-ocr-suspect", "warning", has & F.col("source_text").rlike(T.MATH_SUSPECT)),
    ]
    hits = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for code, level, test in rules]), lambda x: x.isNotNull())
    return a.select("unit_id", F.explode(hits).alias("x")).select("unit_id", "x.code", "x.severity")


def token_deficits(a: DataFrame) -> DataFrame:
    """``unit_id, code, token, expected, found``: numbers and quantities that the target holds less often.

    Both texts are flattened first (dimensions, scaled numbers, scripts, LaTeX); tokens that only
    the target has don't count.
    """
    a = a.where(F.col("target_text").isNotNull()).select("unit_id", comparison_text_udf(F.coalesce("source_markdown", "source_text")).alias("s"), comparison_text_udf("target_text").alias("t"))

    def found(column: str) -> DataFrame:
        both = F.concat(
            F.transform(T.matches(F.col(column), T.NUMBER), lambda x: F.struct(F.lit("number-mismatch").alias("code"), F.replace(x, F.lit(" "), F.lit("")).alias("token"))),
            F.transform(T.matches(F.col(column), T.UNIT), lambda x: F.struct(F.lit("number-unit-mismatch").alias("code"), F.replace(x, F.lit(" "), F.lit("")).alias("token"))),
        )
        return a.select("unit_id", F.explode(both).alias("x")).groupBy("unit_id", "x.code", "x.token").agg(F.count("*").alias("n"))

    s, t = found("s"), found("t").withColumnRenamed("n", "m")
    j = s.join(t, ["unit_id", "code", "token"], "left")
    return j.where(F.coalesce("m", F.lit(0)) < F.col("n")).select("unit_id", "code", "token", F.col("n").alias("expected"), F.coalesce("m", F.lit(0)).alias("found"))


def missing_tokens(a: DataFrame) -> DataFrame:
    """``unit_id, token``: protected tokens of a unit that its target lacks, as written and flattened."""
    t = a.where(F.col("target_text").isNotNull()).select("unit_id", "target_text", comparison_text_udf("target_text").alias("flat"), F.explode("protected_tokens").alias("token"))
    absent = t.where(~F.contains("target_text", "token")).withColumn("plain", comparison_text_udf("token"))
    return absent.where((F.col("plain") == "") | ~F.contains("flat", "plain")).select("unit_id", "token").distinct()


# A formula in running text.
INLINE_LATEX = r"\$(?!\$)(.+?)(?<!\\)\$"


def mapping_rules(units: DataFrame, current: DataFrame) -> DataFrame:
    """``unit_id, code``: formulas missing from the target, figure labels that name other sources, records of unknown units."""
    c = current.select("unit_id", "target_text", F.col("figure_labels").alias("supplied"))
    j = units.select("unit_id", "kind", "source_markdown", "figure_labels").join(c, "unit_id")
    formulas = lambda x: F.coalesce(F.regexp_extract_all(x, F.lit(INLINE_LATEX), F.lit(1)), F.array())
    lost = j.where(F.size(F.array_except(formulas(F.col("source_markdown")), formulas(F.col("target_text")))) > 0).select("unit_id", F.lit("inline-latex-missing").alias("code"))
    other = (F.size("supplied") > 0) & effective_labels(F.col("kind"), F.col("figure_labels"), F.col("supplied")).isNull()
    unknown = c.join(units.select("unit_id"), "unit_id", "left_anti").select("unit_id", F.lit("unknown-unit").alias("code"))
    return lost.unionByName(j.where(other).select("unit_id", F.lit("figure-label-mapping-mismatch").alias("code"))).unionByName(unknown)


def audit_coverage(required: DataFrame, runs: DataFrame, invalidations: DataFrame, lenses: list[str]) -> DataFrame:
    """``batch_id, unit_id, lens, covered``: whether some run saw the unit's present content through the lens.

    ``required(batch_id, unit_id, fp)``, ``runs(lens, batch_id, unit_id, fp, reviewed_at)``,
    ``invalidations(batch_id, unit_id, invalidated_at)``; a run counts if its fingerprint is the
    present one and it is later than the unit's last invalidation.
    """
    wanted = required.select("batch_id", "unit_id", "fp", F.explode(F.array(*[F.lit(x) for x in lenses])).alias("lens"))
    last = invalidations.groupBy("batch_id", "unit_id").agg(F.max("invalidated_at").alias("at"))
    seen = runs.groupBy("lens", "batch_id", "unit_id", "fp").agg(F.max("reviewed_at").alias("reviewed_at"))
    valid = seen.join(last, ["batch_id", "unit_id"], "left").where(F.col("at").isNull() | (F.col("reviewed_at") > F.col("at"))).select("lens", "batch_id", "unit_id", "fp", F.lit(True).alias("ok"))
    return wanted.join(valid, ["lens", "batch_id", "unit_id", "fp"], "left").select("batch_id", "unit_id", "lens", F.coalesce("ok", F.lit(False)).alias("covered"))
