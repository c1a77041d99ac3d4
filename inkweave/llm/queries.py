"""The text queries and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import align, cutoff, leak, lookalike, markup, mix, pairs, scan, sentences
from inkweave.sources.tables import table


def _field(df: DataFrame, name: str, *columns) -> DataFrame:
    return df.select(*columns, F.lit(name).alias("field"), F.col(name).alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    units = _field(table(spark, d, "source_units"), "source_text", "unit_id")
    records = _field(table(spark, d, "translation_history"), "target_text", "unit_id")
    return lookalike.alike_pairs(units.unionByName(records))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    units = _field(table(spark, d, "source_units"), "source_text", "unit_id")
    records = _field(table(spark, d, "translation_history"), "target_text", "unit_id")
    return lookalike.alike_classes(units.unionByName(records))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    keys = ["unit_id", "revision"]
    units = table(spark, d, "source_units").groupBy("unit_id").agg(F.min("source_text").alias("source_text")).withColumn("revision", F.lit(0))
    records = table(spark, d, "translation_history").groupBy(*keys).agg(F.min("target_text").alias("target_text"))
    both = _field(units, "source_text", *keys).unionByName(_field(records, "target_text", *keys))
    return lookalike.canonical_fields(both, ["field", *keys], "text")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "source_units")
    h = table(spark, d, "translation_history")
    keys = ["unit_id", "project_id"]
    zero = F.lit(0).alias("revision")
    return (
        _field(u.where(F.col("source_markdown").isNotNull()), "source_markdown", *keys, zero)
        .unionByName(_field(u.where(F.col("latex").isNotNull()), "latex", *keys, zero))
        .unionByName(_field(h, "target_text", *keys, "revision"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(_marked(spark, d), ["unit_id", "revision"], "project_id", "field", "text")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.extract(_marked(spark, d), ["unit_id", "revision"], "project_id", "field", "text").distinct()


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    no = F.lit(None).cast("double")
    u = table(spark, d, "source_units").select(F.col("unit_id").alias("record_id"), "project_id", "page", "kind", F.col("source_text").alias("text"), no.alias("y0"), no.alias("height"))
    b = table(spark, d, "block_candidates").select(F.col("block_id").alias("record_id"), "project_id", "page", "kind", "text", F.col("bbox.y0").alias("y0"), F.col("page_height").alias("height"))
    return u.unionByName(b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.found(_scanned(spark, d))


def p3_reflowed(spark: SparkSession, d: str) -> DataFrame:
    return scan.reflow(scan.repaired(_scanned(spark, d)))


def _verified(spark: SparkSession, d: str) -> DataFrame:
    """Verified paragraphs and notes with the record of their highest revision (null without one)."""
    units = (
        table(spark, d, "source_units")
        .where(F.col("kind").isin("paragraph", "note") & (F.col("verification_status") == "verified"))
        .groupBy("unit_id")
        .agg(F.min("project_id").alias("project_id"), F.min("source_text").alias("source_text"))
    )
    latest = table(spark, d, "translation_history").groupBy("unit_id").agg(F.max(F.struct("revision", "target_text")).alias("r"))
    projects = table(spark, d, "projects").groupBy("project_id").agg(F.min("source_language").alias("source_language"), F.min("target_language").alias("target_language"))
    return (
        units.join(latest, "unit_id", "left")
        .join(projects, "project_id", "left")
        .select("unit_id", "source_text", F.col("r.target_text").alias("target_text"), "source_language", "target_language", F.concat_ws(">", "source_language", "target_language").alias("pair"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return align.align(_verified(spark, d), "unit_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    v = _verified(spark, d)
    both = v.select("unit_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_text").alias("text"), F.col("source_language").alias("lang")), F.struct(F.lit("target").alias("side"), F.col("target_text").alias("text"), F.col("target_language").alias("lang")))).alias("x"))
    return sentences.split_table(both.select("unit_id", "x.side", "x.text", "x.lang"), ["unit_id", "side"], "text", "lang")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "translation_history").groupBy("unit_id", "revision").agg(F.max(F.struct("target_text", "uncertainties")).alias("r"))
    units = table(spark, d, "source_units").groupBy("unit_id").agg(F.min("project_id").alias("project_id"), F.min("source_text").alias("source_text"), F.min("kind").alias("kind"))
    projects = table(spark, d, "projects").groupBy("project_id").agg(F.min("target_language").alias("language"))
    joined = records.join(units, "unit_id").join(projects, "project_id", "left")
    return pairs.defects(joined.select("unit_id", "revision", "source_text", F.col("r.target_text").alias("target_text"), F.col("r.uncertainties").alias("uncertainties"), "language", "kind"), ["unit_id", "revision"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "held_out_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.scores(table(spark, d, "documents")).where(F.col("p_cut") > cutoff.THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_canonical, p2_found, p2_clean, p3_found, p3_reflowed, p4_found, p6_found, p7_found, p8_found, p9_mixture, p9_shares, p10_found, p10_rates)}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be stated in SQL; their tests compare them with brute force."""
    return {}
