"""The small test tables with nulls in every column, empty and very long texts, repeats and clashing names; and empty ones."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

SOURCE = "/root/testdata/sf0.001"
CLASHES = ("h", "k", "t", "id", "field", "host", "path", "score", "sentence_no", "defect", "noise", "a", "b", "pair", "words", "canonical", "tail", "seen", "copies", "run", "stretch", "piled", "x", "rows", "n")


def _damaged(df):
    out = df
    for c in df.columns:
        out = out.unionByName(df.limit(3).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
    out = out.unionByName(df.limit(2).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))
    for c in ("text", "source_text", "target_text", "source_markdown", "latex"):
        if c in df.columns:
            out = out.unionByName(df.limit(2).withColumn(c, F.lit(""))).unionByName(df.limit(1).withColumn(c, F.repeat(F.concat(F.col(c), F.lit(" ")), F.lit(1500))))
    out = out.unionByName(out)
    for c in CLASHES:
        if c not in out.columns:
            out = out.withColumn(c, F.lit("clash"))
    return out


def make(spark, folder, kind):
    for f in os.listdir(SOURCE):
        df = spark.read.parquet(f"{SOURCE}/{f}")
        (_damaged(df) if kind == "damaged" else df.limit(0)).write.parquet(f"{folder}/{f}")
    return str(folder)
