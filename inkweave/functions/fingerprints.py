"""Content fingerprints: a digest of a canonical text of the fields that carry meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
NULL = "\x00"

SOURCE_FIELDS = (
    "callout_kind code_language continued_to_next continues_from_previous equation_number kind latex math_status page parent_id "
    "render_policy sidebar_id sidebar_role source_hash source_markdown source_text translatable verification_status visual_text_status"
).split()
STRUCTURE_FIELDS = "callout_kind code_language continued_to_next continues_from_previous kind page parent_id render_policy sidebar_id sidebar_role translatable".split()


def fingerprint(columns: list[str], df: DataFrame | None = None) -> Column:
    """SHA-256 of the fields' texts in sorted order of their names; null differs from empty."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in sorted(columns)]), 256)


def ordered_fingerprint(order: str, line: Column) -> Column:
    """Aggregate: SHA-256 of the lines joined in the order of a column (for bounded groups)."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n"), 256)
