"""Greedy size-bounded segmentation in reading order.

The cut depends on what the current batch holds, so it is a fold, not a window.  A gap of
more than one page cuts whatever the state, so every stretch between two gaps is folded on
its own; within a stretch the rows are streamed in order by one Python iterator that holds
two numbers, never the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import word_count
from inkweave.operators.sequence import islands, with_neighbour

MAX_WORDS = 900
LEAST_WORDS = 100


def greedy_batches(units: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``project_id, unit_id, pos, page, words, stretch, batch``: numbers count inside a stretch from 1.

    ``units`` are included units with dense ``pos``.  Units that aren't translatable weigh
    nothing.  A batch ends before a unit that would pass ``max_words`` on another page, would
    pass 1.5 times ``max_words``, is a heading when 55 % are filled, or lies beyond a page gap.
    """
    if max_words < LEAST_WORDS:
        raise ValueError(f"max_words must be at least {LEAST_WORDS}")
    d = units.select("project_id", "unit_id", "pos", "page", "kind", F.when(F.col("translatable"), word_count(F.col("source_text"))).otherwise(0).alias("words"))
    d = with_neighbour(d, "project_id", "pos", ["page"], -1, "p_")
    d = islands(d, "project_id", "pos", F.col("p_page").isNull() | (F.col("page") - F.col("p_page") > 1), "stretch")
    rows = d.select("project_id", "stretch", "pos", "unit_id", "page", "kind", "words").repartition("project_id", "stretch").sortWithinPartitions("project_id", "stretch", "pos")

    def run(frames):
        import pandas as pd

        key, batch, filled, last_page = None, 0, 0, None
        for f in frames:
            numbers = []
            for k, s, page, kind, w in zip(f["project_id"], f["stretch"], f["page"], f["kind"], f["words"]):
                if (k, s) != key:
                    key, batch, filled, last_page = (k, s), 1, 0, page
                elif (filled + w > max_words and page != last_page) or filled + w > 1.5 * max_words or (kind == "heading" and filled >= 0.55 * max_words):
                    batch, filled = batch + 1, 0
                filled, last_page = filled + w, page
                numbers.append(batch)
            yield pd.DataFrame({"project_id": f["project_id"], "unit_id": f["unit_id"], "pos": f["pos"], "page": f["page"], "words": f["words"], "stretch": f["stretch"], "batch": numbers})

    return rows.mapInPandas(run, "project_id string, unit_id string, pos bigint, page int, words int, stretch bigint, batch int")


def batch_bounds(batches: DataFrame) -> DataFrame:
    """One row per batch: first and last position, pages, words, and whether its positions are consecutive."""
    return batches.groupBy("project_id", "stretch", "batch").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
        F.count("*").alias("units"), F.sum("words").alias("words"), (F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("consecutive"),
    )
