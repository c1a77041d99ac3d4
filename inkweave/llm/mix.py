"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer.  Each source is given as many certain whole copies
of its texts as fit its share, and the rest is drawn by Pareto order sampling: texts are
ranked by random odds divided by inclusion odds and taken until the wanted size is reached.
"""

from __future__ import annotations

import base64
import os
import re

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows
from inkweave.sources.scratch import cut

#: Folder and file of the tokenizer's vocabulary, and the pattern that cuts texts into pieces.
TOKENIZER_DIR = os.environ.get("INKWEAVE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = re.compile(r"\s{1000}")
BUCKETS = 1 << 16
#: Parts into which the rows of a source that need no order are spread.
SPREAD = 1 << 12
#: Inclusion probabilities fall with this power of a text's size.
SIZE_POWER = 0.5


def token_counts(texts: DataFrame, keys: list[str], text: str, tokenizer: str | None = None) -> DataFrame:
    """``*keys, tokens``: the number of tokens of each whole text (0 for null and empty texts)."""
    path = tokenizer or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tokens bigint"
    n = len(keys)

    def run(rows):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        def count(t: str) -> int:
            # The tokenizer's own pattern matcher can't take runs of white space of any length.
            if _LONG_SPACE.search(t):
                return sum(len(encoding._encode_single_piece(m.group())) for m in regex.finditer(PATTERN, t))
            return len(encoding.encode_ordinary(t))

        for row in rows:
            yield (*row[:n], count(row[n] or ""))

    return map_rows(texts.select(*keys, text), run, schema)


def _sized(documents: DataFrame, tokenizer: str | None) -> DataFrame:
    """One row per distinct text: ``doc_id, source, tokens`` (the smallest id stands for its text)."""
    d = documents.where(F.length("text") > 0).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    keyed = d.groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("doc_id", "source")).alias("m"), F.first("text").alias("text"))
    return cut(token_counts(keyed.select("m.doc_id", "m.source", "text"), ["doc_id", "source"], "text", tokenizer).where("tokens > 0"))


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source, have, wanted, whole, rest``: tokens at hand and wanted, certain copies and the sampled rest.

    Without ``total_tokens`` the total is the largest at which every source reaches its share
    within its repeats.  A source can't give more than ``max_repeats`` times what it has.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.where((F.col("target_share") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    j = t.join(have, "source")
    total = F.lit(float(total_tokens)) if total_tokens else F.min(F.col("have") * F.col("repeats") / F.col("share")).over(Window.partitionBy(F.lit(1)))
    wanted = F.least(F.col("share") * total, F.col("have") * F.col("repeats").cast("double"))
    return j.withColumn("wanted", wanted).select(
        "source", "share", "repeats", "have", "wanted", F.least(F.floor(F.col("wanted") / F.col("have") + 1e-12), F.col("repeats")).cast("int").alias("whole")
    ).withColumn("rest", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole") * F.col("have")))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the texts drawn (``copies`` > 0).

    Null and empty texts aren't drawn; texts that occur under several ids are one text, used
    at most ``max_repeats`` times in all; a source without a target is left out; a target
    without documents gives nothing.  Ranks are broken by id, so equal runs draw equal texts.
    No source is sorted in one task: the ranks are cut into buckets, only the one bucket in
    which the wanted size is reached is ordered.
    """
    return _drawn(_sized(documents, tokenizer), targets, total_tokens, seed)


def _certain(sized: DataFrame, p: DataFrame) -> DataFrame:
    """``p`` with ``certain`` and ``factor``: texts up to ``certain`` tokens are taken, the others with odds by ``factor``.

    Inclusion is ``factor`` times a power of the size.  Where it would pass one, the text is certain,
    and what is left of the wanted size is spread anew over the others, until none passes.  Only
    one row per source is kept between rounds.
    """
    spark = sized.sparkSession
    # One row per source of the targets, here and in every round.
    planned = {r["source"]: r for r in p.collect()}
    limits = spark.createDataFrame([(k, float(r["rest"]), 0, False) for k, r in planned.items()], "source string, rest double, certain bigint, settled boolean")
    sizes = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    while True:
        over = F.when(F.col("tokens") > F.col("certain"), F.col("n") * F.pow(F.col("tokens"), 1 - SIZE_POWER))
        under = F.when(F.col("tokens") <= F.col("certain"), F.col("n") * F.col("tokens"))
        sums = sizes.join(limits, "source").groupBy("source", "rest", "certain").agg(F.sum(over).alias("scale"), F.coalesce(F.sum(under), F.lit(0)).alias("taken"))
        factor = F.coalesce(F.greatest(F.lit(0.0), F.col("rest") - F.col("taken")) / F.col("scale"), F.lit(0.0))
        bound = F.greatest("certain", F.floor(F.pow(factor, 1 / SIZE_POWER)).cast("bigint"))
        rows = sums.select("source", "rest", bound.alias("certain"), (bound == F.col("certain")).alias("settled"), factor.alias("factor")).collect()
        if all(r["settled"] for r in rows):
            merged = [(r["source"], float(r["rest"]), int(planned[r["source"]]["whole"]), r["certain"], r["factor"]) for r in rows]
            return spark.createDataFrame(merged, "source string, rest double, whole int, certain bigint, factor double")
        limits = spark.createDataFrame([tuple(r)[:4] for r in rows], limits.schema)


def _drawn(sized: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int) -> DataFrame:
    p = _certain(sized, plan(sized, targets, total_tokens))
    rows = sized.join(p, "source")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    inclusion = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("factor") * F.pow(F.col("tokens"), -SIZE_POWER)))
    q = F.when(F.col("tokens") <= F.col("certain"), F.lit(-64.0)).otherwise(F.log(u / (1 - u)) - F.log(inclusion / (1 - inclusion)))
    ranked = rows.withColumn("q", q)
    ranked = ranked.withColumn("bucket", F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((F.col("q") + 64) * (BUCKETS / 128.0)))).cast("int"))
    per = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ranked.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(per), F.lit(0)))
    # At most one bucket a source is cut by the wanted size; only its rows are ordered.
    cut_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))
    whole_here = F.col("before") + F.col("n") <= F.col("rest")
    marks = buckets.join(p.select("source", "rest"), "source").groupBy("source").agg(F.max(F.when(cut_here, F.struct("bucket", "before"))).alias("edge"), F.max(F.when(whole_here, F.col("bucket"))).alias("full"))
    placed = ranked.join(marks, "source", "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    order = Window.partitionBy("source", F.when(at_edge, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)))).orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("edge.before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))
    extra = F.when(at_edge, (done + F.col("tokens") / 2 <= F.col("rest")).cast("int")).when(F.col("bucket") <= F.col("full"), 1).otherwise(0)
    return placed.select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce(extra, F.lit(0))).cast("int").alias("copies")).where("copies > 0")


def report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str | None = None) -> DataFrame:
    """``source, target_share, reached_share, tokens, texts, copies, most_repeats`` of the mixture."""
    drawn = _drawn(_sized(documents, tokenizer), targets, total_tokens, seed)
    per = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    whole = Window.partitionBy(F.lit(1))
    shares = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    return shares.join(per, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.sum("tokens").over(whole), F.lit(0.0)).alias("reached_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "texts", "copies", "most_repeats")]
    )
