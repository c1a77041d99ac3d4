"""Queries over fragments, overrides, receipts, chains and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.fingerprints import SOURCE_FIELDS, fingerprint, ordered_fingerprint
from inkweave.operators import fragments, lineage, overrides, retrieval
from inkweave.plans.records import current
from inkweave.plans.units import B, U, _fp, blocks, units
from inkweave.sources.tables import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


_FITS = " OR ".join(f"(kind = '{k}' AND bbox.y0 - pb.y1 >= {a} AND bbox.y0 - pb.y1 < {b} AND abs(bbox.x0 - pb.x0) < {m})" for k, (a, b, m) in fragments.RULES.items())


@query(f"""WITH {B}, o AS (SELECT *, lag(kind) OVER w AS pk, lag(bbox) OVER w AS pb, row_number() OVER w AS place FROM b WINDOW w AS (PARTITION BY project_id, page ORDER BY round(bbox.y0, 1), bbox.x0, block_id)),
s AS (SELECT *, sum(CASE WHEN pk = kind AND ({_FITS}) THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, page ORDER BY place) AS run FROM o)
SELECT project_id, page, arg_min(block_id, place) AS first_block, arg_min(kind, place) AS kind, count(*)::INT AS parts, sha256(string_agg(text, chr(10) ORDER BY place)) AS text_sha, max(bbox.y1) - min(bbox.y0) AS height FROM s GROUP BY project_id, page, run""")
def merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    return fragments.merged(blocks(spark, d)).select("project_id", "page", "first_block", "kind", "parts", F.sha2("text", 256).alias("text_sha"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("height"))


@query(f"""WITH {B}, c AS (SELECT project_id, page, block_id AS caption, bbox.y1 AS bottom FROM b WHERE kind = 'caption' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 30),
p AS (SELECT project_id, page, block_id AS paragraph, bbox.y0 AS top FROM b WHERE kind = 'paragraph')
SELECT caption, arg_min(paragraph, (top - bottom, paragraph)) AS paragraph FROM c JOIN p USING (project_id, page) WHERE top - bottom BETWEEN 0 AND 14 GROUP BY caption""")
def caption_bodies(spark: SparkSession, d: str) -> DataFrame:
    return fragments.caption_bodies(blocks(spark, d), most_words=30)


@query(f"""WITH {U} SELECT unit_id, CASE WHEN kind = 'note' THEN 'paragraph' ELSE kind END AS kind, CASE WHEN kind = 'code' THEN 'omit' ELSE render_policy END AS render_policy FROM u WHERE NOT (kind = 'figure' AND regexp_matches(source_text, '^[a-z]'))""")
def overridden_units(spark: SparkSession, d: str) -> DataFrame:
    """Three patches of every project: notes become paragraphs, code is omitted, lower-case figure labels are ignored."""
    rows = [(1, "note", None, False, "paragraph", None), (2, "code", None, False, None, "omit"), (3, "figure", "^[a-z]", True, None, None)]
    rules = spark.createDataFrame(rows, "ord int, current_kind string, text_regex string, ignore boolean, kind string, render_policy string")
    none = {"unit_id": "string", "page": "int", "bbox": "struct<x0:double,y0:double,x1:double,y1:double>"}
    patches = table(spark, d, "projects").select("project_id").crossJoin(F.broadcast(rules)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return overrides.apply(units(spark, d), patches).select("unit_id", "kind", "render_policy")


@query(f"""WITH {U} SELECT project_id, page FROM u GROUP BY ALL HAVING NOT bool_and(verification_status = 'verified') OR bool_or(pos % 50 = 0)""")
def pages_to_verify(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a passed receipt of their present content.

    A page passed if all its units are verified; the receipts are of an older snapshot, in which
    every fiftieth unit read otherwise.
    """
    fp = ordered_fingerprint("pos", F.concat_ws(":", "unit_id", fingerprint(SOURCE_FIELDS))).alias("fp")
    u = units(spark, d)
    older = u.withColumn("source_text", F.when(F.col("pos") % 50 == 0, F.concat("source_text", F.lit(" "))).otherwise(F.col("source_text")))
    receipts = older.groupBy("project_id", "page").agg(fp, F.bool_and(F.col("verification_status") == "verified").alias("passed"))
    return lineage.to_recompute(u.groupBy("project_id", "page").agg(fp), receipts, ["project_id", "page"], "fp").select("project_id", "page")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT e.event_id, min(e.event_id) OVER (PARTITION BY user_id) AS root, (n - 1)::BIGINT AS depth FROM e""")
def run_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each event's chain of predecessors of the same user, followed to its root."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return lineage.roots(table(spark, d, "events").select("event_id", before.alias("parent")), "event_id", "parent")


@query("""WITH m AS (SELECT user_id, median(CASE WHEN event_type = 'view' THEN value END) AS base, median(CASE WHEN event_type = 'click' THEN value END) AS other FROM events GROUP BY ALL)
SELECT user_id, base, other, CASE WHEN base = 0 THEN 0.0 ELSE 1 - other / base END AS reduction FROM m""")
def median_reductions(spark: SparkSession, d: str) -> DataFrame:
    return lineage.reductions(table(spark, d, "events"), "user_id", "event_type", "value", "view", "click")


@query("""WITH g AS (SELECT DISTINCT ON (issue_id) * FROM review_issues), f AS (SELECT DISTINCT unit_id FROM translation_history WHERE revision > 1)
SELECT severity, count(*) AS gold, count(f.unit_id) AS hit FROM g LEFT JOIN f USING (unit_id) GROUP BY severity""")
def issue_recall(spark: SparkSession, d: str) -> DataFrame:
    """Issues by severity and how many of them lie on a unit that was revised."""
    gold = table(spark, d, "review_issues").dropDuplicates(["issue_id"])
    return lineage.recall(gold, table(spark, d, "translation_history").where("revision > 1"), ["unit_id"], "severity")


@query()
def batch_memory(spark: SparkSession, d: str) -> DataFrame:
    """The six memory entries most like the first project's first batch, against all records."""
    from inkweave.operators.segment import greedy_batches

    u = units(spark, d)
    first = table(spark, d, "projects").agg(F.min("project_id").alias("project_id"))
    own = u.join(F.broadcast(first), "project_id", "left_semi")
    places = own.select("unit_id", "pos")
    batch = greedy_batches(own).where("stretch = 1 AND batch = 1").select("unit_id", "pos")
    now = batch.join(u.select("unit_id", "source_text"), "unit_id").select("unit_id", "source_text")
    edge = batch.agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    near = places.crossJoin(F.broadcast(edge)).where("pos = a - 1 OR pos = z + 1").select("unit_id", F.lit(True).alias("near"))
    memory = current(spark, d).join(u.select("unit_id", "source_text"), "unit_id").join(near, "unit_id", "left").select("unit_id", "line_no", "source_text", F.coalesce("near", F.lit(False)).alias("adjacent"))
    return retrieval.translation_memory(now, memory)


@query()
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every block by rule, beside the extractor's guess."""
    from inkweave.functions import classify as C

    b = blocks(spark, d)
    medians = b.groupBy("project_id", "page").agg(F.median("font_size").alias("median_size"))
    j = b.join(medians, ["project_id", "page"]).withColumn("is_code", C.is_program_code(F.col("text")))
    c = C.block_class(F.col("text"), F.col("bbox"), F.col("page_width"), F.col("page_height"), F.col("font_size"), F.col("median_size"), F.col("font_names"), F.col("is_code"), F.lit(0.0))
    return j.select("block_id", F.col("kind").alias("guess"), c.alias("c")).select("block_id", "guess", "c.kind", "c.confidence", "c.translatable")


@query(f"""WITH {B}, f AS (SELECT project_id, page, block_id AS figure, bbox.y1 AS bottom FROM b WHERE kind = 'figure'), c AS (SELECT project_id, page, block_id AS caption, bbox.y0 AS top FROM b WHERE kind = 'caption')
SELECT figure, arg_min(caption, (top, caption)) AS caption FROM f JOIN c USING (project_id, page) WHERE top >= bottom GROUP BY figure""")
def figure_captions(spark: SparkSession, d: str) -> DataFrame:
    from inkweave.operators.layout import caption_regions

    return caption_regions(blocks(spark, d))


@query(f"""WITH {B} SELECT block_id FROM b x WHERE kind <> 'figure' AND NOT EXISTS (SELECT 1 FROM b y WHERE y.kind = 'figure' AND y.project_id = x.project_id AND y.page = x.page
  AND least(x.bbox.x1, y.bbox.x1) > greatest(x.bbox.x0, y.bbox.x0) AND least(x.bbox.y1, y.bbox.y1) > greatest(x.bbox.y0, y.bbox.y0)
  AND (least(x.bbox.x1, y.bbox.x1) - greatest(x.bbox.x0, y.bbox.x0)) * (least(x.bbox.y1, y.bbox.y1) - greatest(x.bbox.y0, y.bbox.y0)) / greatest((x.bbox.x1 - x.bbox.x0) * (x.bbox.y1 - x.bbox.y0), 1.0) > 0.55)""")
def unoccupied_blocks(spark: SparkSession, d: str) -> DataFrame:
    from inkweave.operators.layout import outside

    b = blocks(spark, d)
    return outside(b.where("kind <> 'figure'"), b.where("kind = 'figure'")).select("block_id")


@query(f"""WITH {U}, g AS (SELECT DISTINCT project_id, page FROM u WHERE kind = 'heading'), o AS (SELECT u.* FROM u JOIN g USING (project_id, page)),
s AS (SELECT project_id, sidebar_id, min(pos) AS a, max(pos) AS z FROM u WHERE (project_id, sidebar_id) IN (SELECT project_id, sidebar_id FROM o WHERE sidebar_id IS NOT NULL) GROUP BY ALL)
SELECT project_id, unit_id, pos FROM o UNION SELECT u.project_id, u.unit_id, u.pos FROM u JOIN s ON u.project_id = s.project_id AND u.pos BETWEEN s.a AND s.z""")
def context_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of the pages that hold a heading, with the sidebars that reach into them."""
    from inkweave.operators.layout import context_units as context

    u = units(spark, d)
    return context(u, u.where("kind = 'heading'"))


@query(f"""WITH {U}, c AS (SELECT * FROM translation_history QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY line_no DESC) = 1)
SELECT unit_id, sha256(concat_ws(chr(31), {_fp(SOURCE_FIELDS).replace('source_hash::VARCHAR', 'u.source_hash::VARCHAR')}, coalesce(c.target_text, chr(0)), coalesce(array_to_string(c.uncertainties, chr(30)), chr(0)))) AS translation_fp FROM u LEFT JOIN c USING (unit_id)""")
def translation_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of a unit with its current record's content; null content differs from empty."""
    u = units(spark, d).select("unit_id", fingerprint(SOURCE_FIELDS).alias("fp"))
    j = u.join(current(spark, d, "target_text", "uncertainties"), "unit_id", "left")
    null = F.lit("\x00")
    content = F.concat_ws("\x1f", "fp", F.coalesce("target_text", null), F.coalesce(F.array_join("uncertainties", "\x1e"), null))
    return j.select("unit_id", F.sha2(content, 256).alias("translation_fp"))
