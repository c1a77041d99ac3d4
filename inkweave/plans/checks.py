"""Queries over checks of units and batches, progress, predicates and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import classify as C
from inkweave.functions import text as T
from inkweave.operators import closure, ledger, verify
from inkweave.plans.records import H, current
from inkweave.plans.units import _ISLANDS, B, U, blocks, units
from inkweave.sources import documents, sinks
from inkweave.sources.scratch import ensure_checkpoint_dir
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


_LINES = r"list_transform(string_split(source_text, chr(10)), lambda x: regexp_replace(x, '^\s*\d+\s?', ''))"
_RULES = {
    "source-control-character": r"regexp_matches(source_text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')",
    "missing-latex": "kind = 'equation' AND coalesce(trim(latex, ' '), '') = ''",
    "unverified-display-math": "kind = 'equation' AND math_status IS DISTINCT FROM 'verified'",
    "missing-equation-evidence": "kind = 'equation' AND coalesce(len(asset_refs), 0) = 0",
    "unverified-inline-math": "contains(source_markdown, '$') AND math_status IS DISTINCT FROM 'verified'",
    "missing-table-structure": "kind = 'table' AND table_data IS NULL",
    "unverified-table": "kind = 'table' AND verification_status IS DISTINCT FROM 'verified'",
    "unknown-code-language": "kind = 'code' AND coalesce(code_language, '') IN ('', 'text')",
    "code-indentation-suspect": f"""kind = 'code' AND len(string_split(source_text, chr(10))) > 2 AND regexp_matches(source_text, '[<{{]')
      AND NOT (len(list_filter({_LINES}, lambda x: trim(x, ' ') <> '')) >= 3 AND list_filter(list_transform({_LINES}, lambda x: trim(x, ' ')), lambda x: x <> '')[-2:] = ['{{', '}}'])
      AND len(list_filter({_LINES}[2:], lambda x: regexp_matches(x, '^[ \\t]'))) = 0""",
    "unverified-figure-text": "kind = 'figure' AND visual_text_status IS DISTINCT FROM 'verified'",
    "untranslated-figure-label": "kind = 'figure' AND len(list_filter(figure_labels, lambda x: coalesce(trim(x.target, ' '), '') = '')) > 0",
    "unverified-sidebar": "sidebar_id IS NOT NULL AND verification_status IS DISTINCT FROM 'verified'",
}


@query(f"WITH {U} " + " UNION ALL ".join(f"SELECT unit_id, '{code}' AS code FROM u WHERE {test}" for code, test in _RULES.items()))
def verification_findings(spark: SparkSession, d: str) -> DataFrame:
    return verify.unit_rules(units(spark, d))


@query("SELECT unit_id, count(*) AS copies FROM source_units GROUP BY unit_id HAVING count(*) > 1")
def duplicate_unit_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_units").groupBy("unit_id").agg(F.count("*").alias("copies")).where("copies > 1")


# Every third unit loses its role as a title, every fourth its sidebar, so that there is something to find.
_BROKEN = "u AS (SELECT * REPLACE (CASE WHEN pos % 3 = 0 THEN NULL ELSE sidebar_role END AS sidebar_role, CASE WHEN pos % 4 = 0 THEN NULL ELSE sidebar_id END AS sidebar_id) FROM (SELECT DISTINCT ON (unit_id) * FROM source_units))"
_SIDE = f"""{_BROKEN}, s AS (SELECT project_id, sidebar_id, min(pos) AS a, max(pos) AS z, count_if(sidebar_role = 'title') AS titles, arg_min(sidebar_role, pos) AS lead FROM u WHERE sidebar_id IS NOT NULL GROUP BY ALL),
f AS (SELECT project_id, sidebar_id, 'invalid-sidebar-title' AS code FROM s WHERE NOT (titles = 1 AND lead IS NOT DISTINCT FROM 'title')
 UNION SELECT s.project_id, s.sidebar_id, 'noncontiguous-sidebar' FROM s JOIN u ON u.project_id = s.project_id AND u.pos BETWEEN s.a AND s.z WHERE u.sidebar_id IS DISTINCT FROM s.sidebar_id AND NOT (u.render_policy = 'omit' AND NOT u.translatable))"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    return u.withColumn("sidebar_role", F.when(F.col("pos") % 3 == 0, None).otherwise(F.col("sidebar_role"))).withColumn("sidebar_id", F.when(F.col("pos") % 4 == 0, None).otherwise(F.col("sidebar_id")))


@query(f"WITH {_SIDE} SELECT project_id, sidebar_id, code FROM f")
def sidebar_findings(spark: SparkSession, d: str) -> DataFrame:
    """Sidebars that units have fallen out of."""
    return verify.sidebar_rules(_broken(spark, d))


@query(f"""WITH {_SIDE}, e AS (SELECT project_id, unit_id, NULL AS sidebar_id FROM u WHERE kind = 'code' AND coalesce(code_language, '') IN ('', 'text') UNION ALL SELECT project_id, NULL, sidebar_id FROM f),
n AS (SELECT project_id, sidebar_id FROM e WHERE sidebar_id IS NOT NULL UNION SELECT u.project_id, u.sidebar_id FROM e JOIN u USING (project_id, unit_id) WHERE u.sidebar_id IS NOT NULL)
SELECT u.project_id, u.page FROM u JOIN e USING (project_id, unit_id) UNION SELECT u.project_id, u.page FROM u JOIN n USING (project_id, sidebar_id)""")
def pages_of_findings(spark: SparkSession, d: str) -> DataFrame:
    """Pages touched by listings of unknown language and by damaged sidebars."""
    u = _broken(spark, d)
    none = F.lit(None).cast("string")
    code = verify.unit_rules(u.where("kind = 'code'")).where("code = 'unknown-code-language'").join(u.select("unit_id", "project_id"), "unit_id").select("project_id", F.lit(None).cast("int").alias("page"), "unit_id", none.alias("sidebar_id"))
    side = verify.sidebar_rules(u).select("project_id", F.lit(None).cast("int").alias("page"), none.alias("unit_id"), "sidebar_id")
    return verify.affected_pages(u, code.unionByName(side))


_GOES_ON = r"""regexp_replace(a, '\s+$', '') <> '' AND regexp_replace(b, '^\s+', '') <> '' AND NOT regexp_matches(regexp_replace(a, '\s+$', ''), '[.!?。！？:：;；]["\x27”’）)\]]*$') AND regexp_matches(regexp_replace(b, '^\s+', ''), '^(?:[a-z]|and\b|or\b|but\b|which\b|that\b|with\b)')"""


@query(f"""WITH {U}, n AS (SELECT *, lead(unit_id) OVER w AS nu, lead(page) OVER w AS np, lead(kind) OVER w AS nk, lead(source_text) OVER w AS nt FROM u WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
p AS (SELECT project_id, page, arg_max((unit_id, source_text), (bbox.y1, -pos)) AS low, arg_min((unit_id, source_text), (bbox.y0, pos)) AS top FROM u WHERE kind = 'paragraph' GROUP BY ALL),
c AS (SELECT unit_id, source_text AS a, nu AS next_unit, nt AS b FROM n WHERE kind = 'paragraph' AND nk = 'paragraph' AND np = page
 UNION SELECT x.low[1], x.low[2], y.top[1], y.top[2] FROM p x JOIN p y ON y.project_id = x.project_id AND y.page = x.page + 1)
SELECT DISTINCT unit_id, next_unit FROM c WHERE {_GOES_ON}""")
def derived_continuations(spark: SparkSession, d: str) -> DataFrame:
    return verify.derived_continuations(units(spark, d))


_WORDS = r"len(list_filter(regexp_split_to_array(source_text, '\s+'), lambda x: x <> ''))"


@query(f"""WITH {U}, m AS (SELECT DISTINCT batch_id, unit_id FROM review_issues), b AS (SELECT batch_id, count_if(u.pos IS NULL)::BIGINT AS missing, min(u.project_id) AS project_id, min(u.pos) AS a, max(u.pos) AS z FROM m LEFT JOIN u USING (unit_id) GROUP BY batch_id),
n AS (SELECT batch_id, count(*) AS units, count_if(translatable)::BIGINT AS translatable_units, coalesce(sum(CASE WHEN translatable THEN {_WORDS} END), 0)::BIGINT AS words, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages
 FROM b JOIN u ON u.project_id = b.project_id AND u.pos BETWEEN b.a AND b.z WHERE render_policy = 'include' AND missing = 0 GROUP BY batch_id)
SELECT batch_id, project_id, units, translatable_units, words, pages, missing FROM b LEFT JOIN n USING (batch_id)""")
def refreshed_batches(spark: SparkSession, d: str) -> DataFrame:
    return verify.refreshed(units(spark, d), table(spark, d, "review_issues"))


@query(f"WITH {U} SELECT project_id, unit_id FROM u WHERE render_policy = 'include' AND NOT EXISTS (SELECT 1 FROM review_issues i WHERE i.unit_id = u.unit_id)")
def unbatched_units(spark: SparkSession, d: str) -> DataFrame:
    return verify.unbatched(units(spark, d), table(spark, d, "review_issues"))


@query("""WITH s AS (SELECT DISTINCT batch_id, issue_type FROM review_issues), z AS (SELECT batch_id, count(*) AS n FROM s GROUP BY ALL)
SELECT a.batch_id AS part, b.batch_id AS whole FROM s a JOIN s b ON a.issue_type = b.issue_type AND a.batch_id <> b.batch_id JOIN z ON z.batch_id = a.batch_id GROUP BY ALL HAVING count(*) = max(z.n)""")
def covered_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches whose types of issues another batch has too."""
    return verify.subsets(table(spark, d, "review_issues"), "batch_id", "issue_type")


@query("""WITH u AS (SELECT DISTINCT ON (unit_id) * FROM source_units), m AS (SELECT DISTINCT batch_id, unit_id FROM review_issues)
SELECT batch_id, min(u.project_id) AS project_id, min(u.pos) AS first_pos, count(*) AS units, regexp_extract(batch_id, '-([^-]*)$', 1) AS last_part, nullif(regexp_extract(batch_id, '^(.+)-b\\d+$', 1), '') AS series FROM m JOIN u USING (unit_id) GROUP BY batch_id""")
def batch_order(spark: SparkSession, d: str) -> DataFrame:
    """Batches with the position of their first unit, their number and their series."""
    m = table(spark, d, "review_issues").select("batch_id", "unit_id").distinct().join(units(spark, d).select("unit_id", "project_id", "pos"), "unit_id")
    b = m.groupBy("batch_id").agg(F.min("project_id").alias("project_id"), F.min("pos").alias("first_pos"), F.count("*").alias("units"))
    return b.select("*", T.last_segment(F.col("batch_id")).alias("last_part"), T.batch_series(F.col("batch_id")).alias("series"))


@query(f"""WITH {U}, {H}, i AS (SELECT DISTINCT unit_id FROM review_issues WHERE status = 'open')
SELECT u.project_id, count(*) AS units, count_if(u.render_policy = 'include')::BIGINT AS included, count_if(c.unit_id IS NOT NULL)::BIGINT AS translated, count_if(u.verification_status = 'verified')::BIGINT AS verified, count_if(i.unit_id IS NOT NULL)::BIGINT AS open_issues
FROM u LEFT JOIN c ON c.unit_id = u.unit_id LEFT JOIN i ON i.unit_id = u.unit_id GROUP BY ALL""")
def project_progress(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "translation_history").select("unit_id", F.lit(True).alias("done")).distinct()
    issues = table(spark, d, "review_issues").where("status = 'open'").select("unit_id", F.lit(True).alias("open")).distinct()
    j = units(spark, d).select("unit_id", "project_id", "render_policy", "verification_status").join(done, "unit_id", "left").join(issues, "unit_id", "left")
    return j.groupBy("project_id").agg(F.count("*").alias("units"), F.count_if(F.col("render_policy") == "include").alias("included"), F.count_if("done").alias("translated"), F.count_if(F.col("verification_status") == "verified").alias("verified"), F.count_if("open").alias("open_issues"))


@query(f"""WITH {U}, {H}, s AS (SELECT unit_id, unnest(regexp_extract_all(source_markdown, '\\$([^$\\n]+)\\$', 1)) AS latex FROM u WHERE translatable),
t AS (SELECT unit_id, unnest(regexp_extract_all(target_text, '\\$([^$\\n]+)\\$', 1)) AS latex FROM c)
SELECT s.unit_id, 'inline-latex-missing' AS code FROM s JOIN c ON c.unit_id = s.unit_id WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.unit_id = s.unit_id AND t.latex = s.latex)
UNION SELECT u.unit_id, 'figure-label-mapping-mismatch' FROM u JOIN c ON c.unit_id = u.unit_id WHERE u.translatable AND len(c.figure_labels) > 0 AND NOT (u.kind = 'figure' AND list_transform(u.figure_labels, lambda x: x.source) IS NOT DISTINCT FROM list_transform(c.figure_labels, lambda x: x.source))
UNION SELECT c.unit_id, 'unknown-unit' FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.unit_id = c.unit_id AND translatable)""")
def qa_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Formulas that the target lacks, label maps that don't fit, and records of no translatable unit."""
    from inkweave.operators.quality import mapping_rules

    return mapping_rules(units(spark, d).where("translatable"), current(spark, d, "target_text", "figure_labels"))


@query(f"""WITH {B} SELECT block_id, regexp_matches(lower(array_to_string(font_names, ' ')), 'courier|consol|typewriter|lucida ?console|mono(?:spaced?|[-_ ]|$)') AS monospace,
 abs((bbox.x0 + bbox.x1) / 2 - page_width / 2) < page_width * 0.28 AND w <= 35 AND (s >= 1 OR regexp_matches(text, '[A-Za-zρτλσνεημχ](?:\\s*\\^\\s*[-+]?\\d+)?\\s*=') OR regexp_matches(text, '[A-Za-z](?:\\s*\\^\\s*[-+]?\\d+)?(?:\\s*[+\\-*/]\\s*[A-Za-z0-9])'))
  AND len(regexp_extract_all(text, '\\b[A-Za-z]{{4,}}\\b')) <= 10 AND s / w >= 0.08 AND NOT ends_with(text, '.') AS equation,
 kind IN ('paragraph', 'list_item', 'heading') AND n <= 55 AND NOT regexp_matches(replace(text, chr(10), ' '), '[.!?]\\s+[A-Z]') AND l >= 2 AND (length(text) - length(regexp_replace(text, '\\d', '', 'g')) >= 2 OR (n > 0 AND n / l < 4.5)) AS figure_labels
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS w, len(regexp_extract_all(text, '[=∑∫√∂∇±≤≥∞ρτλσνε]|\\b(?:Re|PDF)\\s*[=<>]')) AS s, len(string_split(text, chr(10))) AS l FROM b)""")
def block_shapes(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("block_id", C.is_monospace(F.col("font_names")).alias("monospace"), C.looks_like_equation(F.col("text"), F.col("bbox"), F.col("page_width")).alias("equation"), C.looks_like_figure_labels(F.col("text"), F.col("kind")).alias("figure_labels"))


@query(f"""WITH {U} SELECT unit_id, coalesce(len(table_data.row_cells), 0) >= 2 AND coalesce(list_max(list_transform(table_data.row_cells, lambda r: len(r))), 0) >= 2
 AND len(list_filter(flatten(table_data.row_cells), lambda x: coalesce(trim(x, ' '), '') <> '')) >= 0.35 * len(table_data.row_cells) * list_max(list_transform(table_data.row_cells, lambda r: len(r)))
 AND len(list_filter(flatten(table_data.row_cells), lambda x: coalesce(trim(x, ' '), '') <> '')) >= greatest(4, len(table_data.row_cells) + list_max(list_transform(table_data.row_cells, lambda r: len(r))) - 2) AS sound FROM u WHERE table_data IS NOT NULL""")
def sound_tables(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("table_data IS NOT NULL").select("unit_id", C.table_shape_ok(F.col("table_data.row_cells")).alias("sound"))


@query(f"""WITH {U} SELECT unit_id, sha256(replace(replace(replace(source_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha FROM u WHERE page BETWEEN 1 AND 3 OR page = 7 OR page BETWEEN 20 AND 24""")
def escaped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Escaped prose of the pages of a specification."""
    return units(spark, d).where(documents.on_pages(F.col("page"), "1-3,7,22-24,20-22", 100_000)).select("unit_id", F.sha2(T.escape_prose(F.col("source_text")), 256).alias("escaped_sha"))


@query("SELECT unit_id, status FROM (SELECT unit_id, status FROM translation_history WHERE revision = 1 EXCEPT ALL SELECT unit_id, status FROM translation_history WHERE revision = 2)")
def unrepeated_states(spark: SparkSession, d: str) -> DataFrame:
    """States of the first revision, with multiplicity, that the second doesn't repeat."""
    h = table(spark, d, "translation_history").select("unit_id", "status", "revision")
    return ledger.multiset_difference(h.where("revision = 1").drop("revision"), h.where("revision = 2").drop("revision"))


@query("""WITH i AS (SELECT DISTINCT ON (issue_id) * FROM review_issues), r AS (SELECT DISTINCT unit_id FROM translation_history WHERE revision > 1)
SELECT issue_id, CASE WHEN r.unit_id IS NULL THEN status ELSE 'resolved' END AS status, CASE WHEN r.unit_id IS NULL THEN resolution ELSE 'revised' END AS resolution FROM i LEFT JOIN r USING (unit_id)""")
def resolved_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues on units that were revised since are resolved."""
    issues = table(spark, d, "review_issues").dropDuplicates(["issue_id"])
    revised = table(spark, d, "translation_history").where("revision > 1").select("unit_id").distinct()
    done = issues.join(revised, "unit_id", "left_semi").select("issue_id", F.lit("resolved").alias("status"), F.lit("revised").alias("resolution"))
    return ledger.resolve(issues, done).select("issue_id", "status", "resolution")


_CLOSED = f"""WITH RECURSIVE {_ISLANDS}, e AS (SELECT DISTINCT project_id, island, sidebar_id FROM i WHERE sidebar_id IS NOT NULL),
p AS (SELECT DISTINCT a.project_id, a.island AS x, b.island AS y FROM e a JOIN e b USING (project_id, sidebar_id)),
r(project_id, x, y) AS (SELECT DISTINCT project_id, island, island FROM i UNION SELECT r.project_id, r.x, p.y FROM r JOIN p ON p.project_id = r.project_id AND p.x = r.y),
q AS (SELECT * FROM u WHERE {{seed}}), k AS (SELECT DISTINCT i.project_id, i.island FROM i JOIN q ON q.project_id = i.project_id AND i.pos BETWEEN q.pos - 1 AND q.pos + 1),
o AS (SELECT DISTINCT r.project_id, r.y AS island FROM r JOIN k ON k.project_id = r.project_id AND k.island = r.x)
SELECT i.project_id, i.unit_id, i.pos FROM i JOIN o USING (project_id, island)"""


@query(_CLOSED.format(seed="kind = 'table'"))
def evidence_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that the tables, their neighbours and their sidebars depend on."""
    u = units(spark, d)
    return closure.closure(u, u.where("kind = 'table'"))


@query(_CLOSED.format(seed="unit_id IN (SELECT unit_id FROM review_issues)") + " WHERE i.unit_id NOT IN (SELECT unit_id FROM review_issues)")
def outer_seams(spark: SparkSession, d: str) -> DataFrame:
    """What the reviewed units depend on beyond themselves."""
    u, seeds = units(spark, d), table(spark, d, "review_issues").select("unit_id").distinct()
    return closure.closure(u, seeds).join(seeds, "unit_id", "left_anti")


@query(_CLOSED.format(seed="(project_id, page) IN (SELECT (project_id, page) FROM u WHERE kind = 'equation')"))
def page_evidence_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that the pages with equations depend on."""
    u = units(spark, d)
    return closure.closure(u, u.join(u.where("kind = 'equation'").select("project_id", "page").distinct(), ["project_id", "page"], "left_semi"))


@query("SELECT DISTINCT issue_id, unit_id, severity, explanation, confidence FROM review_issues")
def ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Issues written as JSON lines and read back with a strict schema."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lines-{uuid.uuid4().hex}"
    rows = table(spark, d, "review_issues").select("issue_id", "unit_id", "severity", "explanation", "confidence").distinct()
    sinks.write_json_lines(rows, path)
    return documents.json_lines(spark, path, rows.schema)
