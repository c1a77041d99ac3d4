"""Queries over the ledgers: current state, changes, quality rules, terms, reports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.functions.nested import equal_share
from inkweave.operators import ledger, quality, render, retrieval, segment
from inkweave.operators.history import versions
from inkweave.plans.units import _BATCHES, B, U, blocks, units
from inkweave.sources.documents import event_usage
from inkweave.sources.tables import table
from inkweave.streaming import ledgers

QUERIES = {}
ORACLE: dict[str, str] = {}

H = "c AS (SELECT * FROM translation_history QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY line_no DESC) = 1)"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last record of each unit in the order of arrival; only the named columns are moved."""
    h = table(spark, d, "translation_history").select("unit_id", "line_no", *columns)
    return ledger.latest(h, ["unit_id"], ["line_no"])


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return quality.aligned(units(spark, d), current(spark, d, "target_text", "target_table", "source_hash"), table(spark, d, "projects"))


@query(f"WITH {H} SELECT unit_id, line_no, revision, status, sha256(target_text) AS target_sha FROM c")
def current_records(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "revision", "status", "target_text").select("unit_id", "line_no", "revision", "status", F.sha2("target_text", 256).alias("target_sha"))


@query("""WITH d AS (SELECT unit_id, updated_at, arg_max(target_text, line_no) AS t FROM translation_history WHERE updated_at IS NOT NULL GROUP BY ALL),
f AS (SELECT *, lag(t) OVER w AS p, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY unit_id ORDER BY updated_at))
SELECT unit_id, count(*) AS states, count_if(n > 1 AND t IS NOT DISTINCT FROM p)::BIGINT AS noops FROM f GROUP BY unit_id""")
def semantic_noops(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "translation_history").select("unit_id", "line_no", "updated_at", F.sha2("target_text", 256).alias("payload"))
    states = h.where("updated_at IS NOT NULL").select("unit_id", "updated_at").distinct().groupBy("unit_id").agg(F.count("*").alias("states"))
    changes = versions(h, "unit_id", ["payload"], "updated_at", "line_no").groupBy("unit_id").agg(F.count("*").alias("n"))
    return states.join(changes, "unit_id").select("unit_id", "states", (F.col("states") - F.col("n")).alias("noops"))


@query("""WITH a AS (SELECT unit_id, arg_max(target_text, line_no) AS t FROM translation_history GROUP BY ALL), z AS (SELECT unit_id, arg_max(target_text, line_no) AS t FROM translation_history WHERE revision = 1 GROUP BY ALL)
SELECT unit_id, CASE WHEN z.unit_id IS NULL THEN 'added' WHEN a.unit_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN z USING (unit_id) WHERE a.t IS DISTINCT FROM z.t OR z.unit_id IS NULL""")
def changed_units(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "translation_history").select("unit_id", "line_no", "revision", F.sha2("target_text", 256).alias("v"))
    return ledger.change_set(ledger.latest(h, ["unit_id"], ["line_no"]), ledger.latest(h.where("revision = 1"), ["unit_id"], ["line_no"]), "unit_id", "v")


@query("""WITH a AS (SELECT unit_id, arg_max(target_text, line_no) AS t, arg_max(source_hash, line_no) AS h FROM translation_history WHERE revision = 1 GROUP BY ALL),
b AS (SELECT unit_id, arg_max(target_text, line_no) AS t, arg_max(source_hash, line_no) AS h FROM translation_history WHERE revision > 1 GROUP BY ALL)
SELECT unit_id, CASE WHEN a.unit_id IS NULL THEN 1 WHEN b.unit_id IS NOT NULL AND a.t IS DISTINCT FROM b.t THEN 2 ELSE 1 END::INT AS revision,
 CASE WHEN b.unit_id IS NULL THEN 'kept' WHEN a.unit_id IS NULL THEN 'inserted' WHEN a.t IS DISTINCT FROM b.t THEN 'revised' WHEN a.h IS DISTINCT FROM b.h THEN 'rebound' ELSE 'unchanged' END AS action FROM a FULL JOIN b USING (unit_id)""")
def merged_submission(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "translation_history").select("unit_id", "line_no", "revision", "target_text", "source_hash")
    old, new = (ledger.latest(h.where(w), ["unit_id"], ["line_no"]) for w in ("revision = 1", "revision > 1"))
    return ledger.upsert(old, new, "unit_id", F.sha2("target_text", 256), "source_hash")


@query(f"""WITH {U}, w AS (SELECT unit_id FROM u WHERE translatable), s AS (SELECT unit_id, count(*) AS n FROM translation_history WHERE revision = 1 AND status = 'draft' GROUP BY ALL)
SELECT unit_id, CASE WHEN s.unit_id IS NULL THEN 'missing' WHEN w.unit_id IS NULL THEN 'extra' ELSE 'duplicate' END AS problem FROM w FULL JOIN s USING (unit_id) WHERE s.unit_id IS NULL OR w.unit_id IS NULL OR n > 1""")
def submission_diff(spark: SparkSession, d: str) -> DataFrame:
    return ledger.submission_diff(units(spark, d).where("translatable"), table(spark, d, "translation_history").where("revision = 1 AND status = 'draft'"), "unit_id")


@query(f"WITH {U} SELECT project_id, kind, count(*) AS units FROM u WHERE translatable AND render_policy = 'include' AND NOT EXISTS (SELECT 1 FROM translation_history h WHERE h.unit_id = u.unit_id) GROUP BY ALL")
def untranslated(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d).where("translatable AND render_policy = 'include'")
    return u.join(table(spark, d, "translation_history").select("unit_id"), "unit_id", "left_anti").groupBy("project_id", "kind").agg(F.count("*").alias("units"))


_A = f"""{U}, {H}, a AS (SELECT u.*, c.target_text, c.target_table, c.source_hash AS bound, c.unit_id IS NOT NULL AS has, p.source_language AS sl, p.target_language AS tl,
  CASE WHEN c.target_table IS NOT NULL THEN c.target_text || chr(10) || array_to_string(list_transform(c.target_table.row_cells, lambda r: array_to_string(r, ' | ')), chr(10)) ELSE c.target_text END AS eff
  FROM u LEFT JOIN c ON c.unit_id = u.unit_id LEFT JOIN projects p ON p.project_id = u.project_id WHERE u.translatable),
w AS (SELECT *, len(regexp_extract_all(source_text, '[A-Za-z]{{2,}}')) AS words, length(eff) / greatest(length(source_text), 1) AS ratio, sl = 'en' AND tl = 'zh-CN' AND kind <> 'code' AS zh,
  CASE WHEN sl = 'en' AND tl = 'zh-CN' THEN 0.15 ELSE 0.25 END AS low FROM a)"""


@query(f"""WITH {_A} SELECT unit_id, code, severity FROM (
SELECT unit_id, 'missing-translation' AS code, 'error' AS severity, NOT has AS t FROM w UNION ALL
SELECT unit_id, 'source-hash-mismatch', 'error', has AND bound <> source_hash FROM w UNION ALL
SELECT unit_id, 'empty-translation', 'error', has AND regexp_replace(eff, '^\\s+|\\s+$', '', 'g') = '' FROM w UNION ALL
SELECT unit_id, 'target-structural-markup', 'error', (kind = 'heading' AND regexp_matches(target_text, '^\\s*#{{1,6}}\\s+')) OR (kind = 'list_item' AND regexp_matches(target_text, '^\\s*(?:[-+*•▪■●]\\s+|\\d+[.)]\\s+)'))
  OR (kind = 'note' AND (regexp_matches(target_text, '^\\s*>') OR regexp_matches(target_text, '(?i)\\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\\]') OR regexp_matches(target_text, '(?i)^\\s*(?:注意|提示|警告|新增内容|note|tip|warning|caution|what[’'']s new)\\s*[:：]'))) FROM w UNION ALL
SELECT unit_id, 'length-outlier', 'warning', has AND (ratio < low OR ratio > 2.2) FROM w UNION ALL
SELECT unit_id, 'missing-target-table', 'error', has AND kind = 'table' AND target_table IS NULL FROM w UNION ALL
SELECT unit_id, 'table-shape-mismatch', 'error', kind = 'table' AND (target_table.column_count <> table_data.column_count OR len(target_table.row_cells) <> len(table_data.row_cells)) FROM w UNION ALL
SELECT unit_id, 'agent-analysis-leak', 'error', contains(target_text, '<!-- unit:') OR contains(target_text, '```json') OR contains(target_text, '![') FROM w UNION ALL
SELECT unit_id, 'untranslated-target', 'error', zh AND length(source_text) >= 80 AND words >= 8 AND regexp_replace(target_text, '^\\s+|\\s+$', '', 'g') = regexp_replace(source_text, '^\\s+|\\s+$', '', 'g') FROM w UNION ALL
SELECT unit_id, 'target-language-suspect', 'warning', zh AND NOT (length(source_text) >= 80 AND words >= 8 AND regexp_replace(target_text, '^\\s+|\\s+$', '', 'g') = regexp_replace(source_text, '^\\s+|\\s+$', '', 'g')) AND words >= 12 AND NOT regexp_matches(target_text, '[\\x{{3400}}-\\x{{9fff}}]') FROM w UNION ALL
SELECT unit_id, 'inline-math-ocr-suspect', 'warning', has AND regexp_matches(source_text, '\\b(?:Re|R|St)\\d+(?:/\\d+)?\\b|[ρντλ]\\d+(?:/\\d+)?\\b|×\\s*10\\d{{2,}}\\b') FROM w) WHERE t""")
def qa_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.row_rules(_aligned(spark, d))


@query()
def qa_number_deficits(spark: SparkSession, d: str) -> DataFrame:
    return quality.token_deficits(_aligned(spark, d))


@query()
def qa_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_tokens(_aligned(spark, d))


_TERM = f"""{_A}, r AS (SELECT *, lower(regexp_replace(array_to_string(list_filter(list_concat([source_text, CASE WHEN source_markdown <> source_text THEN source_markdown END], coalesce(flatten(table_data.row_cells), []), coalesce(list_transform(figure_labels, lambda x: x.source), [])), lambda x: x IS NOT NULL AND x <> ''), chr(10)), '["“][^"”]{{2,}}["”]', ' ', 'g')) AS s FROM w WHERE has),
t AS (SELECT * FROM glossary_terms WHERE status = 'approved')"""


def _termed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Translated units with all that is theirs in the source, and the approved terms; ``pair`` is the language pair of both."""
    pair = F.concat_ws(">", "source_language", "target_language").alias("pair")
    rows = F.transform(F.col("target_table.row_cells"), lambda r: F.array_join(r, " | "))
    effective = F.when(F.col("target_table").isNotNull(), F.concat("target_text", F.lit("\n"), F.array_join(rows, "\n"))).otherwise(F.col("target_text"))
    a = _aligned(spark, d).where(F.col("target_text").isNotNull())
    texts = a.select("unit_id", "page", "parent_id", pair, effective.alias("effective"), T.without_quoted_titles(render.source_representation()).alias("source"))
    return texts, table(spark, d, "glossary_terms").where("status = 'approved'").select("term_id", "scope", "source", "target", "forbidden", pair)


@query(f"""WITH {_TERM} SELECT unit_id, term_id FROM r JOIN t ON t.source_language = r.sl AND t.target_language = r.tl AND t.source <> '' AND t.target <> '' AND contains(r.s, lower(t.source))
WHERE (scope = 'document' OR scope = 'page:' || page::VARCHAR OR scope IS NOT DISTINCT FROM parent_id) AND NOT contains(eff, t.target)""")
def approved_terms_missing(spark: SparkSession, d: str) -> DataFrame:
    a, t = _termed(spark, d)
    found = retrieval.contained_terms(a, ["unit_id", "page", "parent_id", "effective"], "source", "pair", t.where("target <> ''").select("term_id", F.col("pair").alias("language"), F.col("source").alias("form")))
    wanted = found.join(t.select("term_id", "scope", F.col("target").alias("wanted")), "term_id")
    return wanted.where(retrieval.in_scope(F.col("scope"), F.col("page"), F.col("parent_id")) & ~F.contains("effective", "wanted")).select("unit_id", "term_id")


@query(f"""WITH {_TERM}, f AS (SELECT term_id, source_language, target_language, unnest(forbidden) AS word FROM t)
SELECT DISTINCT unit_id, term_id FROM r JOIN f ON f.source_language = r.sl AND f.target_language = r.tl AND f.word <> '' AND contains(eff, f.word)""")
def forbidden_terms(spark: SparkSession, d: str) -> DataFrame:
    """Forbidden words as they are spelled, in any scope."""
    a, t = _termed(spark, d)
    return retrieval.contained_terms(a, ["unit_id"], "effective", "pair", t.select("term_id", F.col("pair").alias("language"), F.explode("forbidden").alias("form")), exact=True)


@query(f"""WITH {_TERM}, f AS (SELECT term_id, source_language, target_language, target AS word FROM t)
SELECT DISTINCT unit_id, term_id FROM r JOIN f ON f.source_language = r.sl AND f.target_language = r.tl AND f.word <> '' AND contains(eff, f.word)""")
def used_terms(spark: SparkSession, d: str) -> DataFrame:
    """Approved renderings as they are spelled in the targets."""
    a, t = _termed(spark, d)
    return retrieval.contained_terms(a, ["unit_id"], "effective", "pair", t.select("term_id", F.col("pair").alias("language"), F.col("target").alias("form")), exact=True)


@query()
def carried_over(spark: SparkSession, d: str) -> DataFrame:
    old = units(spark, d).select("project_id", "page", F.col("pos").cast("long").alias("ord"), F.col("unit_id").alias("id"), "kind", F.col("source_text").alias("text"))
    new = blocks(spark, d).select("project_id", "page", F.col("ord").cast("long").alias("ord"), F.col("block_id").alias("id"), "kind", "text")
    return retrieval.carry_over(old, new)


@query(f"""WITH {U}, {H}, j AS (SELECT u.project_id, u.page, coalesce(octet_length(encode(u.source_text)), 0) AS s, coalesce(octet_length(encode(c.target_text)), 0) AS t FROM u LEFT JOIN c USING (unit_id))
SELECT project_id, sum(s)::BIGINT AS source_bytes, sum(t)::BIGINT AS target_bytes, count(*) AS units FROM j GROUP BY ALL""")
def packet_bytes(spark: SparkSession, d: str) -> DataFrame:
    j = units(spark, d).join(current(spark, d, "target_text"), "unit_id", "left")
    size = lambda c: F.sum(F.coalesce(F.octet_length(c), F.lit(0))).cast("long")
    return j.groupBy("project_id").agg(size("source_text").alias("source_bytes"), size("target_text").alias("target_bytes"), F.count("*").alias("units"))


@query(_BATCHES + """, b AS (SELECT project_id, stretch, batch, sum(words) AS total, count(*) AS parts, min(pos) AS p0 FROM r GROUP BY ALL)
SELECT r.unit_id, (b.total // b.parts + CASE WHEN r.pos - b.p0 < b.total % b.parts THEN 1 ELSE 0 END)::BIGINT AS share FROM r JOIN b USING (project_id, stretch, batch)""")
def allocated_shares(spark: SparkSession, d: str) -> DataFrame:
    r = segment.greedy_batches(units(spark, d))
    b = r.groupBy("project_id", "stretch", "batch").agg(F.sum("words").alias("total"), F.count("*").alias("parts"), F.min("pos").alias("p0"))
    return r.join(b, ["project_id", "stretch", "batch"]).select("unit_id", equal_share(F.col("total"), F.col("parts"), F.col("pos") - F.col("p0")).alias("share"))


@query("""SELECT issue_id, sha256(batch_id || ':' || unit_id || ':' || row_number() OVER (PARTITION BY batch_id, unit_id ORDER BY issue_id)::VARCHAR) AS canonical_id FROM (SELECT DISTINCT ON (issue_id) * FROM review_issues)""")
def canonical_issue_ids(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i = table(spark, d, "review_issues").dropDuplicates(["issue_id"])
    n = F.row_number().over(Window.partitionBy("batch_id", "unit_id").orderBy("issue_id"))
    return i.select("issue_id", F.sha2(F.concat_ws(":", "batch_id", "unit_id", n.cast("string")), 256).alias("canonical_id"))


@query("""SELECT batch_id, severity, status, count(*) AS issues, max(CASE severity WHEN 'blocker' THEN 3 WHEN 'major' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END)::INT AS rank FROM (SELECT DISTINCT ON (issue_id) * FROM review_issues) GROUP BY ALL""")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("severity") == "blocker", 3).when(F.col("severity") == "major", 2).when(F.col("severity") == "minor", 1).otherwise(0)
    return table(spark, d, "review_issues").dropDuplicates(["issue_id"]).groupBy("batch_id", "severity", "status").agg(F.count("*").alias("issues"), F.max(rank).alias("rank"))


@query(f"""WITH {U}, {H} SELECT DISTINCT issue_id, i.source_span IS NULL OR contains(u.source_text, i.source_span) AS in_source, i.target_span IS NULL OR coalesce(contains(c.target_text, i.target_span), false) AS in_target
FROM review_issues i JOIN u ON u.unit_id = i.unit_id LEFT JOIN c ON c.unit_id = i.unit_id""")
def cited_spans(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "review_issues").select("issue_id", "unit_id", "source_span", "target_span").distinct()
    j = i.join(units(spark, d).select("unit_id", "source_text"), "unit_id").join(current(spark, d, "target_text").select("unit_id", "target_text"), "unit_id", "left")
    return j.select("issue_id", (F.col("source_span").isNull() | F.contains("source_text", "source_span")).alias("in_source"), (F.col("target_span").isNull() | F.coalesce(F.contains("target_text", "target_span"), F.lit(False))).alias("in_target"))


@query(f"""WITH {H} SELECT DISTINCT unit_id, kind, entry FROM (SELECT unit_id, 'uncertainty' AS kind, unnest(uncertainties) AS entry FROM c UNION ALL SELECT unit_id, 'issue', severity || ': ' || explanation FROM review_issues WHERE status = 'open')""")
def unresolved(spark: SparkSession, d: str) -> DataFrame:
    return render.unresolved(current(spark, d, "uncertainties"), table(spark, d, "review_issues"))


@query(f"""WITH {U} SELECT unit_id, sha256(array_to_string(list_filter(list_concat([source_text, CASE WHEN source_markdown <> source_text THEN source_markdown END], coalesce(flatten(table_data.row_cells), []), coalesce(list_transform(figure_labels, lambda x: x.source), [])), lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS text_sha FROM u""")
def source_representations(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", F.sha2(render.source_representation(), 256).alias("text_sha"))


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.pages(units(spark, d), current(spark, d, "target_text"))


@query(f"""WITH {H} SELECT c.unit_id, CASE WHEN regexp_matches(c.target_text, '(?s)^\\s*(图|表)\\s*(\\d+(?:\\s*[-–—]\\s*\\d+)*)\\s*(?:[。.．:：]+\\s*)?(\\S(?:.*\\S)?)\\s*$')
 THEN regexp_extract(c.target_text, '(?s)^\\s*(图|表)\\s*(\\d+(?:\\s*[-–—]\\s*\\d+)*)\\s*(?:[。.．:：]+\\s*)?(\\S(?:.*\\S)?)\\s*$', 1) || ' ' || regexp_replace(regexp_extract(c.target_text, '(?s)^\\s*(图|表)\\s*(\\d+(?:\\s*[-–—]\\s*\\d+)*)\\s*(?:[。.．:：]+\\s*)?(\\S(?:.*\\S)?)\\s*$', 2), '\\s+', '', 'g') || ' ' || regexp_extract(c.target_text, '(?s)^\\s*(图|表)\\s*(\\d+(?:\\s*[-–—]\\s*\\d+)*)\\s*(?:[。.．:：]+\\s*)?(\\S(?:.*\\S)?)\\s*$', 3)
 ELSE c.target_text END AS caption FROM c""")
def caption_texts(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "target_text").select("unit_id", T.normalize_zh_caption(F.col("target_text")).alias("caption"))


@query("SELECT event_type, count(*) AS rows, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS units FROM events GROUP BY ALL")
def payload_usage(spark: SparkSession, d: str) -> DataFrame:
    return event_usage(table(spark, d, "events"), "event_type", "props", {"units": ["k", "units"]})


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    s = ledgers.ledger(spark, path, spark.read.parquet(path).schema)
    counted = ledgers.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour")
    out = ledgers.drain(counted, "counts", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_distinct(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    s = ledgers.ledger(spark, path, spark.read.parquet(path).schema).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return ledgers.drain(ledgers.without_repeats(s, ["user_id", "event_type"], "ts", "1000 days"), "distinct").select("user_id", "event_type")
