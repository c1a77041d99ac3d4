"""Queries over units and page blocks: scans, text functions, classifiers, layout, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import classify as C
from inkweave.functions import text as T
from inkweave.functions.fingerprints import SOURCE_FIELDS, STRUCTURE_FIELDS, fingerprint, ordered_fingerprint
from inkweave.functions.nested import header_cells, table_html, table_markdown
from inkweave.functions.python import inline_html_udf, math_to_latex_udf
from inkweave.operators import closure, layout, segment, sequence
from inkweave.sources.tables import table

QUERIES = {}
ORACLE: dict[str, str] = {}

U = "u AS (SELECT DISTINCT ON (unit_id) * FROM source_units)"
B = "b AS (SELECT DISTINCT ON (block_id) * FROM block_candidates)"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def units(spark: SparkSession, d: str) -> DataFrame:
    """Repeated rows of a unit count once."""
    return table(spark, d, "source_units").dropDuplicates(["unit_id"])


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "block_candidates").dropDuplicates(["block_id"])


@query(f"""WITH {U} SELECT project_id, kind, count(*) AS units,
  sum(len(list_filter(regexp_split_to_array(source_text, '\\s+'), lambda x: x <> '')))::BIGINT AS words,
  count_if(translatable)::BIGINT AS translatable_units FROM u GROUP BY ALL""")
def unit_inventory(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).groupBy("project_id", "kind").agg(F.count("*").alias("units"), F.sum(T.word_count(F.col("source_text"))).alias("words"), F.count_if("translatable").alias("translatable_units"))


_LIG = "replace(replace(replace(replace(replace(source_text,'ﬃ','ffi'),'ﬄ','ffl'),'ﬁ','fi'),'ﬂ','fl'),'ﬀ','ff')"


@query(f"""WITH {U}, a AS (SELECT unit_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_LIG}, chr(173), ''),
  '(?m)^\\x02[ \\t]*', '• ', 'g'), '[ \\t]*\\x02[ \\t]*', ' → ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'),
  '([A-Za-z])-[ \\t]*\\n[ \\t]*([a-z])', '\\1\\2', 'g'), '([A-Za-z])-\\s+([a-z])', '\\1\\2', 'g') AS t FROM u),
l AS (SELECT unit_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM a)
SELECT unit_id, sha256(CASE WHEN len(ls) = 0 THEN '' ELSE list_reduce(ls, lambda acc, x:
  CASE WHEN ends_with(acc, '-') AND regexp_matches(x, '^[a-z]') THEN regexp_replace(acc, '-$', '') || x
       WHEN regexp_matches(x, '^[,.;:!?)}}\\]]') THEN acc || x ELSE acc || ' ' || x END) END) AS prose_sha FROM l""")
def normalize_prose(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", F.sha2(T.normalize_prose(F.col("source_text")), 256).alias("prose_sha"))


@query(f"""WITH {U} SELECT unit_id, regexp_replace(lower(source_text), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS comparable,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(source_text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), '-+$', ''), ''), 'document') AS slug,
  nullif(regexp_replace(regexp_replace(source_text, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '') AS safe_name FROM u""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("source_text")
    return units(spark, d).select("unit_id", T.comparable(t).alias("comparable"), T.slugify(t).alias("slug"), T.safe_name(t).alias("safe_name"))


@query(f"""WITH {U}, x AS (SELECT unit_id, unnest(list_distinct(regexp_extract_all(lower(source_text), '[a-z][a-z0-9_.-]{{1,}}|[\\x{{3400}}-\\x{{9fff}}]{{2,}}'))) AS token FROM u)
SELECT token, count(*) AS units FROM x GROUP BY token""")
def memory_tokens(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select(F.explode(T.memory_tokens(F.col("source_text"))).alias("token")).groupBy("token").agg(F.count("*").alias("units"))


@query()
def protected_tokens(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", T.protected_tokens(F.col("source_text")).alias("tokens"))


@query(f"""WITH {U} SELECT unit_id, regexp_matches(replace(source_text, chr(10), ' '), '(?i)^(figure|fig\\.|table)\\s*\\d+(?:[-–.]\\d+)?[.:]?')
  AND NOT regexp_matches(replace(source_text, chr(10), ' '), '(?i)^(?:figure|fig\\.|table)\\s*\\d+(?:[-–.]\\d+)?\\s+(?:and|compares|demonstrates|illustrates|includes|lists|provides|sheds|shows|summarizes)\\b') AS caption,
  regexp_matches(replace(source_text, chr(10), ' '), '(?i)^(?:[•▪■●○◦–—-]|\\(?\\d+[.)]|[a-z][.)])\\s+') AS list_item,
  kind FROM u""")
def unit_shapes(spark: SparkSession, d: str) -> DataFrame:
    line = C.one_line(F.col("source_text"))
    return units(spark, d).select("unit_id", C.is_caption(line).alias("caption"), line.rlike(C.LIST_ITEM).alias("list_item"), "kind")


@query(f"""WITH {U} SELECT unit_id, code_language AS declared, CASE
  WHEN regexp_matches(source_text, '\\bxmlns(?::\\w+)?=') OR regexp_matches(source_text, '\\bx:(?:Class|Name|Key|TypeArguments)=') THEN 'xaml'
  WHEN regexp_matches(source_text, '</?[A-Za-z][^>]*>') AND (contains(source_text, 'xmlns') OR contains(source_text, 'x:Class') OR regexp_matches(source_text, '<(Grid|Window|Button)\\b')) THEN 'xaml'
  WHEN starts_with(regexp_replace(source_text, '^\\s+', ''), '<') AND regexp_matches(source_text, '</?[A-Za-z][^>]*>') THEN 'xml'
  WHEN regexp_matches(source_text, '\\b(namespace|using|public|private|protected|internal|class|foreach|override)\\b') AND regexp_matches(source_text, '[;{{}}]') THEN 'csharp'
  WHEN regexp_matches(source_text, '(?m)^\\s*(def|class|from|import)\\s+') THEN 'python'
  WHEN regexp_matches(source_text, '(?mi)^\\s*(SELECT|INSERT|UPDATE|CREATE)\\b') THEN 'sql'
  WHEN regexp_matches(source_text, '(?m)^\\s*(Get-|Set-|New-|\\$[A-Za-z_])') THEN 'powershell'
  WHEN regexp_matches(regexp_replace(source_text, '^\\s+', ''), '^[\\{{\\[]') AND regexp_matches(source_text, '"[^"\\n]+"\\s*:') THEN 'json'
  ELSE 'text' END AS detected FROM u WHERE kind = 'code'""")
def code_languages(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("kind = 'code'").select("unit_id", F.col("code_language").alias("declared"), C.code_language(F.col("source_text")).alias("detected"))


@query(f"""WITH {U}, f AS (SELECT *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(source_text, '`+'), lambda x: length(x))), 0) + 1)) AS fence FROM u WHERE kind = 'code')
SELECT unit_id, fence || coalesce(nullif(code_language, ''), 'text') || chr(10) || source_text || chr(10) || fence AS fenced FROM f""")
def fenced_code(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("kind = 'code'").select("unit_id", T.fenced_code(F.col("source_text"), F.col("code_language")).alias("fenced"))


@query()
def program_code(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", "kind", C.is_program_code(F.col("source_text")).alias("is_code"))


@query(f"""WITH {U} SELECT unit_id, kind, nullif(regexp_extract(source_text, '^\\s*(\\d+)[.)]\\s+', 1), '')::INT AS ordinal,
  CASE WHEN kind = 'list_item' THEN regexp_replace(source_text, '^\\s*(?:[-+*•▪■●]\\s+|\\d+[.)]\\s+)', '')
       ELSE regexp_replace(source_text, '(?i)^(?:[■▪●]\\s*)?(?:note|tip|warning|caution|what[’'']s new|注意|提示|警告|新增内容)\\s*[:：]?\\s*', '') END AS body,
  coalesce(callout_kind, CASE WHEN regexp_matches(source_text, '(?i)^(?:[■▪●]\\s*)?what[’'']s new\\b') THEN 'whats-new' ELSE nullif(lower(regexp_extract(source_text, '(?i)^(?:[■▪●]\\s*)?(note|tip|warning|caution)\\b', 1)), '') END, 'note') AS variant
FROM u WHERE kind IN ('list_item', 'note')""")
def marked_bodies(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("source_text")
    body = F.when(F.col("kind") == "list_item", T.list_body(t)).otherwise(T.note_body(t))
    return units(spark, d).where("kind IN ('list_item', 'note')").select("unit_id", "kind", T.list_ordinal(t).alias("ordinal"), body.alias("body"), T.note_variant(t, F.col("callout_kind")).alias("variant"))


@query()
def formulas(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("kind = 'equation'").select("unit_id", math_to_latex_udf("source_text").alias("latex_text"))


@query()
def inline_html(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("source_markdown IS NOT NULL").select("unit_id", inline_html_udf("source_markdown").alias("html"))


_CELL = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), chr(10), '<br>')"


@query(f"""WITH {U}, t AS (SELECT unit_id, table_data.row_cells AS r, table_data.header_rows AS h, table_data.column_count AS n FROM u WHERE table_data IS NOT NULL),
x AS (SELECT unit_id, r, h, n, CASE WHEN h > 0 THEN list_transform(range(n), lambda i: array_to_string(list_filter(list_transform(r[1:h], lambda q: q[i+1]), lambda c: c <> ''), ' / ')) ELSE list_transform(range(n), lambda i: '') END AS head FROM t)
SELECT unit_id, array_to_string(list_concat(['| ' || array_to_string(list_transform(head, lambda c: {_CELL.format(c='c')}), ' | ') || ' |', '| ' || array_to_string(list_transform(head, lambda c: '---'), ' | ') || ' |'],
  list_transform(r[h+1:], lambda q: '| ' || array_to_string(list_transform(q, lambda c: {_CELL.format(c='c')}), ' | ') || ' |')), chr(10)) AS markdown,
  array_to_string(head, ';') AS header FROM x""")
def table_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("table_data")
    return units(spark, d).where(t.isNotNull()).select("unit_id", table_markdown(t).alias("markdown"), F.array_join(header_cells(t), ";").alias("header"))


@query()
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("table_data IS NOT NULL").select("unit_id", table_html(F.col("table_data")).alias("html"))


@query(f"""WITH {U}, s AS (SELECT a.unit_id, b.unit_id AS next_unit, regexp_replace(regexp_replace(a.source_text, '<[^>]+>', '', 'g'), '\\s+$', '') AS l, regexp_replace(regexp_replace(b.source_text, '<[^>]+>', '', 'g'), '^\\s+', '') AS r FROM u a JOIN u b ON a.project_id = b.project_id AND b.pos = a.pos + 1 WHERE a.continued_to_next)
SELECT unit_id, next_unit, CASE WHEN l = '' OR r = '' THEN '' WHEN (regexp_matches(l, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]$') AND starts_with(r, '`')) THEN ' '
 WHEN regexp_matches(l, '[-‐‑]$') AND regexp_matches(r, '^[\\p{{L}}\\p{{N}}]') THEN ''
 WHEN regexp_matches(l, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]$') OR regexp_matches(r, '^[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN '' ELSE ' ' END AS separator FROM s""")
def continuation_separators(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d).select("project_id", "unit_id", "pos", "source_text", "continued_to_next")
    n = sequence.with_neighbour(u, "project_id", "pos", ["unit_id", "source_text"], 1, "next_").where("continued_to_next AND next_unit_id IS NOT NULL")
    return n.select("unit_id", F.col("next_unit_id").alias("next_unit"), T.continuation_separator(F.col("source_text"), F.col("next_source_text")).alias("separator"))


@query(f"""WITH {U} SELECT project_id, unit_id, page, previous_page FROM (SELECT *, lag(page) OVER (PARTITION BY project_id ORDER BY pos) AS previous_page FROM u) WHERE page - previous_page > 1""")
def page_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.page_gaps(units(spark, d))


@query(f"""WITH {U} SELECT unit_id, last(CASE WHEN kind = 'heading' THEN unit_id END IGNORE NULLS) OVER (PARTITION BY project_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM u""")
def parent_headings(spark: SparkSession, d: str) -> DataFrame:
    return sequence.parent_headings(units(spark, d))


_ISLANDS = f"""{U}, f AS (SELECT *, lag(continued_to_next) OVER (PARTITION BY project_id ORDER BY pos) AS pc FROM u),
i AS (SELECT project_id, unit_id, pos, sidebar_id, sum(CASE WHEN pos = 1 OR NOT (coalesce(continues_from_previous, false) OR coalesce(pc, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY pos)::BIGINT AS island FROM f)"""


@query(f"WITH {_ISLANDS} SELECT project_id, unit_id, pos, island FROM i")
def continuation_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequence.continuation_islands(units(spark, d))


@query(f"""WITH RECURSIVE {_ISLANDS}, e AS (SELECT DISTINCT project_id, island, sidebar_id FROM i WHERE sidebar_id IS NOT NULL),
p AS (SELECT DISTINCT a.project_id, a.island AS x, b.island AS y FROM e a JOIN e b USING (project_id, sidebar_id)),
r(project_id, x, y) AS (SELECT DISTINCT project_id, island, island FROM i UNION SELECT r.project_id, r.x, p.y FROM r JOIN p ON p.project_id = r.project_id AND p.x = r.y),
m AS (SELECT project_id, island, min(pos) AS low FROM i GROUP BY ALL),
g AS (SELECT r.project_id, r.x AS island, min(m.low) AS component FROM r JOIN m ON m.project_id = r.project_id AND m.island = r.y GROUP BY ALL)
SELECT i.project_id, i.unit_id, i.pos, g.component FROM i JOIN g USING (project_id, island)""")
def dependency_components(spark: SparkSession, d: str) -> DataFrame:
    return closure.components(units(spark, d).select("project_id", "unit_id", "pos", "sidebar_id", "continues_from_previous", "continued_to_next"))


@query(f"""WITH {U}, f AS (SELECT *, lag(kind) OVER w AS pk, lag(continued_to_next) OVER w AS pc, lag(code_language) OVER w AS pl FROM u WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN kind = 'code' AND pk = 'code' AND pc AND continues_from_previous AND pl IS NOT DISTINCT FROM code_language THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY pos) AS run FROM f)
SELECT arg_min(unit_id, pos) AS first_unit, count(*)::INT AS parts, string_agg(source_text, chr(10) ORDER BY pos) AS text FROM g WHERE kind = 'code' GROUP BY project_id, run""")
def joined_code(spark: SparkSession, d: str) -> DataFrame:
    return sequence.joined_runs(units(spark, d), "code", "code_language")


_BATCHES = """WITH RECURSIVE u0 AS (SELECT DISTINCT ON (unit_id) * FROM source_units),
u AS (SELECT project_id, unit_id, pos, page, kind, CASE WHEN translatable THEN len(list_filter(regexp_split_to_array(source_text, '\\s+'), lambda x: x <> '')) ELSE 0 END::INT AS words,
  lag(page) OVER (PARTITION BY project_id ORDER BY pos) AS pp FROM u0),
s AS (SELECT *, sum(CASE WHEN pp IS NULL OR page - pp > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY pos)::BIGINT AS stretch FROM u),
r AS (
  SELECT project_id, unit_id, pos, page, words, stretch, 1 AS batch, words AS filled FROM s WHERE pp IS NULL OR page - pp > 1
  UNION ALL
  SELECT s.project_id, s.unit_id, s.pos, s.page, s.words, s.stretch,
    CASE WHEN (r.filled + s.words > 900 AND s.page <> r.page) OR r.filled + s.words > 1350 OR (s.kind = 'heading' AND r.filled > 495) THEN r.batch + 1 ELSE r.batch END,
    CASE WHEN (r.filled + s.words > 900 AND s.page <> r.page) OR r.filled + s.words > 1350 OR (s.kind = 'heading' AND r.filled > 495) THEN 0 ELSE r.filled END + s.words
  FROM r JOIN s ON s.project_id = r.project_id AND s.pos = r.pos + 1 AND s.stretch = r.stretch)
"""


@query(_BATCHES + "SELECT project_id, unit_id, pos, page, words, stretch, batch FROM r")
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return segment.greedy_batches(units(spark, d))


@query(_BATCHES + """SELECT project_id, stretch, batch, min(pos) AS first_pos, max(pos) AS last_pos, min(page) AS first_page, max(page) AS last_page, count(*) AS units,
  sum(words)::BIGINT AS words, max(pos) - min(pos) + 1 = count(*) AS consecutive FROM r GROUP BY project_id, stretch, batch""")
def batch_bounds(spark: SparkSession, d: str) -> DataFrame:
    return segment.batch_bounds(segment.greedy_batches(units(spark, d)))


@query(f"""WITH {U} SELECT project_id, sidebar_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS members, count_if(sidebar_role = 'title')::BIGINT AS titles,
  arg_min(sidebar_role, pos) = 'title' AS title_first, max(pos) - min(pos) + 1 = count(*) AS contiguous FROM u WHERE sidebar_id IS NOT NULL GROUP BY ALL""")
def sidebar_bounds(spark: SparkSession, d: str) -> DataFrame:
    return (
        units(spark, d).where("sidebar_id IS NOT NULL").groupBy("project_id", "sidebar_id")
        .agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("members"), F.count_if(F.col("sidebar_role") == "title").alias("titles"),
             (F.min_by("sidebar_role", "pos") == "title").alias("title_first"), (F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("contiguous"))
    )


def _fp(fields: list[str]) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in sorted(fields)) + "))"


@query(f"WITH {U} SELECT unit_id, {_fp(SOURCE_FIELDS)} AS source_fp, {_fp(STRUCTURE_FIELDS)} AS structure_fp FROM u")
def unit_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("unit_id", fingerprint(SOURCE_FIELDS).alias("source_fp"), fingerprint(STRUCTURE_FIELDS).alias("structure_fp"))


@query(f"WITH {U} SELECT project_id, page, sha256(string_agg(unit_id || ':' || {_fp(SOURCE_FIELDS)}, chr(10) ORDER BY pos)) AS page_fp FROM u GROUP BY ALL")
def page_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).groupBy("project_id", "page").agg(ordered_fingerprint("pos", F.concat_ws(":", "unit_id", fingerprint(SOURCE_FIELDS))).alias("page_fp"))


@query(f"""WITH {B}, p AS (SELECT project_id, count(DISTINCT page) AS pages FROM b GROUP BY ALL),
k AS (SELECT project_id, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\d+', '#', 'g') AS key FROM b WHERE bbox.y1 < page_height * 0.11 OR bbox.y0 > page_height * 0.89),
c AS (SELECT project_id, key, count(*) AS blocks FROM k WHERE length(key) > 0 AND length(key) < 220 GROUP BY ALL)
SELECT project_id, key, blocks, pages, blocks >= greatest(2, ceil(pages / 2)) AS repeated FROM c JOIN p USING (project_id)""")
def repeated_margins(spark: SparkSession, d: str) -> DataFrame:
    return layout.repeated_margins(blocks(spark, d))


@query(f"""WITH {B}, p AS (SELECT project_id, count(DISTINCT page) AS pages FROM b GROUP BY ALL),
k AS (SELECT project_id, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\d+', '#', 'g') AS key FROM b WHERE bbox.y1 < page_height * 0.11 OR bbox.y0 > page_height * 0.89),
c AS (SELECT project_id, key FROM k JOIN p USING (project_id) WHERE length(key) > 0 AND length(key) < 220 GROUP BY ALL HAVING count(*) >= greatest(2, ceil(max(pages) / 2)))
SELECT block_id, ((c.key IS NOT NULL AND (bbox.y1 < page_height * 0.14 OR bbox.y0 > page_height * 0.86))
  OR (bbox.y1 < page_height * 0.08 AND bbox.y1 - bbox.y0 < 20 AND regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^[■▪●]?\\s*[A-Z][A-Z0-9 .&:;–—-]{{2,}}$'))
  OR (bbox.y0 > page_height * 0.92 AND bbox.y1 - bbox.y0 < 28 AND regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '(?i)^(?:(?:page\\s*)?\\d+|[ivxlcdm]+)$'))
  OR (bbox.x0 < page_width * 0.09 AND bbox.y1 - bbox.y0 > page_height * 0.35 AND bbox.x1 - bbox.x0 < 45)) AS marginal
FROM b LEFT JOIN c ON c.project_id = b.project_id AND c.key = regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\d+', '#', 'g')""")
def marginal_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    known = layout.repeated_margins(b).where("repeated").select("project_id", "key", "repeated")
    keyed = b.withColumn("key", C.marginal_key(T.strip(F.col("text")))).join(known, ["project_id", "key"], "left")
    return keyed.select("block_id", C.is_marginal(F.col("text"), F.col("bbox"), F.col("page_width"), F.col("page_height"), F.coalesce("repeated", F.lit(False))).alias("marginal"))


@query(f"WITH {B} SELECT project_id, page, count(*) AS blocks, sum(length(coalesce(text, '')))::BIGINT AS chars, sum(length(coalesce(text, ''))) < 20 AS manual FROM b GROUP BY ALL")
def source_inspection(spark: SparkSession, d: str) -> DataFrame:
    return layout.inspect(blocks(spark, d))


@query(f"WITH {B} SELECT project_id, page, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1, median(font_size) AS median_size FROM b GROUP BY ALL")
def page_geometry(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_geometry(blocks(spark, d))


@query(f"""WITH {B}, k AS (SELECT * FROM b WHERE kind <> 'figure')
SELECT x.project_id, x.page, x.block_id AS a, y.block_id AS b FROM k x JOIN k y ON x.project_id = y.project_id AND x.page = y.page AND x.ord < y.ord
WHERE least(x.bbox.x1, y.bbox.x1) > greatest(x.bbox.x0, y.bbox.x0) AND least(x.bbox.y1, y.bbox.y1) > greatest(x.bbox.y0, y.bbox.y0)
  AND (least(x.bbox.x1, y.bbox.x1) - greatest(x.bbox.x0, y.bbox.x0)) * (least(x.bbox.y1, y.bbox.y1) - greatest(x.bbox.y0, y.bbox.y0)) / greatest((x.bbox.x1 - x.bbox.x0) * (x.bbox.y1 - x.bbox.y0), 1.0) > 0.72""")
def overlapping_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.overlapping(blocks(spark, d))


@query(f"""WITH {B}, s AS (SELECT *, CASE WHEN bbox.x1 < page_width / 2 + 8 AND bbox.x0 < page_width / 2 - 25 THEN 1 WHEN bbox.x0 > page_width / 2 - 8 AND bbox.x1 > page_width / 2 + 25 THEN 2 ELSE 0 END AS side FROM b),
c AS (SELECT *, count_if(side = 1) OVER p >= 2 AND count_if(side = 2) OVER p >= 2 AS cols, coalesce(count_if(side = 0) OVER (PARTITION BY project_id, page ORDER BY bbox.y0, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM s WINDOW p AS (PARTITION BY project_id, page))
SELECT block_id, (row_number() OVER (PARTITION BY project_id, page ORDER BY CASE WHEN cols THEN seg ELSE 0 END, CASE WHEN cols THEN (CASE WHEN side = 0 THEN 3 ELSE side END) ELSE 0 END, CASE WHEN cols THEN bbox.y0 ELSE round(bbox.y0, 1) END, bbox.x0, block_id))::INT AS place FROM c""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(blocks(spark, d))


@query(f"""WITH {U}, {B}, a AS (SELECT project_id, page, token, count(*) AS n FROM (SELECT project_id, page, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+|[\\x{{0370}}-\\x{{03ff}}]|[\\x{{2200}}-\\x{{22ff}}]')) AS token FROM b) GROUP BY ALL),
m AS (SELECT project_id, page, token, count(*) AS m FROM (SELECT project_id, page, unnest(regexp_extract_all(lower(source_text), '[A-Za-z0-9]+|[\\x{{0370}}-\\x{{03ff}}]|[\\x{{2200}}-\\x{{22ff}}]')) AS token FROM u) GROUP BY ALL)
SELECT project_id, page, sum(n)::BIGINT AS tokens, sum(least(n, coalesce(m, 0)))::BIGINT AS captured, sum(least(n, coalesce(m, 0))) >= sum(n) * 0.72 AS enough FROM a LEFT JOIN m USING (project_id, page, token) GROUP BY ALL""")
def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    return layout.token_coverage(blocks(spark, d), units(spark, d))
