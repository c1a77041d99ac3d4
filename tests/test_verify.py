"""Checks of units and batches on small fixtures."""

import pytest

from inkweave.operators import ledger, quality, verify

UNIT = (
    "project_id string, unit_id string, pos bigint, page int, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double>, source_text string, source_markdown string, latex string, "
    "math_status string, asset_refs array<struct<path:string>>, table_data struct<row_cells:array<array<string>>>, verification_status string, code_language string, visual_text_status string, "
    "figure_labels array<struct<source:string,target:string>>, sidebar_id string, sidebar_role string, render_policy string, translatable boolean, clash string"
)


def unit(pos, kind="paragraph", text="Plain text.", **more):
    fields = {"project_id": "p", "unit_id": f"u{pos}", "pos": pos, "page": 1, "kind": kind, "bbox": (0.0, float(pos), 9.0, pos + 1.0), "source_text": text, "render_policy": "include", "translatable": True, "verification_status": "verified", "clash": "x"} | more
    return tuple(fields.get(c.strip().split(" ")[0]) for c in UNIT.replace("array<struct<source:string,target:string>>", "a").replace("struct<x0:double,y0:double,x1:double,y1:double>", "b").split(","))


def test_unit_rules(spark, rows):
    d = spark.createDataFrame(
        [
            unit(1), unit(2, "equation"), unit(3, "equation", latex="x", math_status="verified", asset_refs=[("a",)]), unit(4, "table", verification_status=None),
            unit(5, "code", "if (a) {\nb\n}\nc", code_language="text"), unit(6, "code", "if (a) {\n  b\n}", code_language="sql"), unit(7, text="a\x01"), unit(8, "figure", figure_labels=[("a", " ")]), unit(9, sidebar_id="s", verification_status="auto"),
        ],
        UNIT,
    )
    assert rows(verify.unit_rules(d)) == sorted(
        [
            ("u2", "missing-latex"), ("u2", "unverified-display-math"), ("u2", "missing-equation-evidence"), ("u4", "missing-table-structure"), ("u4", "unverified-table"), ("u5", "unknown-code-language"),
            ("u5", "code-indentation-suspect"), ("u7", "source-control-character"), ("u8", "unverified-figure-text"), ("u8", "untranslated-figure-label"), ("u9", "unverified-sidebar"),
        ],
        key=repr,
    )
    assert verify.unit_rules(d.limit(0)).count() == 0


def test_sidebars_and_their_pages(spark, rows):
    d = spark.createDataFrame(
        [unit(1, sidebar_id="s", sidebar_role="title"), unit(2), unit(3, sidebar_id="s", page=2), unit(4, sidebar_id="t", page=3), unit(5, page=4), unit(6, sidebar_id="v", sidebar_role="title"), unit(7, render_policy="omit", translatable=False), unit(8, sidebar_id="v")], UNIT
    )
    found = verify.sidebar_rules(d)
    assert rows(found) == [("p", "s", "noncontiguous-sidebar"), ("p", "t", "invalid-sidebar-title")]
    anchors = "project_id string, page int, unit_id string, sidebar_id string"
    pages = lambda *a: [r[1] for r in rows(verify.affected_pages(d, spark.createDataFrame([("p", *x) for x in a], anchors)))]
    assert pages((None, None, "s")) == [1, 2] and pages((None, "u3", None)) == [1, 2] and pages((4, None, None), (9, None, None)) == [4]
    assert pages((None, None, None)) == [1, 2, 3, 4]


def as_sql_says(spark, folder, units, name):
    import duckdb

    from inkweave.plans import registry

    spark.createDataFrame(units, UNIT).write.parquet(f"{folder}/source_units.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW source_units AS SELECT * FROM read_parquet('{folder}/source_units.parquet/*.parquet')")
    want = sorted(con.sql(registry.oracle_sql()[name]).fetchall(), key=repr)
    assert sorted((tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()), key=repr) == want
    return want


def placeless(row):
    return row[:2] + (None,) + row[3:]


FAR = 10**12
SPREAD = [
    unit(1, sidebar_id="s", sidebar_role="title"), unit(2, page=2), unit(FAR + 1, sidebar_id="s", sidebar_role="body", page=3), unit(FAR + 2, page=4),
    unit(5, project_id="q", sidebar_id="t", sidebar_role="title"), unit(7, project_id="q", render_policy="omit", translatable=False, page=5), unit(FAR + 3, project_id="q", sidebar_id="t", page=6),
    unit(10, "code", sidebar_id="c", sidebar_role="title", page=7), unit(11, sidebar_id="c", page=8), unit(13, "code", code_language="sql", page=9), unit(14, "code", code_language="text", page=10),
]


def test_pages_of_a_sidebar_over_far_positions(spark, tmp_path):
    assert as_sql_says(spark, tmp_path, SPREAD, "pages_of_findings") == [("p", 1), ("p", 10), ("p", 3), ("p", 7), ("p", 8)]


def test_sidebars_over_far_positions_and_without(spark, tmp_path):
    found = as_sql_says(spark, tmp_path, [*SPREAD, placeless(unit(20, sidebar_id="n", sidebar_role="body"))], "sidebar_findings")
    assert found == [("p", "n", "invalid-sidebar-title"), ("p", "s", "noncontiguous-sidebar")]


def test_sidebars_that_share_positions_and_have_nulls(spark, rows):
    d = spark.createDataFrame(
        [
            unit(1, sidebar_id="s"), unit(2, sidebar_id="s", sidebar_role="title"), unit(2, unit_id="x", sidebar_id="t", sidebar_role="title"), unit(4, sidebar_id="v", sidebar_role="title"), unit(5, render_policy=None, translatable=False), unit(6, sidebar_id="v"),
            placeless(unit(7, sidebar_id="w", sidebar_role="title")), unit(8, sidebar_id="w"), unit(9, project_id=None, sidebar_id="w"), placeless(unit(10, sidebar_id="n")),
        ],
        UNIT,
    )
    lost = [("p", "n", "invalid-sidebar-title"), ("p", "s", "noncontiguous-sidebar"), ("p", "t", "noncontiguous-sidebar"), ("p", "w", "invalid-sidebar-title"), (None, "w", "invalid-sidebar-title")]
    assert rows(verify.sidebar_rules(d)) == sorted(lost, key=repr)


def test_continuations(spark, rows):
    d = spark.createDataFrame([unit(1, text="It goes"), unit(2, text="and ends."), unit(3, text="It has no"), unit(4, text="end here.", page=2), unit(5, "heading", "and", page=2), unit(6, text="with", page=4)], UNIT)
    assert rows(verify.derived_continuations(d)) == [("u1", "u2"), ("u3", "u4")]


def test_batches(spark, rows):
    d = spark.createDataFrame([unit(1, text="one two"), unit(2, text="three", translatable=False, page=2), unit(3, render_policy="omit"), unit(4, text="four"), unit(5)], UNIT)
    m = spark.createDataFrame([("b", "u1"), ("b", "u4"), ("b", "u4"), ("gone", "u9"), ("gone", "u1")], "batch_id string, unit_id string")
    assert rows(verify.refreshed(d, m)) == [("b", "p", 3, 2, 3, "1,2", 0), ("gone", "p", None, None, None, None, 1)]
    assert rows(verify.unbatched(d, m)) == [("p", "u2"), ("p", "u5")]
    s = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("a", 1)], "n string, e int")
    assert rows(verify.subsets(s, "n", "e")) == [("a", "b")]


def test_mappings(spark, rows):
    d = spark.createDataFrame([unit(1, source_markdown="so $x^2$ is"), unit(2, "figure", figure_labels=[("a", None)]), unit(3, source_markdown="$5 and")], UNIT)
    c = spark.createDataFrame([("u1", "so $y$", None), ("u2", "t", [("b", "B")]), ("u3", "x", None), ("u9", "x", None)], "unit_id string, target_text string, figure_labels array<struct<source:string,target:string>>")
    assert rows(quality.mapping_rules(d, c)) == [("u1", "inline-latex-missing"), ("u2", "figure-label-mapping-mismatch"), ("u9", "unknown-unit")]


def test_resolutions_of_unknown_issues_are_errors(spark):
    i = spark.createDataFrame([("a", "open", None)], "issue_id string, status string, resolution string")
    with pytest.raises(ValueError):
        ledger.resolve(i, spark.createDataFrame([("b", "resolved", "x")], i.schema))
