"""Operators on small fixtures, with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkweave.functions import classify as C
from inkweave.operators import closure, fragments, layout, ledger, lineage, overrides, quality, retrieval, segment, sequence
from inkweave.operators.history import versions
from inkweave.sources import documents

T0 = dt.datetime(2024, 1, 1)
LEDGER = "unit_id string, revision int, status string, updated_at timestamp, line_no bigint, k string, t string"


def fold(rows):
    by = defaultdict(dict)
    for u, r, s, at, n in rows:
        if u is not None and at is not None and (at not in by[u] or n > by[u][at][0]):
            by[u][at] = (n, (r, s))
    out = []
    for u, m in by.items():
        runs = []
        for at in sorted(m):
            if not runs or runs[-1][0] != m[at][1]:
                runs.append((m[at][1], at))
        us = lambda x: int((x - T0).total_seconds() * 1e6) + 1704067200000000
        for i, ((r, s), at) in enumerate(runs):
            out.append((u, r, s, us(at), us(runs[i + 1][1]) if i + 1 < len(runs) else -1))
    return sorted(out, key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 2), st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.integers(0, 12))), max_size=40))
def test_versions_match_a_plain_fold(spark, data):
    rows = [(u, r, s, None if at is None else T0 + dt.timedelta(seconds=at), n) for n, (u, r, s, at) in enumerate(data)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], LEDGER)
    got = versions(df.unionAll(df), "unit_id", ["revision", "status"], "updated_at", "line_no", partitions=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == fold(rows)


def test_versions_of_a_hot_entity(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else f"u{i % 9}", rnd.randrange(2), "s", T0 + dt.timedelta(seconds=rnd.randrange(500)), i) for i in range(3000)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], LEDGER)
    got = versions(df, "unit_id", ["revision", "status"], "updated_at", "line_no", partitions=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == fold(rows)


UNIT = "project_id string, unit_id string, pos bigint, page int, kind string, source_text string, translatable boolean, sidebar_id string, continues_from_previous boolean, continued_to_next boolean, code_language string"


def linear(spark, n=11, **special):
    rows = []
    for i in range(1, n + 1):
        x = {"kind": "paragraph", "text": "w " * 60, "side": None, "from": False, "to": False} | special.get(f"u{i}", {})
        rows.append(("p", f"u{i}", i, x.get("page", i), x["kind"], x["text"], True, x["side"], x["from"], x["to"], None))
    return spark.createDataFrame(rows, UNIT)


def ids(df):
    return sorted(int(r["unit_id"][1:]) for r in df.select("unit_id").collect())


@pytest.mark.parametrize("seed, expected", [(8, [7, 8, 9]), (7, [6, 7, 8]), (9, [8, 9, 10])])
def test_closure_is_bounded_by_the_batches(spark, seed, expected):
    scope = spark.createDataFrame([(f"u{i}", "b1" if i <= 5 else "b2" if i <= 10 else "b3") for i in range(1, 12)], "unit_id string, batch_id string")
    seeds = spark.createDataFrame([(f"u{seed}",), ("unknown",)], "unit_id string")
    assert ids(closure.closure(linear(spark), seeds, scope)) == expected


def test_closure_follows_chains_and_sidebars(spark):
    u = linear(spark, 6, u2={"side": "s"}, u3={"side": "s", "to": True})
    seeds = spark.createDataFrame([("u1",)], "unit_id string")
    got = closure.closure(u, seeds)
    assert ids(got) == [1, 2, 3, 4]
    again = closure.closure(u, got)
    assert set(ids(again)) >= {1, 2, 3, 4}


def test_batches_cut_where_documented(spark):
    u = linear(spark, 4, u1={"text": "w " * 60, "page": 1}, u2={"text": "w " * 60, "page": 1}, u3={"text": "w " * 60, "page": 2}, u4={"text": "w " * 5, "page": 4})
    got = {r["unit_id"]: (r["stretch"], r["batch"]) for r in segment.greedy_batches(u, 100).collect()}
    assert got == {"u1": (1, 1), "u2": (1, 1), "u3": (1, 2), "u4": (2, 1)}
    with pytest.raises(ValueError):
        segment.greedy_batches(u, 99)
    assert segment.batch_bounds(segment.greedy_batches(u, 100)).where("consecutive").count() == 3


def test_running_total_crosses_chunks(spark):
    d = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("pos"), F.col("id").alias("v"))
    got = sequence.running_total(d, "g", "pos", F.col("v"), "s", chunk=7)
    assert all(r["s"] == r["pos"] * (r["pos"] + 1) // 2 for r in got.collect())


def test_empty_tables(spark):
    u = spark.createDataFrame([], UNIT)
    assert closure.components(u).count() == segment.greedy_batches(u).count() == sequence.continuation_islands(u).count() == 0
    assert versions(spark.createDataFrame([], LEDGER), "unit_id", ["revision"], "updated_at", "line_no").count() == 0


def test_ledger_steps(spark, rows):
    h = spark.createDataFrame([("a", 1, "x", "h1"), ("a", 2, "y", "h1"), ("b", 1, None, "h1")], "unit_id string, revision int, t string, h string")
    assert rows(ledger.latest(h, ["unit_id"], ["revision"])) == [("a", 2, "y", "h1"), ("b", 1, None, "h1")]
    new = spark.createDataFrame([("a", "y", "h2"), ("b", "z", "h1"), ("c", "q", "h1")], "unit_id string, t string, h string")
    cur = ledger.latest(h, ["unit_id"], ["revision"])
    got = rows(ledger.upsert(cur, new, "unit_id", F.col("t"), "h"))
    assert got == [("a", 2, "rebound"), ("b", 2, "revised"), ("c", 1, "inserted")]
    assert rows(ledger.change_set(cur, new, "unit_id", "t")) == [("b", "changed"), ("c", "removed")]
    assert rows(ledger.submission_diff(cur, new.unionAll(new.where("unit_id = 'a'")), "unit_id")) == [("a", "duplicate"), ("c", "extra")]


def test_terms(spark, rows):
    texts = spark.createDataFrame([(1, "The Buffer is empty", "en"), (2, None, "en"), (3, "缓冲区为空", "zh")], "id int, t string, l string")
    terms = spark.createDataFrame([(10, "en", "buffer"), (11, "en", "buff"), (12, "zh", "缓冲"), (13, "en", "")], "term_id int, language string, form string")
    assert rows(retrieval.contained_terms(texts, ["id"], "t", "l", terms)) == [(1, 10), (1, 11), (3, 12)]
    assert retrieval.contained_terms(texts, ["id"], "t", "l", terms.limit(0)).count() == 0


def test_carry_over_is_one_to_one(spark, rows):
    s = "project_id string, page int, ord bigint, id string, kind string, text string"
    old = spark.createDataFrame([("p", 1, 1, "o1", "paragraph", "the same words here"), ("p", 1, 2, "o2", "note", "the same words her")], s)
    new = spark.createDataFrame([("p", 1, 1, "n1", "paragraph", "The same words here!"), ("p", 1, 2, "n2", "paragraph", "the same words here"), ("p", 1, 3, "n3", "heading", "the same words here")], s)
    assert [(r[0], r[1]) for r in rows(retrieval.carry_over(old, new))] == [("n1", "o1"), ("n2", "o2")]


def test_memory_and_cover(spark, rows):
    cur = spark.createDataFrame([("c", "alpha beta")], "unit_id string, source_text string")
    mem = spark.createDataFrame([("m1", 1, "alpha beta", False), ("m2", 2, "gamma", True), ("m3", 3, "alpha beta", False), ("c", 4, "alpha", False)], "unit_id string, line_no bigint, source_text string, adjacent boolean")
    assert [(r["unit_id"], r["rank"]) for r in retrieval.translation_memory(cur, mem, 2).orderBy("rank").collect()] == [("m2", 1), ("m1", 2)]
    m = [("b1", "2024", {"x", "y"}), ("b2", "2025", {"y", "z"}), ("b3", "2025", {"x", "y"})]
    assert retrieval.greedy_cover({"x", "y", "z"}, m) == ["b2", "b3"]
    assert retrieval.greedy_cover({"q"}, m) is None


def test_audit_coverage(spark, rows):
    req = spark.createDataFrame([("b", "u1", "f1"), ("b", "u2", "f2")], "batch_id string, unit_id string, fp string")
    runs = spark.createDataFrame([("l1", "b", "u1", "f1", 5), ("l1", "b", "u2", "old", 5), ("l2", "b", "u1", "f1", 1)], "lens string, batch_id string, unit_id string, fp string, reviewed_at int")
    inv = spark.createDataFrame([("b", "u1", 3)], "batch_id string, unit_id string, invalidated_at int")
    got = {(r["unit_id"], r["lens"]): r["covered"] for r in quality.audit_coverage(req, runs, inv, ["l1", "l2"]).collect()}
    assert got == {("u1", "l1"): True, ("u1", "l2"): False, ("u2", "l1"): False, ("u2", "l2"): False}


def test_overlaps_and_gaps(spark, rows):
    s = "project_id string, page int, ord int, block_id string, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    b = spark.createDataFrame([("p", 1, 1, "a", "paragraph", (0.0, 0.0, 10.0, 10.0)), ("p", 1, 2, "b", "paragraph", (0.0, 0.0, 10.0, 9.0)), ("p", 1, 3, "c", "figure", (0.0, 0.0, 10.0, 10.0))], s)
    assert rows(layout.overlapping(b)) == [("p", 1, "a", "b")]
    u = linear(spark, 3, u3={"page": 9})
    assert rows(sequence.page_gaps(u)) == [("p", "u3", 9, 2)]


def test_page_ranges(spark, rows):
    assert documents.page_ranges("7,1-3, 2-4", 9) == [(1, 4), (7, 7)]
    assert rows(documents.pages(spark, "1-3, 7", 9)) == [(1,), (2,), (3,), (7,)]
    assert documents.page_ranges(None, 3) == documents.page_ranges(" ALL ", 3) == [(1, 3)]
    assert spark.range(1, 10).where(documents.on_pages(F.col("id"), "2-3,9", 9)).count() == 3
    for bad in ("3-1", "0", "10", ",", "a", "1-2-3"):
        with pytest.raises(ValueError):
            documents.page_ranges(bad, 9)


def test_overrides_merge_in_place(spark, rows):
    o = spark.createDataFrame([(1, "a", 1, None), (2, None, None, 5), (3, "a", None, 2), (4, "a", 7, None), (5, None, 3, None)], "ord int, unit_id string, x int, y int")
    assert rows(documents.merged_overrides(o, "ord", ["x", "y"]).select("ord", "unit_id", "x", "y")) == [(1, "a", 7, 2), (2, None, None, 5), (5, None, 3, None)]
    assert documents.merged_overrides(o.limit(0), "ord", ["x", "y"]).count() == 0


BLOCK = "project_id string, page int, block_id string, kind string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def test_fragments_of_one_block_are_merged(spark):
    b = spark.createDataFrame(
        [
            ("p", 1, "a", "code", "x = 1", (10.0, 10.0, 50.0, 20.0)),
            ("p", 1, "b", "code", "y = 2", (12.0, 25.0, 60.0, 35.0)),
            ("p", 1, "c", "code", "z = 3", (12.0, 60.0, 60.0, 70.0)),
            ("p", 1, "d", "caption", "Box 1", (10.0, 80.0, 60.0, 90.0)),
            ("p", 1, "e", "paragraph", None, (10.0, 95.0, 60.0, 99.0)),
            ("p", 1, "f", "paragraph", "far", (10.0, 120.0, 60.0, 130.0)),
        ],
        BLOCK,
    )
    got = {r["first_block"]: (r["parts"], r["text"]) for r in fragments.merged(b).collect()}
    assert got["a"] == (2, "x = 1\ny = 2") and got["c"][0] == 1 and len(got) == 5
    assert [tuple(r) for r in fragments.caption_bodies(b).collect()] == [("d", "e")]
    lines = spark.createDataFrame([("b", 1, "if x:", 10.0, 35.0), ("b", 2, "y()", 30.0, 45.0), ("b", 3, "", 10.0, 10.0)], "block_id string, no int, text string, x0 double, x1 double")
    assert fragments.indented(lines).first()["text"] == "if x:\n    y()"


def test_overrides_apply_in_order(spark):
    u = spark.createDataFrame([("p", "u1", 1, "note", "a", (0.0, 0.0, 10.0, 10.0)), ("p", "u2", 1, "code", "b", (0.0, 20.0, 10.0, 30.0)), ("p", "u3", 2, "code", "Z", (0.0, 20.0, 10.0, 30.0))], "project_id string, unit_id string, page int, kind string, source_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    rows_ = [
        ("p", 1, "u1", None, None, None, None, False, "paragraph"),
        ("p", 2, "u1", None, None, None, None, False, "list_item"),
        ("p", 3, None, 1, (0.0, 21.0, 10.0, 30.0), None, None, True, None),
        ("p", 4, None, None, None, "code", "^Z", False, "equation"),
    ]
    patches = spark.createDataFrame(rows_, "project_id string, ord int, unit_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, current_kind string, text_regex string, ignore boolean, kind string")
    out = overrides.apply(u, patches)
    assert {r["unit_id"]: r["kind"] for r in out.collect()} == {"u1": "list_item", "u3": "equation"}
    effects = {r["unit_id"]: r["effect"] for r in overrides.stale_records(u, out, ["kind"]).collect()}
    assert effects == {"u1": "invalidated", "u2": "removed", "u3": "invalidated"}


def test_chains_end_at_their_roots(spark):
    runs = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "gone"), ("y", "z"), ("z", "y")] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    got = {r["k"]: (r["root"], r["depth"]) for r in lineage.roots(spark.createDataFrame(runs, "k string, p string"), "k", "p").collect()}
    assert got["d"] == ("a", 3) and got["a"] == ("a", 0) and got["n39"] == ("n0", 39)
    assert got["x"] == ("gone", 1) and got["y"] == got["z"] == ("y", -1)


def test_receipts_recall_and_medians(spark, rows):
    cur = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "page int, fp string")
    rec = spark.createDataFrame([(1, "f1", True), (2, "old", True), (3, "f3", False)], "page int, fp string, passed boolean")
    assert rows(lineage.to_recompute(cur, rec, ["page"], "fp")) == [(2, "f2"), (3, "f3")]
    gold = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, severity string")
    found = spark.createDataFrame([("a",), ("a",)], "id string")
    assert rows(lineage.recall(gold, found, ["id"], "severity")) == [("x", 2, 1), ("y", 1, 0)]
    m = spark.createDataFrame([("g", "l", 10.0), ("g", "l", 20.0), ("g", "o", 12.0)], "g string, v string, x double")
    assert rows(lineage.reductions(m, "g", "v", "x", "l", "o")) == [("g", 15.0, 12.0, pytest.approx(0.2))]


def test_block_classes(spark):
    s = "text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, size double, fonts array<string>, code boolean, outline double"
    box = (72.0, 100.0, 400.0, 130.0)
    data = [
        ("Figure 2-1 A box", box, 10.0, ["Serif"], False, 0.0),
        ("Note: take care", box, 10.0, ["Serif"], False, 0.0),
        ("x = 1", box, 10.0, ["Courier"], False, 0.0),
        ("1 See the other book", (72.0, 700.0, 400.0, 712.0), 7.0, ["Serif"], False, 0.0),
        ("a = b + c", (250.0, 100.0, 350.0, 120.0), 10.0, ["Serif"], False, 0.0),
        ("- an entry", box, 10.0, ["Serif"], False, 0.0),
        ("The first part", box, 14.0, ["Serif"], False, 0.0),
        ("A known title", box, 10.0, ["Serif"], False, 95.0),
        ("Plain words that say something.", box, 10.0, ["Serif"], False, 0.0),
    ]
    d = spark.createDataFrame(data, s)
    c = C.block_class(F.col("text"), F.col("bbox"), F.lit(600.0), F.lit(800.0), F.col("size"), F.lit(10.0), F.col("fonts"), F.col("code"), F.col("outline"))
    assert [r[0]["kind"] for r in d.select(c).collect()] == ["caption", "note", "code", "footnote", "equation", "list_item", "heading", "heading", "paragraph"]


def test_regions_outlines_and_contexts(spark, rows):
    b = spark.createDataFrame([("p", 1, 1, "a", "paragraph", (0.0, 0.0, 10.0, 10.0)), ("p", 1, 2, "f", "figure", (0.0, 0.0, 10.0, 8.0)), ("p", 1, 3, "c", "caption", (0.0, 12.0, 10.0, 14.0)), ("p", 1, 4, "d", "caption", (0.0, 20.0, 10.0, 24.0))], "project_id string, page int, ord int, block_id string, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert {r["block_id"] for r in layout.outside(b.where("kind <> 'figure'"), b.where("kind = 'figure'")).collect()} == {"c", "d"}
    assert rows(layout.caption_regions(b)) == [("f", "c")]
    o = spark.createDataFrame([("p", 2, 3, "B"), ("p", 1, 3, "A"), ("p", 3, 0, "no page")], "project_id string, ord int, page int, title string")
    assert rows(layout.outline(o)) == [("p", 3, ["A", "B"])]
    u = linear(spark, 5, u2={"side": "s"}, u4={"side": "s"})
    pages = spark.createDataFrame([("p", 2)], "project_id string, page int")
    assert ids(layout.context_units(u, pages)) == [2, 3, 4]


def test_only_one_fenced_object_is_taken():
    assert documents.only_fenced_json('Here:\n```json\n{"a": 1}\n```\ndone {x}') == {"a": 1}
    for bad in ('{"a": 1}', '```json\n[1]\n```', '```json\n{"a": 1}\n```\n{"b": 2}', "```json\n{}\n```\n```json\n{}\n```", "```xml\n{}\n```"):
        with pytest.raises(ValueError):
            documents.only_fenced_json(bad)
