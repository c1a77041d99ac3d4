"""The text operators on small fixtures: cases, brute force, nulls, ties, repeats, empty tables."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm import align, cutoff, leak, lookalike, markup, mix, pairs, queries, scan
from inkweave.llm.sentences import sentence_ends, sentences, split_table


# -- look-alikes


def members(spark, rows):
    return spark.createDataFrame([(f, u, t, "clash", "clash") for f, u, t in rows], "field string, unit_id string, text string, h string, k string")


def test_alike_pairs(spark, rows):
    data = [
        ("source_text", "u1", "The parallel caf\u00e9"),
        ("source_text", "u2", "The p\u0430rallel caf\u00e9"),
        ("source_text", "u3", "The\u00a0parallel cafe\u0301"),
        ("source_text", "u4", "The parallel cafe"),
        ("source_text", "u5", "the parallel caf\u00e9"),
        ("target_text", "u1", "x\u00b2"),
        ("target_text", "u2", "x2"),
        ("source_text", "u6", None),
        ("source_text", "u7", "\u2014"),
        ("source_text", "u8", "-"),
        ("source_text", "u1", "The parallel caf\u00e9"),
    ]
    got = rows(lookalike.alike_pairs(members(spark, data)))
    assert got == [("source_text", "u1", "u2"), ("source_text", "u1", "u3"), ("source_text", "u2", "u3")]
    assert lookalike.alike_pairs(members(spark, [])).count() == 0


@pytest.mark.parametrize("a, b", [("ﬁne", "fine"), ("ＡＢ", "AB"), ("a\u200bb", "ab"), ("a\u2011b", "a-b"), ("⽣", "生"), ("a\u2009 b", "a b")])
def test_fold_joins(a, b):
    assert lookalike.fold(a) == lookalike.fold(b)


@pytest.mark.parametrize("a, b", [("a–b", "a-b"), ("a-b", "a b"), ("a\nb", "a b"), ("“a”", '"a"'), ("x⁵", "x5"), ("É", "E"), ("A", "a")])
def test_fold_keeps_apart(a, b):
    assert lookalike.fold(a) != lookalike.fold(b)


def test_candidates_follow_the_dominant_script():
    assert lookalike.candidate("p\u0430per") == "paper"
    assert lookalike.candidate("\u0412\u0415") == "BE"
    assert lookalike.candidate("жаp") == "жар"
    assert lookalike.candidate("paper") is None


def test_words_of_a_text_in_their_own_script_stay(spark, rows):
    wasp = "\u043e\u0441\u0430"
    t = spark.createDataFrame([(1, f"{wasp} \u043b\u0435\u0442\u0438\u0442"), (2, f"an {wasp} here"), (3, "oca"), (4, wasp)], "id int, text string")
    assert rows(lookalike.canonical(t, "id", "text")) == [(1, f"{wasp} \u043b\u0435\u0442\u0438\u0442"), (2, "an oca here"), (3, "oca"), (4, "oca")]


def test_classes_give_one_row_a_unit(spark, rows):
    data = [("source_text", f"u{i:03}", "paper" if i % 2 else "p\u0430per") for i in range(60)] + [("source_text", "v", "other"), ("target_text", "u000", "paper")]
    got = rows(lookalike.alike_classes(members(spark, data + data)))
    assert got == [("source_text", f"u{i:03}", "u000", 2, 60) for i in range(60)]
    assert lookalike.alike_pairs(members(spark, data)).count() == 900


def test_repair_needs_the_vocabulary(spark, rows):
    t = spark.createDataFrame([(1, "p\u0430per"), (2, "z\u043erk"), (3, "paper"), (4, None), (5, "")], "id int, text string")
    assert rows(lookalike.canonical(t, "id", "text")) == [(1, "paper"), (2, "z\u043erk"), (3, "paper"), (4, None), (5, "")]


def test_canonical_covers_both_fields_by_one_vocabulary(spark, rows, tmp_path):
    units = [("u1", "a p\u0430per"), ("u2", None)]
    records = [("u1", 1, "paper"), ("u1", 2, "p\u0430per\u00a0x"), ("u1", 2, "p\u0430per\u00a0x"), ("u2", 1, None)]
    spark.createDataFrame(units, "unit_id string, source_text string").write.parquet(f"{tmp_path}/source_units.parquet")
    spark.createDataFrame(records, "unit_id string, revision int, target_text string").write.parquet(f"{tmp_path}/translation_history.parquet")
    got = rows(queries.p1_canonical(spark, str(tmp_path)))
    assert got == sorted([("source_text", "u1", 0, "a paper"), ("source_text", "u2", 0, None), ("target_text", "u1", 1, "paper"), ("target_text", "u1", 2, "paper x"), ("target_text", "u2", 1, None)], key=repr)


# -- markup


@pytest.mark.parametrize(
    "text, field, languages",
    [
        ("<em>a</em> b", "target_text", {"html"}),
        ("a &nbsp; b", "target_text", {"html"}),
        ("List<int> and a < b && b > c", "target_text", set()),
        ("## Head\n\ntext **b**", "source_markdown", {"markdown"}),
        ("(2 * 3 * 4) and snake_case_name", "source_markdown", set()),
        ("a '''b''' [[c|d]]", "source_markdown", {"wiki"}),
        ("{{math|x}}", "latex", {"wiki"}),
        ("\\frac{a}{b}", "latex", set()),
        ("\\emph{a} and $x^2$", "target_text", {"latex"}),
        ("$5 per page, $7 per book", "target_text", set()),
        ("C:\\proof\\new.txt", "target_text", set()),
        ("```xml\n<Grid a='b'>\n</Grid>\n```", "source_markdown", {"markdown"}),
        ("`<b>`", "source_markdown", {"markdown"}),
        ("", "target_text", set()),
    ],
)
def test_containers(text, field, languages):
    assert {language for language, path, score in markup.containers(text, field) if markup.prior(language, path) + markup.WEIGHT * score > 0} == languages


def test_residue_votes_by_host(spark, rows):
    data = [(f"u{i}", "h1", "target_text", "<x-y>a</x-y>" if False else "<note>a</note>") for i in range(30)] + [("v1", "h1", "target_text", "<note>left open"), ("w1", "h2", "target_text", "Stack<note>"), ("n", "h2", "target_text", None)]
    df = spark.createDataFrame(data, "unit_id string, project_id string, field string, text string")
    got = {r["unit_id"] for r in markup.residue(df.unionAll(df), ["unit_id"], "project_id", "field", "text").collect()}
    assert "v1" in got and "w1" not in got and "n" not in got
    assert markup.residue(df.limit(0), ["unit_id"], "project_id", "field", "text").count() == 0


def test_votes_do_not_depend_on_the_number_of_rows(spark):
    for n in (1, 7, 70, 700):
        data = [(f"{t}{i}", "h", "target_text", x) for i in range(n) for t, x in (("i", "an <i>open one"), ("g", "List<int> x"), ("c", "<note>a</note>"))]
        df = spark.createDataFrame(data, "unit_id string, project_id string, field string, text string")
        got = {r["unit_id"] for r in markup.residue(df, ["unit_id"], "project_id", "field", "text").collect()}
        assert got == {f"{t}{i}" for i in range(n) for t in "ic"}


def test_any_language_s_paths_can_lose(spark):
    data = [(f"a{i}", "code", "target_text", t) for i, t in enumerate(("n = a*b*c", "x = m[[0, 1]]", "Hello {{ user.name }}", "Stack<p> of"))]
    data += [("b0", "text", "target_text", "so *it* is [[Box|box]] and <p>this {{cite|x}}"), ("b1", "text", "target_text", None)]
    df = spark.createDataFrame(data, "unit_id string, project_id string, field string, text string")
    got = {(r["unit_id"], r["markup"]) for r in markup.residue(df, ["unit_id"], "project_id", "field", "text").collect()}
    assert got == {("b0", "markdown"), ("b0", "wiki"), ("b0", "html")}
    clean = {r["unit_id"]: r["clean_text"] for r in markup.extract(df, ["unit_id"], "project_id", "field", "text").collect()}
    assert clean == {"a0": "n = a*b*c", "a1": "x = m[[0, 1]]", "a2": "Hello {{ user.name }}", "a3": "Stack<p> of", "b0": "so it is box and\nthis", "b1": None}


def test_extraction_by_salted_join_is_the_same(spark, rows, monkeypatch):
    data = [(f"u{i}", f"h{i % 3}" if i % 5 else None, "target_text", f"<note>{i}</note> **b** <x-y> &amp; List<int>") for i in range(40)]
    df = spark.createDataFrame(data, "unit_id string, project_id string, field string, text string")
    one = rows(markup.extract(df, ["unit_id"], "project_id", "field", "text"))
    monkeypatch.setattr(markup, "BROADCAST_PATHS", 0)
    assert rows(markup.extract(df, ["unit_id"], "project_id", "field", "text")) == one


def test_lost_paths_stay():
    assert markup.clean("a List<p> b <li>c <div> **d** [[e]]", frozenset()) == "a List<p> b <li>c <div> **d** [[e]]"
    assert markup.clean("a <p>b **d** [[e]]", frozenset({("wiki", "link")})) == "a <p>b **d** e"


def test_clean_keeps_structure():
    text = "<h2>Head</h2>\n<ul><li>one</li><li>two</li></ul> {\\it x} \\cite{k} '''b''' [[a|c]] $x<y$\n```\n<b>\n```"
    out = markup.clean(text)
    assert "## Head" in out and "- one" in out and "- two" in out and "$x<y$" in out and "<b>" in out and "'''" not in out and "\\cite" not in out and " x " in out
    assert markup.clean(None) is None and markup.clean("") == "" and markup.clean("plain < text") == "plain < text"


# -- sentences


@pytest.mark.parametrize(
    "text, parts",
    [
        ("A is by Dr. M. L. Fox. It is 3.5 mm. See Fig. 2 and No. 5.", ["A is by Dr. M. L. Fox.", "It is 3.5 mm.", "See Fig. 2 and No. 5."]),
        ('X noted: "It is. It is not." Next one?! "Is it? No!" asked Y.', ['X noted: "It is. It is not."', "Next one?!", '"Is it? No!" asked Y.']),
        ("It waits until 10 a.m. Why? The labels, etc. because of it ... or so. mGrid is.", ["It waits until 10 a.m.", "Why?", "The labels, etc. because of it ... or so.", "mGrid is."]),
        ("他说：“是的。不是。”“真的吗？”Zolo Kane 问道。完（真的吗？）。", ["他说：“是的。不是。”", "“真的吗？”Zolo Kane 问道。", "完（真的吗？）。"]),
        ("彼は「そうだ。違う。」と述べた。次。", ["彼は「そうだ。違う。」と述べた。", "次。"]),
        ("यह है। डॉ. A. Fox ने कहा: “हाँ। नहीं।” क्या?", ["यह है।", "डॉ. A. Fox ने कहा: “हाँ। नहीं।”", "क्या?"]),
        ("Er kam am 10. Juli z. B. um 3. Dann ging er.Sobald es war.", ["Er kam am 10. Juli z. B. um 3.", "Dann ging er.", "Sobald es war."]),
        ("ระบบเก็บดัชนี Orkane Wenleกล่าวว่าระบบเร็ว ผ่านGrid.Flush", ["ระบบเก็บดัชนี", "Orkane Wenleกล่าวว่าระบบเร็ว", "ผ่านGrid.Flush"]),
        ("", []),
        ("   ", []),
    ],
)
def test_sentences(text, parts):
    assert sentences(text) == parts


@pytest.mark.parametrize(
    "text, lang, parts",
    [
        ("\u054d\u0561 \u0574\u0565\u056f \u0567\u0589 \u0535\u057c\u056f\u0578\u0582\u057d\u0589", "hy", 2),
        ("\u12ed\u1205 \u12a0\u1295\u12f5\u1362 \u1201\u1208\u1275\u1362", "am", 2),
        ("\u1793\u17c1\u17c7\u17d4 \u1796\u17b8\u179a\u17d4", "km", 2),
        ("\u0647\u0644\u061f \u0646\u0639\u0645. \u0646\u0635\u06d4", "ar", 3),
        ("\u0391\u03c5\u03c4\u03cc \u03b5\u03af\u03bd\u03b1\u03b9. \u039a\u03b1\u03b9 \u03b1\u03c5\u03c4\u03cc.", "el", 2),
        ("It is on the tab. The next one is not.", "en", 2),
        ("Es steht in Tab. Zwei und ca. Drei davon.", "de", 1),
        ("It is in (" + "a " * 400 + "b. c) here. Done.", "en", 2),
    ],
)
def test_sentences_of_all_scripts(text, lang, parts):
    assert len(sentences(text, lang)) == parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.!? \n\"“”。（）1é", max_size=60))
def test_sentence_ends_are_ordered_and_inside(text):
    ends = sentence_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) for e in ends)


def test_split_table(spark, rows):
    d = spark.createDataFrame([("u", "A box. C dog.", "en", 1), ("n", None, "en", 1), ("e", " ", None, 1)], "unit_id string, text string, lang string, sentence_no int")
    assert rows(split_table(d, ["unit_id"], "text", "lang")) == [("u", 1, 6), ("u", 2, 13)]


# -- alignment


def brute_assign(score, null):
    n, m = len(score), len(score[0])
    best = None
    for cols in itertools.product(range(-1, m), repeat=n):
        used = [c for c in cols if c >= 0]
        if len(used) == len(set(used)):
            value = sum(score[i][c] if c >= 0 else null for i, c in enumerate(cols))
            if best is None or value > best:
                best = value
    return best


def test_assignment_is_optimal():
    rnd = random.Random(3)
    for _ in range(60):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        score = [[rnd.random() for _ in range(m)] for _ in range(n)]
        got = align.assign(score, 0.3)
        used = [c for c in got if c >= 0]
        assert len(used) == len(set(used))
        assert sum(score[i][c] if c >= 0 else 0.3 for i, c in enumerate(got)) == pytest.approx(brute_assign(score, 0.3))


def test_alignment_learns_its_lexicon(spark):
    rnd = random.Random(5)
    words = [(f"{a}{b}a", f"{b}{a}ov") for a in "bdfgklmnprst" for b in "aeiou"]
    units, truth = [], set()
    for i in range(400):
        picked = [[rnd.choice(words) for _ in range(5)] for _ in range(3)]
        order = [0, 1, 2]
        if i % 4 == 0:
            order = [1, 0, 2]
        if i % 7 == 0:
            order = order[:2]
        source = " ".join("".join(w for w in (" ".join(s for s, _ in p))).capitalize() + "." for p in picked)
        target = " ".join(" ".join(t for _, t in picked[k]).capitalize() + "." for k in order)
        units.append((f"u{i}", "x>y", source, target))
        truth |= {(f"u{i}", k + 1, j + 1) for j, k in enumerate(order)}
    units += [("none", "x>y", None, "Aba."), ("blank", "x>y", "Aba.", " ")]
    df = spark.createDataFrame(units, "unit_id string, pair string, source_text string, target_text string")
    got = {tuple(r) for r in align.align(df, "unit_id").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)


def test_alignment_by_joined_slices_is_the_same(spark, monkeypatch):
    rows_ = [(f"u{i}", "x>y", f"Alpha{i % 5} beta. Gamma delta{i % 3}.", f"Ahpla{i % 5} ateb. Ammag atled{i % 3}.") for i in range(80)]
    df = spark.createDataFrame(rows_, "unit_id string, pair string, source_text string, target_text string")
    a = {tuple(r) for r in align.align(df, "unit_id").collect()}
    monkeypatch.setattr(align, "BROADCAST_ENTRIES", 0)
    assert {tuple(r) for r in align.align(df, "unit_id").collect()} == a


def thin_units():
    rnd = random.Random(7)
    words = [(f"{a}{b}a", f"{b}{a}ov") for a in "bdfgklmnprst" for b in "aeiou"]
    units = []
    for i in range(120):
        picked = [[rnd.choice(words) for _ in range(5)] for _ in range(2)]
        lines = [" ".join(t for _, t in p) for p in picked[:: -1 if i % 3 else 1]]
        units.append((f"u{i}", "x>y", " ".join("it " * (i % 5 < 4) + " ".join(s for s, _ in p) + "." for p in picked).title(), " ".join("ti " * (i % 5 < 4) + x + "." for x in lines).title()))
    return units


def test_lexicon_counts_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(thin_units(), "unit_id string, pair string, source_text string, target_text string")
    one, many = (rows(align.cooccurrence(df.repartition(n, "unit_id"))) for n in (1, 100))
    assert one == many and any(s and t for _, s, t, _ in one)
    assert rows(align.lexicon(df.repartition(100, "unit_id")).select("pair", "s", "t")) == rows(align.lexicon(df.repartition(1)).select("pair", "s", "t"))


def test_slices_hold_the_whole_lexicon_s_weights(spark, monkeypatch):
    df = spark.createDataFrame(thin_units(), "unit_id string, pair string, source_text string, target_text string").repartition(2)
    seen = []
    for limit in (400_000, 0):
        monkeypatch.setattr(align, "BROADCAST_ENTRIES", limit)
        seen.append({tuple(r) for r in align.align(df, "unit_id").collect()})
    assert seen[0] == seen[1] and seen[0]


# -- pairs


@pytest.mark.parametrize(
    "source, target, doubts, language, kind, expected",
    [
        ("The box is open.", None, None, "zh-CN", "paragraph", "empty"),
        ("The box is open.", "TODO", [], "zh-CN", "paragraph", "empty"),
        ("The box is open.", "\u200b", ["request refused on policy grounds, see x"], "zh-CN", "paragraph", "refusal"),
        ("The box is open.", "抱歉，我无法翻译这段内容，请联系作者。", [], "zh-CN", "paragraph", "refusal"),
        ("The server refuses it.", "服务器拒绝该请求，并报告无法继续。", [], "zh-CN", "paragraph", None),
        ("Every local box reads its open record because it is fast.", "every local box reads its open record because it is fast.", [], "zh-CN", "paragraph", "copy"),
        ("GridFlush 8.7", "GridFlush 8.7", [], "zh-CN", "list_item", None),
        ("The box is open.", "箱子是", [], "zh-CN", "paragraph", "truncated"),
        ("The box is open and the lid is closed.", "設定時には、箱は開いている。", [], "zh-CN", "paragraph", "language"),
        ("The box is open.", "箱子是开的。", ["is box the intended unit?"], "zh-CN", "paragraph", None),
        (None, "箱子是开的。", None, None, None, None),
    ],
)
def test_defects(source, target, doubts, language, kind, expected):
    assert pairs.defect(source, target, doubts, language, kind) == expected


# The pieces were mended with these in view.
REFUSALS = [
    "Sorry, but I'm not able to translate content of this kind.",
    "I will not translate this. Please choose another passage, and note that the guidelines forbid it in every form.",
    "Unfortunately I am unable to assist with the passage you sent.",
    "As an AI assistant, I can't provide a translation here.",
    "I'm sorry. I cannot comply with this request.",
    "Es tut mir leid, aber ich kann Ihnen bei dieser Anfrage nicht weiterhelfen.",
    "Leider kann ich diesen Text nicht übersetzen.",
    "Ich darf nicht bei dieser Aufgabe helfen.",
    "Désolé, je ne peux pas traduire ce passage.",
    "Lo siento, no puedo ayudarte con esta solicitud.",
    "Mi dispiace, non posso tradurre questo testo.",
    "很抱歉，我没有办法完成这段文字的翻译，因为其中的内容超出了我可以处理的范围，如果您还有别的段落需要处理，请把它们另行发送给我，我会尽力协助您完成剩下的部分，谢谢您的理解与配合，祝您工作顺利。",
    "对不起，我不能提供该段的译文。",
    "作为一个人工智能助手，我无法协助完成此请求。",
    "申し訳ございませんが、この内容の翻訳はお断りいたします。ほかの文章をお送りいただければ対応いたしますので、どうぞよろしくお願い申し上げます。",
    "恐れ入りますが、ご依頼の翻訳は致しかねます。",
    "खेद है, मैं इस पाठ का अनुवाद नहीं कर सकती।",
    "ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้",
]
# Written after the pieces were fixed and never used to change them.
HELD_OUT_REFUSALS = [
    "Unfortunately, I can't assist with translating this section, since it violates my guidelines.",
    "I am sorry, I will not provide the requested translation.",
    "I apologize, but I am not able to fulfill this request.",
    "I must decline to translate this.",
    "Leider darf ich diese Anfrage nicht bearbeiten, da der Inhalt geschützt ist.",
    "Ich lehne die Übersetzung dieses Abschnitts ab.",
    "Malheureusement, je ne suis pas en mesure de traduire ce texte.",
    "抱歉，这段内容我不能翻译。",
    "很遗憾，我拒绝处理这个请求。",
    "恕我无法提供译文。",
    "残念ながら、このリクエストにはお応えできません。",
    "申し訳ありませんが、翻訳できません。",
    "क्षमा करें, मैं इसमें मदद नहीं कर सकता।",
    "ขอโทษ ฉันขอปฏิเสธคำขอนี้",
]
ORDINARY = [
    "The server cannot help with this request, because the filter is full.", "He said: I cannot translate this passage.", "Der Server kann diese Anfrage nicht bearbeiten.", "系统无法处理该文本。", "服务器拒绝该请求。",
    "この関数は文章を翻訳できません。", "If the cache is full, I cannot help, said Fox of the request.", "Every request is translated.",
]


def test_held_out_refusals():
    for texts in (REFUSALS, HELD_OUT_REFUSALS):
        found = [r for r in texts if pairs.is_refusal(r)]
        assert len(found) >= 0.9 * len(texts), set(texts) - set(found)
    assert [o for o in ORDINARY if pairs.is_refusal(o)] == []


@pytest.mark.parametrize(
    "target, language",
    [("Le serveur est dans la boîte et il ne lit pas les textes avec ce filtre.", "de"), ("El servidor no lee los textos con este filtro porque son de la red.", "en-US"), ("Сервер читает тексты из памяти каждый день.", "zh-CN"), ("서버는 매일 기억에서 글을 읽는다.", "ja")],
)
def test_other_languages(target, language):
    assert pairs.defect("The server reads its texts from memory.", target, [], language, "paragraph") == "language"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.lcs(a, b) == table[-1][-1]


# -- leaks


def test_leaks(spark, rows):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(50)) for i in range(20)]
    docs, truth = [], set()
    for d in range(120):
        body = say(120)
        if d % 3 == 0:
            i = d % 20
            w = items[i][1].split()
            part = w[:32]
            if d % 2:
                part[7] = "changed"
                part[20] = "changed"
            body = body + "\n**" + ", ".join(part).upper() + "**\n" + say(40)
            truth.add((d, i))
        if d % 3 == 1:
            body += " " + " ".join(items[d % 20][1].split()[:14])
        docs.append((d, body, "clash"))
    docs += [(1000, None, ""), (1001, "", "")]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame(items + [(99, None), (98, "")], "item_id bigint, text string")
    got = {tuple(r) for r in leak.leaks(dd.unionAll(dd), ii).collect()}
    assert got == truth
    assert leak.leaks(dd, ii.limit(0)).count() == 0


# -- scans


def test_scan_noise(spark):
    clean = "The external window controls the visible renderer near the margin of every page"
    data = [(f"c{i}", "p", 900 + i, "paragraph", clean + ".\nIt is a two-step plan.", None, None) for i in range(30)]
    data += [
        ("h1", "p", 1, "paragraph", "The visible ren-\nderer is near.", None, None),
        ("h2", "p", 1, "paragraph", "It is a two-\nstep plan.", None, None),
        ("m1", "p", 2, "paragraph", "The externa1 window.", None, None),
        ("m2", "p", 2, "paragraph", "The wind|ow is near.", None, None),
        ("n1", "p", 33, "paragraph", "The window\n- 33 -\nis near.", None, None),
        ("n2", "p", 33, "paragraph", "The window\n33 | Chapter 4\nis near.", None, None),
        ("n3", "p", 33, "paragraph", "The window is near the page\n[32].", None, None),
        ("k1", "p", 34, "paragraph", "Local Window and Margin", 30.0, 800.0),
        ("k2", "p", 35, "heading", "Local Window and Margin", 80.0, 800.0),
        ("e1", "p", 36, "paragraph", None, None, None),
        ("e2", "p", None, "paragraph", "", None, None),
        ("x1", "p", 37, "code", "externa1 = 1\n37", None, None),
    ]
    df = spark.createDataFrame(data, "record_id string, project_id string, page int, kind string, text string, y0 double, height double")
    got = {tuple(r) for r in scan.found(df.unionAll(df)).collect()}
    assert got == {("h1", "hyphenation"), ("m1", "misread"), ("m2", "misread"), ("n1", "page_number"), ("n2", "page_number"), ("n2", "header"), ("k1", "header")}
    text = {r["record_id"]: r["text"] for r in scan.reflow(df).collect()}
    assert text["h1"] == "The visible renderer is near." and text["n1"] == "The window is near." and "e1" not in text


def scanned_pages(spark):
    clean = "The visible renderer holds the window near the external margin"
    data = [(f"c{i}", "p", 900 + i, "paragraph", clean + ".\nIt is a two-step plan.\n\u56fd\u5916\u6570\u636e\u3002", None, None) for i in range(30)]
    data += [
        ("h1", "p", 1, "paragraph", "The visible ren-\nderer is near.", None, None),
        ("h2", "p", 1, "paragraph", "It is a two-\nstep plan.", None, None),
        ("m1", "p", 2, "paragraph", "The externa1 window.", None, None),
        ("n2", "p", 33, "paragraph", "The visible ren-\n33 | Chapter 4\nderer is near.", None, None),
        ("k1", "p", 34, "paragraph", "Local Window and Margin", 30.0, 800.0),
        ("k2", "p", 35, "heading", "Local Window and Margin", 80.0, 800.0),
        ("z1", "p", 36, "paragraph", "\u56fd\u5904\n\u6570\u636e\u3002", None, None),
        ("e1", "p", 36, "paragraph", None, None, None),
        ("x1", "p", 37, "code", "externa1 = 1", None, None),
    ]
    return spark.createDataFrame(data, "record_id string, project_id string, page int, kind string, text string, y0 double, height double")


@pytest.mark.parametrize("limit", [200_000, 0])
def test_strays_are_found_with_any_number_of_forms(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "BROADCAST_FORMS", limit)
    data = [("s1", "p", 1, "paragraph", "An unseen wor|d here.", None, None), ("s2", "p", 1, "paragraph", "An unseen word here.", None, None)]
    df = spark.createDataFrame(data, "record_id string, project_id string, page int, kind string, text string, y0 double, height double")
    assert {tuple(r) for r in scan.found(df).collect()} == {("s1", "misread")}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_ideographs_are_found_with_any_number_of_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "BROADCAST_PAIRS", limit)
    got = {tuple(r) for r in scan.found(scanned_pages(spark)).collect()}
    assert got == {("h1", "hyphenation"), ("m1", "misread"), ("n2", "header"), ("n2", "page_number"), ("k1", "header"), ("z1", "misread")}


COLUMNS = "record_id string, project_id string, page int, kind string, text string, y0 double, height double"


def test_page_numbers_of_any_length(spark):
    n = 1_234_567
    for line in (f"{n}", f"Page {n}", f"- {n} -", f"[{n}]", f"第 {n} 页"):
        assert scan.furniture(line, n)[0] and not scan.furniture(line, n + 1)[0]
    assert scan.furniture(f"{n} | Chapter 4", n)[2] and scan.furniture(f"Local Window and Margin {n}", n) == (False, "\x01local window and margin", True)
    df = spark.createDataFrame([("n1", "p", n, "paragraph", f"The window\n{n}\nis near.", None, None), ("n2", "p", n, "paragraph", f"The window\n{n} | Chapter 4\nis near.", None, None)], COLUMNS)
    assert {tuple(r) for r in scan.found(df).collect()} == {("n1", "page_number"), ("n2", "page_number"), ("n2", "header")}
    assert {r["text"] for r in scan.reflow(df.where("record_id = 'n1'")).collect()} == {"The window is near."}


def test_heads_by_title_margin_or_own_number(spark):
    data = [
        ("t1", "p", 1, "heading", "可见的消息与方程", 100.0, 800.0),
        ("t2", "p", 1, "heading", "Größen des Gitters", 100.0, 800.0),
        ("a1", "p", 7, "paragraph", "可见的消息与方程 7", 30.0, 800.0),
        ("a2", "p", 8, "paragraph", "The window\n可见的消息与方程\nis near.", None, None),
        ("a3", "p", 9, "paragraph", "GRÖSSEN DES GITTERS", 30.0, 800.0),
        ("a4", "q", 9, "paragraph", "可见的消息与方程", 30.0, 800.0),
        ("m1", "p", 10, "paragraph", "Proceedings", 30.0, 800.0),
        ("m2", "p", 11, "paragraph", "Proceedings", 30.0, 800.0),
        ("o1", "p", 12, "paragraph", "The window\nAnnals 12\nis near.", None, None),
        ("o2", "p", 13, "paragraph", "The window\n13 | Annals\nis near.", None, None),
        ("w1", "p", 14, "paragraph", "In other words the\nwindow is near.", None, None),
        ("w2", "p", 15, "paragraph", "In other words the\nmargin is near.", None, None),
    ]
    got = {tuple(r) for r in scan.found(spark.createDataFrame(data, COLUMNS)).collect()}
    assert got == {*((k, "header") for k in ("a1", "a2", "a3", "m1", "m2", "o1", "o2")), *((k, "page_number") for k in ("a1", "o1", "o2"))}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_misread_words_and_ideographs_at_breaks_with_any_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "BROADCAST_FORMS", limit)
    monkeypatch.setattr(scan, "BROADCAST_PAIRS", limit)
    data = [("m1", "p", 1, "paragraph", "The win-\ndow-\nexterna1 margin.", None, None), ("z1", "p", 2, "paragraph", "国处-\n数据。", None, None)]
    df = scanned_pages(spark).where("record_id like 'c%'").unionAll(spark.createDataFrame(data, COLUMNS))
    assert {tuple(r) for r in scan.found(df).where("noise = 'misread'").collect()} == {("m1", "misread"), ("z1", "misread")}


def test_roman_page_numbers():
    assert scan.furniture("mcdxliv", 1444)[0] and scan.furniture("xiv", 14)[0] and not scan.furniture("xiv", 15)[0]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_reflow_repairs_what_is_found(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "BROADCAST_FORMS", limit)
    monkeypatch.setattr(scan, "BROADCAST_PAIRS", limit)
    df = scanned_pages(spark)
    text = {r["record_id"]: r["text"] for r in scan.reflow(scan.repaired(df.unionAll(df))).collect()}
    assert text["h1"] == "The visible renderer is near." and text["h2"] == "It is a two-step plan."
    assert text["m1"] == "The external window." and text["n2"] == "The visible renderer is near."
    assert "k1" not in text and text["k2"] == "Local Window and Margin" and "e1" not in text
    assert text["z1"] == "\u56fd\u5916\u6570\u636e\u3002" and text["x1"] == "externa1 = 1"


# -- mixing


def test_mixture_reaches_its_shares(spark):
    rnd = random.Random(4)
    docs = [(i, s, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(20, 60))) + f" {i}") for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 40)]
    docs += [(5000, "a", docs[0][2]), (5001, None, "left out"), (5002, "a", None), (5003, "a", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in mix.report(d, t).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(r[s]["reached_share"] - share) < 0.01
    assert r["a"]["most_repeats"] == 1 and r["c"]["most_repeats"] <= 4
    m = mix.mixture(d, t).collect()
    assert len({x["doc_id"] for x in m}) == len(m) and 5000 not in {x["doc_id"] for x in m}
    assert sorted(m) == sorted(mix.mixture(d, t).collect())
    assert mix.mixture(d.limit(0), t).count() == 0


def test_texts_that_are_certain_leave_their_share_to_the_others(spark):
    sizes = [(i, "a", 1 + (i % 40 == 0) * 400 + i % 7) for i in range(2000)]
    sized = spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint")
    p = spark.createDataFrame([("a", 0.5, 1, 1, 1, 0, 0.8 * sum(t for _, _, t in sizes))], "source string, share double, repeats int, have bigint, wanted bigint, whole int, rest double")
    r = mix._certain(sized, p).first()
    taken = sum(t for _, _, t in sizes if t <= r["certain"])
    expected = taken + sum(t * min(1.0, r["factor"] * t ** -mix.SIZE_POWER) for _, _, t in sizes if t > r["certain"])
    assert r["certain"] > 0 and expected == pytest.approx(r["rest"])
    assert all(r["factor"] * t ** -mix.SIZE_POWER < 1 for _, _, t in sizes if t > r["certain"])


def test_token_counts_of_long_texts(spark):
    d = spark.createDataFrame([(1, "word " * 100_000), (2, None), (3, ""), (4, "a" * 300_000), (5, "a b" + " " * 400_000 + "c\n" * 3), (6, "a b" + " " * 999 + "c"), (7, "a b" + " " * 1000 + "c")], "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in mix.token_counts(d, ["doc_id"], "text").collect()}
    assert got[2] == got[3] == 0 and abs(got[1] - 100_000) < 10 and got[4] > 0 and got[5] > 0 and abs(got[6] - got[7]) < 20


# -- cut-offs


def test_cut_offs_on_held_out_texts(spark):
    rnd = random.Random(9)
    nouns = ["record", "window", "filter", "buffer", "margin"]
    say = lambda: f"The {rnd.choice(nouns)} reads the {rnd.choice(nouns)} near the {rnd.choice(nouns)}."
    whole = [" ".join(say() for _ in range(rnd.randint(3, 8))) + rnd.choice(["", "", "\n\n- Fast box\n- Old box", "\n\nAnd so it goes on...", "\n\nhttps://a.example/x"]) for _ in range(700)]
    docs = [(i, "s", t, False) for i, t in enumerate(whole)]
    for i in range(150):
        t = " ".join(say() for _ in range(6))
        docs.append((10_000 + i, "s", t[: rnd.randint(120, len(t) - 3)].rstrip(". ") + rnd.choice(["", "...", "…"]), True))
    docs += [(20_000, None, None, False), (20_001, "s", "", False), (20_002, "s", "ระบบเก็บดัชนีเร็วและระบบ", False)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, cut boolean")
    found = {r["doc_id"] for r in cutoff.scores(d).where("p_cut > 0.5").collect()}
    truth = {i for i, _, _, c in docs if c}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.05 * len(truth)
    rates = {r["source"]: r for r in cutoff.cut_rates(d).collect()}
    assert rates["s"]["texts"] == 851 and rates["s"]["cut_texts"] == len(found)


def test_all_intact_texts_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(cutoff, "TRAIN_ROWS", 20)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(4)).capitalize() for _ in range(400)]
    d = spark.createDataFrame([(i, "s", f"The record reads {'x' * rnd.randrange(300)} near the window.\n\n{w}") for i, w in enumerate(words)], "doc_id bigint, source string, text string")
    p = [r["p_cut"] for r in cutoff.scores(d.repartition(3)).orderBy("doc_id").collect()]
    # The texts differ in their last word; those that the fit left out would score alike.
    assert max(p) < cutoff.THRESHOLD and max(p.count(x) for x in p) < 20
    assert p == [r["p_cut"] for r in cutoff.scores(d.repartition(7)).orderBy("doc_id").collect()]


def test_language_and_closing_marks_of_whole_texts():
    thai = "ระบบเก็บดัชนีเร็วและระบบ"
    assert not cutoff.is_thai("The record reads the window near the margin of the page. " * 5 + thai * 2)
    assert cutoff.is_thai(thai * 20 + "\n\n| n | ms |\n| 1 | 2.5 |\n| 2 | 3.1 |\n| 3 | 3.1 |\n| 4 | 3.1 |\n| 5 | 3.1 |")
    assert cutoff.closing("The window is near." + ")" * 30)[1] == "True"
    assert cutoff.closing("Contents " + "." * 300 + " 12")[2] == "none"


@given(st.text(st.sampled_from([".", "…", "�", "[", "]", "(", ")", " ", "\n", "a", "”"]), max_size=8), st.sampled_from(["", "more", "(CUT)", "[truncated]", "[...]", "anymore", "gekürzt]"]), st.sampled_from(["", "…", "..", " [...]", ")"]))
def test_markers_are_those_of_the_expression(a, b, c):
    text = (a + b + c).rstrip()
    m = re.search(r"(?:\s*(?:\.{2,}|…+|�+|\[(?:\.\.\.|…)\]|\[?\(?(?:truncated|cut|more|gekürzt)\)?\]?))+\s*$", text, re.I)
    assert cutoff._marked(text) == ((m.start(), m.group().strip()[:1]) if m else (len(text), "none"))


def test_core_does_not_import_the_text_operators():
    import pathlib

    import inkweave

    root = pathlib.Path(inkweave.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "inkweave.llm" not in p.read_text(encoding="utf-8")


def test_registered_queries(spark):
    import __spark_entry__ as e

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
