"""Noise in text from scanned pages: broken words, misread characters, running heads, page numbers.

* Words of the whole corpus are counted and grouped by a skeleton in which confusable glyphs
  fall together; within a group the frequent form that stands in the same contexts wins, and
  the rare forms are misreadings of it.  For ideographs the groups are pairs of look-alike
  characters and the contexts are the neighbouring characters.
* Words broken over a line end are joined where the corpus doesn't know them with a hyphen.
* Lines with masked digits that name one of the project's chapters, or stand in the margin
  or beside the page's own number on several pages, are running heads; a line that holds the
  page's own number is a page number.
* ``reflow`` joins what is left into paragraphs with SQL windows over the lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows

#: Distinct forms that a worker holds before it hands its partial counts on.
HELD_FORMS = 200_000
#: A frequent form must be this many times as common as a misreading of it, and this common.
RATIO, LEAST = 12, 6
#: Largest correction table that is broadcast; a larger one is joined by shuffle.
BROADCAST_FORMS = 200_000
#: Ideograph pairs that are broadcast at most (about 60 bytes each); beyond it contexts are judged by joins.
BROADCAST_PAIRS = 400_000
MARGIN = 0.075

# Glyphs that recognition confuses; sequences first, then single characters.
SEQUENCES = (("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"))
SINGLE = str.maketrans({"1": "l", "i": "l", "I": "l", "!": "l", "0": "o", "c": "e", "5": "s", "b": "h", "f": "t", "y": "v", "@": "a", "9": "g", "q": "g", "6": "h", "8": "h", "2": "z", "|": None, "~": None})
# Ideographs misread for others (read, meant).
IDEOGRAPHS: dict[str, str] = {}
for _read, _meant in map(tuple, (
    "处外 童章 拄控 柱控 圄图 囹图 迮连 苗描 描苗 螫整 鏊整 淯消 淯渲 洛络 台合 泽译 峄译 捡检 险检 炬矩 距矩 涵函 走是 走定 箅算 佶信 佶结 倌信 糸系 "
    "簿薄 孪变 客容 摸模 丈文 桯程 裎程 渎读 木术 木本 清请 晴请 素索 于手 干手 末未 未末 己已 已己 土士 曰日 入人 大太 千干 力刀 刁刀 "
    "住往 侍待 侯候 戌戍 赢羸 徽微 辨辩 折拆 析折 乌鸟 兔免 晴睛 竟竞 具其 且目 夭天 夫失 失矢 史吏 申由 甲申 由田 田由 白自 自目 "
    "闪闭 问间 问向 间问 同问 阅阀 几儿 儿几 九丸 贝见 见贝 今令 令今 冶治 治冶 洒酒 钓钩 徒徙 卷券 暑署 署暑 姑始 殊珠 抱泡 饱饮 饮饱 哲暂 "
    "祥样 详样 仕任 伍任 栈线 浅线 钱线 侍持 特持 恃特 恃持 诗持 壮状 妆状 忧优 犹优 扰优 枕优 怙估 诂估"
).split()):
    IDEOGRAPHS[_read] = IDEOGRAPHS.get(_read, "") + _meant

_BREAK = re.compile(r"([^\W\d_]+[^\W_]*)([-‐­¬])[ \t]*\n[ \t]*([^\W\d_][^\W_]*)")
_MAY_BREAK = re.compile(r"[-‐­¬][ \t]*\n")
_WORD = re.compile(r"(?<![\w.\-@|~])[A-Za-zÀ-ÿ@|~0-9]+(?:-[a-zà-ÿ]+)*(?![\w@|~]|\.\w|-[A-Z\d])")
_LETTERS = re.compile(r"[A-Za-zÀ-ÿ]")
_PAIR_CHARS = "".join(sorted({c for k, v in IDEOGRAPHS.items() for c in k + v}))
_AROUND = re.compile(f"(?=(.?)([{_PAIR_CHARS}])(.?))", re.S)
_MISREAD_CJK = re.compile("[" + "".join(sorted(IDEOGRAPHS)) + "]")
_HAN = re.compile("[㐀-鿿]")
_NEWLINE_CJK = re.compile(r"[ \t]*\n[ \t]*")

_NUMBER_LINE = re.compile(r"(?:(?:Page|Seite|S\.|p\.|第) ?)?(\d+)(?: ?[页頁])?|[-–—] ?(\d+) ?[-–—]|\[(\d+)\]|([ivxlcdm]+)")
_FIRST_NUMBER = re.compile(r"^(\d+) ?[|·–-] ?")
_LAST_NUMBER = re.compile(r"[ |·–-]+(\d+)$")
_CHAPTER = re.compile(r"^(?:chapter|ch\.|kapitel|kap\.|chapitre|अध्याय|บทที่) ?\d+ ?[·:|.–-]? ?|^第 ?\d+ ?章 ?[·:|]? ?", re.I)
_TITLE = re.compile(r"[A-ZÄÖÜÀ-Þ][\w'-]*(?: [A-ZÄÖÜÀ-Þ][\w'-]*)* (?:and|und|or|oder|of|AND|UND) [A-ZÄÖÜÀ-Þ][\w'-]*(?: [A-ZÄÖÜÀ-Þ][\w'-]*)*")
_SENTENCE_END = re.compile(r"[.,;:!?。！？，；：、।]$")


def skeletons(word: str) -> list[str]:
    """Forms in which confusable glyphs fall together: single glyphs alone, with sequences, with one more.

    A sequence that a misreading makes or breaks hides in one of them, so forms meet if any agrees.
    """
    w = word.replace("|", "").replace("~", "").lower()
    out = [w.translate(SINGLE)]
    for sequences in (SEQUENCES, (*SEQUENCES, ("li", "h"))):
        x = w
        for a, b in sequences:
            x = x.replace(a, b)
        x = x.translate(SINGLE)
        for a, b in SEQUENCES:
            x = x.replace(a, b)
        out.append(x)
    return [f"{i}{x}" for i, x in enumerate(out)]


def roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += s * (n // v)
        n %= v
    return out


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(_BREAK.sub(" ", text) if "\n" in text and _MAY_BREAK.search(text) else text) if len(w) > 1 and _LETTERS.search(w)]


def _unbroken(text: str) -> str:
    return _BREAK.sub(r"\1\3", text) if "\n" in text and _MAY_BREAK.search(text) else text


def _ideographs(text: str) -> str:
    return _NEWLINE_CJK.sub("", text) if "\n" in text else text


def counted(records: DataFrame, text: str) -> DataFrame:
    """``kind, form, n`` over all records: words (w), neighbours (p) and ideograph pairs (c)."""

    def run(rows):
        words: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        cjk: Counter[str] = Counter()

        def out():
            for k, n in words.items():
                yield "w", k, n
            for (a, b), n in pairs.items():
                yield "p", f"{a} {b}", n
            for k, n in cjk.items():
                yield "c", k, n
            words.clear(), pairs.clear(), cjk.clear()

        for (t,) in rows:
            found = _words(t)
            words.update(found)
            pairs.update(zip(found, found[1:]))
            if not t.isascii() and _HAN.search(t):
                s = _ideographs(t)
                for m in _AROUND.finditer(s):
                    a, c, b = m.groups()
                    if a:
                        cjk[a + c] += 1
                    if b:
                        cjk[c + b] += 1
            if len(words) + len(pairs) + len(cjk) > HELD_FORMS:
                yield from out()
        yield from out()

    return map_rows(records.where(F.length(text) > 0).select(text), run, "kind string, form string, n bigint").groupBy("kind", "form").agg(F.sum("n").alias("n"))


def corrections(counts: DataFrame) -> DataFrame:
    """``form, meant``: rare forms and the frequent form of their skeleton that shares a context."""

    def run(rows):
        for form, n in rows:
            for s in skeletons(form):
                yield form, n, s

    words = map_rows(counts.where("kind = 'w'").select("form", "n"), run, "form string, n bigint, skeleton string")
    best = words.where(F.col("form").rlike(r"^[A-Za-zÀ-ÿ]+$")).groupBy("skeleton").agg(F.max(F.struct("n", "form")).alias("b")).where(F.col("b.n") >= LEAST)
    rare = words.join(best, "skeleton").where((F.lower("form") != F.lower("b.form")) & (F.col("b.n") >= RATIO * F.col("n"))).where(F.col("form").rlike("[a-zß-ÿ]"))
    rare = rare.select("form", F.col("b.form").alias("meant")).distinct()
    part = F.split("form", " ")
    pairs = counts.where("kind = 'p'").select(part[0].alias("a"), part[1].alias("b"))
    seen_left = pairs.select("a", F.col("b").alias("meant"))
    seen_right = pairs.select(F.col("a").alias("meant"), "b")
    left = pairs.join(rare, pairs.b == rare.form).select("form", "meant", "a").join(seen_left, ["a", "meant"], "left_semi").select("form", "meant")
    right = pairs.join(rare, pairs.a == rare.form).select("form", "meant", "b").join(seen_right, ["b", "meant"], "left_semi").select("form", "meant")
    noisy = rare.where(F.col("form").rlike("[@|~0-9]"))
    return left.unionByName(right).unionByName(noisy).distinct()


def _verdict(a: str, c: str, b: str, pairs) -> str | None:
    """The look-alike that the neighbours support clearly better than the ideograph read."""
    mine = (pairs.get(a + c, 0) if a else 0), (pairs.get(c + b, 0) if b else 0)
    theirs, meant = max(((pairs.get(a + x, 0) if a else 0) + (pairs.get(x + b, 0) if b else 0), x) for x in IDEOGRAPHS[c])
    return meant if theirs >= LEAST and theirs >= 4 * sum(mine) and theirs >= 4 * max(mine) else None


def misread_ideographs(text: str, pairs: dict[str, int], judged: dict[str, str] | None = None) -> dict[int, str]:
    """Positions in ``text`` of ideographs whose look-alike is what the context supports, and the look-alike.

    ``pairs`` are the counts of neighbours; or ``judged`` has the look-alike of every context.
    """
    out = {}
    for m in _MISREAD_CJK.finditer(text):
        i, c = m.start(), m.group()
        a, b = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        meant = _verdict(a, c, b, pairs) if judged is None else judged.get(f"{a}\x01{c}\x01{b}")
        if meant is not None:
            out[i] = meant
    return out


def _pairs_of(counts: DataFrame) -> dict[str, int] | None:
    """The counts of ideograph pairs, or None where they are too many to hold."""
    table = counts.where("kind = 'c'").select("form", "n").limit(BROADCAST_PAIRS + 1).collect()
    return {r["form"]: r["n"] for r in table} if len(table) <= BROADCAST_PAIRS else None


def _judged_contexts(texts: DataFrame, key: str, text: str, counts: DataFrame, whole: Callable[[str], str] = lambda t: t) -> DataFrame:
    """``key, judged``: per record the map of its contexts with a misread ideograph in ``whole(text)`` to the look-alike, by joins."""
    key_type = texts.schema[key].dataType.simpleString()

    def contexts(rows):
        for k, t in rows:
            s = _ideographs(whole(t))
            for x in {(s[m.start() - 1 : m.start()] if m.start() else "", m.group(), s[m.end() : m.end() + 1]) for m in _MISREAD_CJK.finditer(s)}:
                yield (k, *x)

    own = map_rows(texts.where(F.col(text).rlike(_MISREAD_CJK.pattern)).select(key, text), contexts, f"`{key}` {key_type}, a string, c string, b string").persist()

    def asked(rows):
        for a, c, b in rows:
            for x in (c, *IDEOGRAPHS[c]):
                yield a, c, b, x, "l" if a else "-", a + x
                yield a, c, b, x, "r" if b else "-", x + b

    wanted = map_rows(own.select("a", "c", "b").distinct(), asked, "a string, c string, b string, x string, side string, form string").where("side <> '-'")
    table = counts.where("kind = 'c'").select("form", "n")
    seen = wanted.join(table, "form").groupBy("a", "c", "b").agg(F.collect_list(F.struct("form", "n")).alias("seen"))

    def judge(rows):
        for a, c, b, seen in rows:
            meant = _verdict(a, c, b, {x["form"]: x["n"] for x in seen})
            if meant is not None:
                yield a, c, b, meant

    wrong = map_rows(seen, judge, "a string, c string, b string, meant string")
    entry = F.struct(F.concat_ws("\x01", "a", "c", "b").alias("k"), "meant")
    return own.join(wrong, ["a", "c", "b"]).groupBy(key).agg(F.map_from_entries(F.collect_set(entry)).alias("judged"))


def furniture(line: str, page: int | None) -> tuple[bool, str | None, bool]:
    """(is a bare page number, key of a possible running head, the head holds the page number)."""
    s = line.strip()
    m = _NUMBER_LINE.fullmatch(s)
    if m:
        if m.group(4):
            return (page is not None and roman(page) == s), None, False
        return next(g for g in m.groups() if g) == str(page), None, False
    if len(s) <= 2:
        return False, None, False
    own = False
    m = _FIRST_NUMBER.match(s)
    if m:
        own = m.group(1) == str(page)
    rest = s[m.end() :] if m else s
    title = _CHAPTER.sub("", rest)
    chapter = title != rest
    m = _LAST_NUMBER.search(title)
    if m and m.start() > 0:
        own = own or m.group(1) == str(page)
        title = title[: m.start()]
    title = title.strip()
    if not chapter and (_SENTENCE_END.search(s) or s[:1].islower()):
        return False, None, False
    key = re.sub(r"\d+", "#", title).casefold()
    return False, ("\x01" if chapter or _TITLE.fullmatch(title) else "") + key, own


def _marginal(lines: list[str], y0: float | None, height: float | None) -> bool:
    return y0 is not None and bool(height) and (y0 < MARGIN * height or y0 > (1 - MARGIN) * height) and len(lines) == 1


def _head(own: bool, marginal: bool) -> str | None:
    """What speaks for a running head beside its words."""
    return "own" if own else "margin" if marginal else None


def found(records: DataFrame) -> DataFrame:
    """``record_id, noise`` of ``records(record_id, project_id, page, kind, text, y0, height)``.

    Null and empty texts hold no noise; a null page has no page number; repeated rows give one
    row; ``y0`` and ``height`` may be null (then only lines inside a text can be furniture).
    Code, tables and equations hold no broken or misread words.
    """
    base = records.where(F.length("text") > 0).select("record_id", "project_id", "page", "kind", "text", "y0", "height")
    prose = ~F.col("kind").isin("code", "equation", "table")
    counts = counted(base.where(prose), "text").persist()
    fixes = corrections(counts)
    spark = records.sparkSession

    shared = spark.sparkContext.broadcast(_pairs_of(counts))
    table = fixes.limit(BROADCAST_FORMS + 1).collect()
    small = len(table) <= BROADCAST_FORMS
    wrong = spark.sparkContext.broadcast(frozenset(r["form"] for r in table) if small else None)

    def run(rows):
        pairs, forms = shared.value, wrong.value
        for record_id, project, page, kind, text, y0, height in rows:
            prose = kind not in ("code", "equation", "table")
            lines = text.split("\n")
            marginal = _marginal(lines, y0, height)
            if marginal or len(lines) > 1 and prose:
                for line in lines:
                    number, key, own = furniture(line, page)
                    if number:
                        yield record_id, "page_number", None, None, None, page
                    elif key is not None:
                        yield record_id, "head", project, key, _head(own, marginal), page
            if not prose or marginal:
                continue
            broken = len(lines) > 1 and _MAY_BREAK.search(text)
            if broken:
                for m in _BREAK.finditer(text):
                    if m.group(3)[0].islower():
                        a, b = m.group(1), m.group(3)
                        yield record_id, "break", None, a + "-" + b, (a + b) if m.group(2) == "-" else None, page
            whole = _unbroken(text)
            if _stray(whole) or forms is not None and any(w in forms for w in _WORD.findall(whole)):
                yield record_id, "misread", None, None, None, page
                continue
            if forms is None:
                for w in {w for w in _WORD.findall(whole) if len(w) > 1 and _LETTERS.search(w)}:
                    yield record_id, "word", None, w, None, page
            if pairs is not None and _MISREAD_CJK.search(whole) and misread_ideographs(_ideographs(whole), pairs):
                yield record_id, "misread", None, None, None, page

    scanned = map_rows(base, run, "record_id string, noise string, project_id string, a string, b string, page int").persist()
    plain = scanned.where(F.col("noise").isin("page_number", "misread")).select("record_id", "noise")
    if shared.value is None:
        marginal = F.coalesce((F.col("height") != 0) & ((F.col("y0") < MARGIN * F.col("height")) | (F.col("y0") > (1 - MARGIN) * F.col("height"))) & ~F.contains("text", F.lit("\n")), F.lit(False))
        texts = base.where(F.coalesce(prose, F.lit(True)) & ~marginal).select("record_id", "text").distinct()
        plain = plain.unionByName(_judged_contexts(texts, "record_id", "text", counts, _unbroken).select("record_id", F.lit("misread").alias("noise")))
    return plain.unionByName(_breaks(scanned, counts)).unionByName(_heads(scanned, base)).unionByName(
        scanned.where("noise = 'word'").join(fixes, scanned.a == fixes.form, "left_semi").select("record_id", F.lit("misread").alias("noise"))
    ).distinct()


_STRAY = re.compile(r"[^\W\d_][|~][^\W\d_]|[^\W\d_]{2}\|(?=\s|[.,;]|$)|[a-zà-ÿ]@[a-zà-ÿ]|(?<![\w.])@[a-zà-ÿ]{2}")


def _stray(text: str) -> bool:
    """Strokes and specks inside a word."""
    return ("|" in text or "~" in text or "@" in text) and bool(_STRAY.search(text))


def _breaks(scanned: DataFrame, counts: DataFrame) -> DataFrame:
    """A break is noise unless the corpus knows the word with its hyphen and not without."""
    words = counts.where("kind = 'w'").select(F.lower("form").alias("form")).distinct()
    b = scanned.where("noise = 'break'").select("record_id", F.lower("a").alias("a"), F.lower("b").alias("b"))
    hyphened = b.join(words, b.a == words.form, "left").select("record_id", "a", "b", F.col("form").isNotNull().alias("known"))
    joined = words.select(F.col("form").alias("whole"))
    out = hyphened.join(joined, hyphened.b == joined.whole, "left")
    return out.where(~F.col("known") | F.col("whole").isNotNull() | F.col("b").isNull()).select("record_id", F.lit("hyphenation").alias("noise"))


def _heads(scanned: DataFrame, base: DataFrame) -> DataFrame:
    """Records whose lines name a chapter, or repeat in the margin or beside the page's number."""
    head = _judged(scanned, base)
    names = head.select("record_id", F.lit("header").alias("noise"))
    numbers = head.where("own").select("record_id", F.lit("page_number").alias("noise"))
    return names.unionByName(numbers)


def _judged(scanned: DataFrame, base: DataFrame, *more: str) -> DataFrame:
    """``record_id, own, *more`` of the lines that are running heads."""
    b = F.col("b")
    lines = scanned.where("noise = 'head'").select("record_id", "project_id", F.ltrim("a", F.lit("\x01")).alias("key"), F.col("a").startswith("\x01").alias("chapter"), b.eqNullSafe("own").alias("own"), b.isNotNull().alias("apart"), "page", *more)

    def keys(rows):
        for project, t in rows:
            yield project, re.sub(r"\d+", "#", t.strip()).casefold()

    headings = base.where((F.col("kind") == "heading") & (F.coalesce(F.col("y0") >= MARGIN * F.col("height"), F.lit(True))) & ~F.col("text").contains("\n"))
    titles = map_rows(headings.select("project_id", "text").distinct(), keys, "project_id string, key string").distinct().withColumn("title", F.lit(True))
    # A wrapped line of prose repeats by chance in a large project.
    pages = lines.where((F.length("key") > 2) & F.col("apart")).groupBy("project_id", "key").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a < b").select("project_id", "key", F.lit(True).alias("repeated"))
    judged = lines.join(titles, ["project_id", "key"], "left").join(pages, ["project_id", "key"], "left")
    return judged.where(F.col("chapter") | F.coalesce("title", F.lit(False)) | F.col("apart") & F.coalesce("repeated", F.lit(False))).select("record_id", "own", *more)


def meant_forms(counts: DataFrame) -> DataFrame:
    """``form, meant``: the most frequent correction of a form; ``-`` and a word stands for one known with its hyphen alone."""
    words = counts.where("kind = 'w'").groupBy("form").agg(F.max("n").alias("n"))
    fixes = corrections(counts).join(words.withColumnRenamed("form", "meant"), "meant").groupBy("form").agg(F.max(F.struct("n", "meant"))["meant"].alias("meant"))
    lower = words.select(F.lower("form").alias("form")).distinct()
    hyphened = lower.where(F.col("form").rlike("^[^-]+-[^-]+$")).select("form", F.regexp_replace("form", "-", "").alias("whole"))
    kept = hyphened.join(lower.select(F.col("form").alias("whole")), "whole", "left_anti").select(F.concat(F.lit("-"), "form").alias("form"), F.col("form").alias("meant"))
    return fixes.unionByName(kept)


def mend(text: str, meant: dict[str, str], pairs: dict[str, int], judged: dict[str, str] | None = None) -> str:
    """Broken words joined, misread words and ideographs replaced by what is ``meant``."""

    def join(m: re.Match[str]) -> str:
        a, sign, b = m.groups()
        if not b[0].islower():
            return m.group()
        return f"{a}-{b}" if sign == "-" and f"-{a}-{b}".lower() in meant else a + b

    def word(m: re.Match[str]) -> str:
        form = m.group()
        out = meant.get(form, form)
        return out[0].upper() + out[1:] if form[0].isupper() else out

    while "\n" in text and _MAY_BREAK.search(text):
        before, text = text, _BREAK.sub(join, text)
        if text == before:
            break
    text = _WORD.sub(word, text)
    if _MISREAD_CJK.search(text):
        flat = _ideographs(text)
        wrong = misread_ideographs(flat, pairs, judged)
        if wrong:
            dropped = {i for m in _NEWLINE_CJK.finditer(text) for i in range(*m.span())}
            places = [i for i in range(len(text)) if i not in dropped]
            letters = list(text)
            for i, c in wrong.items():
                letters[places[i]] = c
            text = "".join(letters)
    return text


def repaired(records: DataFrame) -> DataFrame:
    """``record_id, page, text`` of ``records`` as for ``found``, one row each, without the noise that it finds.

    Lines that are running heads or page numbers are dropped (a text that holds nothing else
    is null), broken words are joined by the vocabulary, misread ones replaced.
    """
    base = records.where(F.length("text") > 0).groupBy("record_id").agg(F.first(F.struct("project_id", "page", "kind", "text", "y0", "height")).alias("r")).select("record_id", "r.*").persist()
    # The vocabulary is that of ``found``, repeated rows included.
    counts = counted(records.where((F.length("text") > 0) & ~F.col("kind").isin("code", "equation", "table")), "text").persist()
    spark = records.sparkSession
    bigrams = spark.sparkContext.broadcast(_pairs_of(counts))
    forms = meant_forms(counts).persist()
    table = forms.limit(BROADCAST_FORMS + 1).collect()
    shared = spark.sparkContext.broadcast({r["form"]: r["meant"] for r in table} if len(table) <= BROADCAST_FORMS else None)

    def lines_of(rows):
        for record_id, project, page, kind, text, y0, height in rows:
            lines = text.split("\n")
            marginal = _marginal(lines, y0, height)
            if marginal or len(lines) > 1 and kind not in ("code", "equation", "table"):
                for no, line in enumerate(lines):
                    number, key, own = furniture(line, page)
                    if number:
                        yield record_id, "page_number", None, None, None, page, no
                    elif key is not None:
                        yield record_id, "head", project, key, _head(own, marginal), page, no

    scanned = map_rows(base, lines_of, "record_id string, noise string, project_id string, a string, b string, page int, no int").persist()
    gone = scanned.where("noise = 'page_number'").select("record_id", "no").unionByName(_judged(scanned, base, "no").select("record_id", "no")).groupBy("record_id").agg(F.collect_set("no").alias("gone"))
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).when(F.size(left) > 0, F.array_join(left, "\n"))
    marginal = F.coalesce((F.col("height") != 0) & ((F.col("y0") < MARGIN * F.col("height")) | (F.col("y0") > (1 - MARGIN) * F.col("height"))) & (F.size(lines) == 1), F.lit(False))
    sound = F.coalesce(F.col("kind").isin("code", "equation", "table"), F.lit(False)) | marginal
    stripped = base.join(gone, "record_id", "left").select("record_id", "page", text.alias("text"), sound.alias("sound"))
    none = F.lit(None).cast("map<string,string>")
    if shared.value is None:

        def candidates(rows):
            for record_id, t in rows:
                breaks = [a + "-" + b for a, _, b in _BREAK.findall(t)]
                for w in {*_WORD.findall(_BREAK.sub(r"\1\3", t)), *_WORD.findall(t), *breaks, *("-" + x.lower() for x in breaks)}:
                    yield record_id, w

        own = map_rows(stripped.where(~F.col("sound") & F.col("text").isNotNull()).select("record_id", "text"), candidates, "record_id string, form string").join(forms, "form")
        stripped = stripped.join(own.distinct().groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("form", "meant"))).alias("meant")), "record_id", "left")
    else:
        stripped = stripped.withColumn("meant", none)

    if bigrams.value is None:
        stripped = stripped.join(_judged_contexts(stripped.where(~F.col("sound") & F.col("text").isNotNull()), "record_id", "text", counts), "record_id", "left")
    else:
        stripped = stripped.withColumn("judged", none)

    def run(rows):
        everywhere, pairs = shared.value, bigrams.value
        for record_id, page, t, sound, own, judged in rows:
            meant = everywhere if everywhere is not None else dict(own or ())
            yield record_id, page, t if t is None or sound else mend(t, meant, pairs, dict(judged or ()) if pairs is None else None)

    return map_rows(stripped.select("record_id", "page", "text", "sound", "meant", "judged"), run, "record_id string, page int, text string")


def reflow(records: DataFrame) -> DataFrame:
    """``record_id, text``: page numbers dropped and lines joined into paragraphs by SQL windows.

    A line goes on in the next one unless it ends a sentence before a shorter line's end or a
    blank line follows; a hyphen before a lower-case letter joins a broken word.  Lines keep
    their order; null texts are dropped.
    """
    lines = records.where(F.col("text").isNotNull()).select("record_id", "page", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    own = F.col("page").cast("string")
    number = (F.regexp_extract("line", r"^\s*(?:\[|[-–—] ?|Page )?(\d+)(?:\]| ?[-–—])?\s*$", 1) == own)
    kept = lines.where(~F.coalesce(number, F.lit(False)))
    w = Window.partitionBy("record_id").orderBy("no")
    nxt = F.lead("line").over(w)
    broken = F.col("line").rlike(r"\p{L}[-‐­¬]\s*$") & F.coalesce(nxt.rlike(r"^\s*\p{Ll}"), F.lit(False))
    blank = F.coalesce(F.trim(nxt) == "", F.lit(False)) | (F.trim("line") == "")
    cjk = F.col("line").rlike(r"[　-鿿＀-￯]\s*$")
    piece = F.when(broken, F.regexp_replace("line", r"[-‐­¬]\s*$", "")).when(nxt.isNull(), F.col("line")).when(blank, F.concat("line", F.lit("\n"))).when(cjk, F.rtrim("line")).otherwise(F.concat(F.rtrim("line"), F.lit(" ")))
    pieces = kept.select("record_id", "no", piece.alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("no", "piece")))
    return pieces.groupBy("record_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))
