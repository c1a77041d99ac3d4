"""Markup residue of HTML, Markdown, wiki and LaTeX in texts, and its conversion to clean text.

A text is scanned for *containers*: a construct with its markup language, a generalised
path (element and class, digits masked) and a score for how much it looks like markup
rather than prose or code (closed, attributed, self-closing; glued to a name, a product, an
index or a placeholder).  The paths of all languages are voted on per host (project) in
Spark: a path wins where the mean score of the host's records outweighs the weak prior of
the language's own constructs, however many records there are.  Only the winning paths count
as residue, and only their constructs are converted when the clean text is extracted, so
that ``List<int>`` in one host and ``<i>`` left open in another are told apart by what the
host's other records do.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows

# Names of HTML elements.
ELEMENTS = frozenset(
    "a abbr address article aside b big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark "
    "math meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody "
    "td tfoot th thead title tr tt u ul var video wbr".split()
)
# Commands of LaTeX that mark text up.
TEXT_COMMANDS = frozenset(
    "textbf textit texttt textsc textrm textsf emph underline section subsection subsubsection paragraph chapter part caption "
    "cite citep citet ref eqref label footnote url href item begin end it bf tt sc em rm sf par noindent title author".split()
)

# HTML elements without content, which are never closed.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Vote of a language for its own constructs (against foreign ones), and the weight of a path's mean score.
PRIOR, FOREIGN_COMMAND, WEIGHT = 1.2, -0.4, 2.4
#: Winning paths that are broadcast at most, and the parts into which each host's records are split beyond.
BROADCAST_PATHS, SALT = 100_000, 16

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_LONE_FENCE = re.compile(r"^[ \t]*(?:```+|~~~+)", re.M)
_TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z_:][-\w:.]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*)\s*(/?)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_CLASS = re.compile(r"(?:class|id)\s*=\s*[\"']?([\w-]+)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(?=\S)", re.M)
_STRONG = re.compile(r"(?<![\\*])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?!\*)")
_UNDER = re.compile(r"(?<![A-Za-z0-9_])__(?=[^\s_])([^_\n]+?)(?<=\S)__(?![A-Za-z0-9])|(?<=[^\x00-\x7f])__(?=[^\s_])([^_\n]+?)__")
_LOW = re.compile(r"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=\S)_(?![\w_])")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+)~~")
_OPEN_STRONG = re.compile(r"(?<!\*)\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}(?!\*)|~~(?=\w)")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(([^()\s]*)\)?")
_LINK = re.compile(r"(?<![!\[])\[([^\[\]\n]+)\]\((?=[^\s)])([^()\s]*)\)?")
_RULE = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?$", re.M)
_QUOTE = re.compile(r"^ {0,3}>(?:[ \t]|$)", re.M)
_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*={1,6}[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]*)(?:\]\]|(?=\n|\Z))")
_TEMPLATE = re.compile(r"\{\{([^{}\n]*)(?:\}\}|(?=\n|\Z))")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}|^[ \t]*\|-[^|\n]*$", re.M)
_WIKI_EM = re.compile(r"(?<!')('{2}|'{3}|'{5})(?!')")
_DISPLAY = re.compile(r"\$\$[^$]+(?:\$\$|\Z)|\\\[.+?(?:\\\]|\Z)", re.S)
_INLINE = re.compile(r"\\\(.+?(?:\\\)|\Z)|(?<![\\$\w])\$(?=[^\s$])([^$\n]*[^\s$\\])\$(?![\w$])", re.S)
_COMMAND = re.compile(r"~?\\([A-Za-z]+)(\*?)(?=[\s{\[~]|$)")
_MATHLIKE = re.compile(r"[\\^_={}+]|^[A-Za-z]$")
_DIGITS = re.compile(r"\d+")

Found = tuple[str, str, float]


def _blank(text: str, pattern: re.Pattern[str]) -> str:
    return pattern.sub(lambda m: " " * len(m.group()), text)


def _tag_path(m: re.Match[str]) -> str:
    own = _CLASS.search(m.group(3))
    return m.group(2).lower() + ("." + _DIGITS.sub("#", own.group(1)) if own else "")


def _in_product(m: re.Match[str]) -> bool:
    """Stars or underscores between names and numbers, as in a product."""
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    return before.isascii() and (before.isalnum() or before == ")") and after.isascii() and (after.isalnum() or after == "(")


def _emphasis_path(m: re.Match[str]) -> str:
    return "emphasis.product" if _in_product(m) else "emphasis"


def _link_path(m: re.Match[str]) -> str:
    """A wiki link, or the index of a table in code: numbers and short names behind a name."""
    before = m.string[m.start() - 1 : m.start()]
    glued = before.isascii() and (before.isalnum() or before in ")]" and bool(before))
    parts = re.split(r"[\s,:]+", m.group(1).strip())
    return "link.index" if all(not x.isalpha() and not any(map(str.isalpha, x)) or glued and len(x) <= 2 for x in parts) else "link"


def _template_path(m: re.Match[str]) -> str:
    """A wiki template, or a placeholder of a template engine."""
    inner = m.group(1)
    return "template.placeholder" if "|" not in inner and (inner[:1] == " " and inner[-1:] == " " or re.fullmatch(r"\w+(?:\.\w+)+", inner.strip())) else "template"


def _tag_score(m: re.Match[str], closed: set[str]) -> float:
    name = m.group(2).lower()
    if m.group(1) or m.group(3) or m.group(4) or name in closed or name in VOID:
        return 1.0
    before = re.search(r"[A-Za-z0-9_]*$", m.string[max(0, m.start() - 40) : m.start()]).group()
    return -1.0 if before[:1].isupper() or before and name not in ELEMENTS else -0.4


_FOREIGN = ("emphasis.product", "link.index", "template.placeholder")


def containers(text: str, field: str = "") -> list[Found]:
    """(language, generalised path, score) of each construct; code is quoted, not scanned."""
    found: list[Found] = []

    def add(language: str, path: str, score: float = 1.0) -> None:
        found.append((language, path, -1.0 if path in _FOREIGN else score))

    if "```" in text or "~~~" in text:
        if _LONE_FENCE.search(text):
            add("markdown", "fence")
        text = _blank(text, _FENCE)
    if "`" in text and _TICKS.search(text):
        add("markdown", "code")
        text = _blank(text, _TICKS)
    if "<" in text:
        if _COMMENT.search(text):
            add("html", "comment")
            text = _blank(text, _COMMENT)
        tags = list(_TAG.finditer(text))
        closed = {m.group(2).lower() for m in tags if m.group(1)}
        for m in tags:
            add("html", _tag_path(m), _tag_score(m, closed))
    if "&" in text:
        for m in _ENTITY.finditer(text):
            add("html", "entity", 1.0 if html.unescape(m.group()) != m.group() else -1.0)
    latex_field = field == "latex"
    if not latex_field and ("\\" in text or "$" in text):
        if _DISPLAY.search(text):
            add("latex", "display")
        for m in _INLINE.finditer(text):
            if m.group(1) is None or _MATHLIKE.search(m.group(1)):
                add("latex", "inline")
        text = _blank(_blank(text, _DISPLAY), _INLINE)
        for m in _COMMAND.finditer(text):
            braced = text[m.end() : m.end() + 1] in "{["
            before = text[m.start() - 1 : m.start()]
            drive = before == ":" or (before.isalnum() and before.isascii())
            add("latex", "command." + m.group(1), 1.0 if braced or before == "{" else -1.0 if drive else 0.0)
    if "[[" in text:
        for m in _WIKI_LINK.finditer(text):
            if m.group(1).strip():
                add("wiki", _link_path(m))
        text = _blank(text, _WIKI_LINK)
    if "{{" in text:
        for m in _TEMPLATE.finditer(text):
            name = m.group(1).split("|", 1)[0].strip()
            if name and not latex_field or "|" in m.group(1):
                add("wiki", _template_path(m), 1.0 if "|" in m.group(1) else 0.5)
    if "{|" in text or "|}" in text or "|-" in text:
        if _WIKI_TABLE.search(text):
            add("wiki", "table")
    if "''" in text and _WIKI_EM.search(text):
        add("wiki", "emphasis")
    if "==" in text and _WIKI_HEADING.search(text):
        add("wiki", "heading")
    if "#" in text and _HEADING.search(text):
        add("markdown", "heading")
    if "*" in text or "_" in text or "~" in text:
        spans = [*_STRONG.finditer(text), *_UNDER.finditer(text), *_LOW.finditer(text), *_STRIKE.finditer(text)]
        if spans and not latex_field or any(m.group().startswith("**") for m in spans):
            for m in spans:
                add("markdown", _emphasis_path(m))
        elif _OPEN_STRONG.search(text):
            add("markdown", "emphasis.open", 0.5)
    if "](" in text:
        if _IMAGE.search(text):
            add("markdown", "image")
        if _LINK.search(text):
            add("markdown", "link")
    if "---" in text and "|" in text and _RULE.search(text):
        add("markdown", "table")
    if not latex_field and ">" in text and _QUOTE.search(text):
        add("markdown", "quote")
    return found


def prior(language: str, path: str) -> float:
    """The vote that the language itself casts for a path."""
    if language == "html":
        name = path.split(".", 1)[0]
        return PRIOR if name in ELEMENTS or name in ("comment", "entity") else -PRIOR
    if language == "latex" and path.startswith("command."):
        return PRIOR if path[8:] in TEXT_COMMANDS else FOREIGN_COMMAND
    return PRIOR


#: Texts without any of these characters hold no container; the JVM drops them before Python.
SUSPECT_JVM = r"[<&\\$`*_~{]|''|\[\[|\]\(|==|---|(?m)^ {0,3}[#>]|\|[-}]"


def scan(records: DataFrame, keys: list[str], host: str, field: str, text: str) -> DataFrame:
    """``*keys, host, field, language, path, prior, score, n``: the containers of each record."""
    types = {f.name: f.dataType.simpleString() for f in records.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", host string, field string, language string, path string, prior double, score double, n int"
    n = len(keys)

    def run(rows):
        for row in rows:
            per: dict[tuple[str, str], list[float]] = {}
            for language, path, score in containers(row[n + 2], row[n + 1]):
                per.setdefault((language, path), []).append(score)
            for (language, path), scores in per.items():
                yield (*row[:n], row[n], row[n + 1], language, path, prior(language, path), sum(scores), len(scores))

    picked = records.where(F.col(text).rlike(SUSPECT_JVM)).select(*keys, F.col(host).cast("string"), F.col(field), F.col(text))
    return map_rows(picked, run, schema)


def winning_paths(scanned: DataFrame) -> DataFrame:
    """``host, language, path`` that win the vote of their host: the prior and the weighted mean score are positive together.

    The outcome doesn't depend on how often the host has the path.
    """
    return (
        scanned.groupBy("host", "language", "path")
        .agg(F.sum("score").alias("score"), F.sum("n").alias("n"), F.max("prior").alias("prior"))
        .where(F.col("prior") + WEIGHT * F.col("score") / F.col("n") > 0)
        .select("host", "language", "path")
    )


def residue(records: DataFrame, keys: list[str], host: str, field: str, text: str) -> DataFrame:
    """``*keys, field, markup``: the markup languages of which a record's field holds residue.

    Null, empty and markup-free texts give no row, repeated rows one.  A null host votes as a
    host of its own.  Columns other than the named ones are ignored.
    """
    scanned = scan(records, keys, host, field, text)
    won = winning_paths(scanned)
    hits = scanned.join(won.withColumnRenamed("host", "h"), (F.col("host").eqNullSafe(F.col("h"))) & (scanned.language == won.language) & (scanned.path == won.path), "left_semi")
    return hits.select(*keys, "field", F.col("language").alias("markup")).distinct()


_BLOCKS = frozenset("p div ul ol table thead tbody tr blockquote pre br hr section article header footer dl dt dd".split())
_LATEX_HEADING = re.compile(r"\\(((?:sub)*)section)\*?\{([^{}]*)\}")
_LATEX_ENV = re.compile(r"\\(begin|end)\{[^{}]*\}(?:\[[^\]]*\])?\n?")
_LATEX_ITEM = re.compile(r"\\(item)\b[ \t]*")
_LATEX_DROP = re.compile(r"~?\\(cite[pt]?|ref|eqref|label)\{[^{}]*\}?")
_LATEX_WRAP = re.compile(r"\\(text(?:bf|it|tt|sc|rm|sf)|emph|underline|footnote|caption)\{([^{}]*)\}?")
_LATEX_SWITCH = re.compile(r"\{\\(it|bf|tt|sc|em|rm|sf)\s+([^{}]*)\}")
_TABLE_LINES = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^|\n]*)[ \t]*\n?", re.M)


def clean(text: str | None, won: frozenset[tuple[str, str]] | None = None) -> str | None:
    """Clean text that keeps headings (``# ``), lists (``- ``), code blocks and formulas.

    ``won`` are the (language, path) pairs that count as markup; None takes all that their
    language knows.  A construct whose path lost stays as it is.  None gives None; code and
    formulas keep their content.
    """
    if not text:
        return text
    kept: list[str] = []

    def keep(m: re.Match[str]) -> str:
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    def ok(language: str, path: str) -> bool:
        return prior(language, path) > 0 and path not in _FOREIGN if won is None else (language, path) in won

    def sub(language: str, path, pattern: re.Pattern[str], new) -> None:
        nonlocal text
        text = pattern.sub(lambda m: (m.expand(new) if isinstance(new, str) else new(m)) if ok(language, path if isinstance(path, str) else path(m)) else m.group(), text)

    def tag(m: re.Match[str]) -> str:
        name, closing = m.group(2).lower(), bool(m.group(1))
        if re.fullmatch("h[1-6]", name):
            return "\n" if closing else f"\n{'#' * int(name[1])} "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return " | " if closing else ""
        return "\n" if name in _BLOCKS else ""

    def command(m: re.Match[str]) -> str:
        return "command." + m.group(1)

    text = text.replace("\x00", "")
    text = _FENCE.sub(keep, text)
    text = _TICKS.sub(keep, text)
    text = _DISPLAY.sub(keep, text)
    text = _INLINE.sub(lambda m: keep(m) if m.group(1) is None or _MATHLIKE.search(m.group(1)) else m.group(), text)
    sub("html", "comment", _COMMENT, "")
    sub("html", _tag_path, _TAG, tag)
    text = re.sub(r"(?: \| )+(?=\n|$)", "", text)
    sub("html", "entity", _ENTITY, lambda m: html.unescape(m.group()))
    sub("latex", command, _LATEX_HEADING, lambda m: f"{'#' * (1 + len(m.group(2)) // 3)} {m.group(3)}")
    sub("latex", command, _LATEX_ENV, "")
    sub("latex", command, _LATEX_ITEM, "- ")
    sub("latex", command, _LATEX_DROP, "")
    sub("latex", command, _LATEX_WRAP, r"\2")
    sub("latex", command, _LATEX_SWITCH, r"\2")
    sub("wiki", "heading", _WIKI_HEADING, lambda m: "#" * (len(m.group(1)) - 1) + " " + m.group(2))
    sub("wiki", _link_path, _WIKI_LINK, lambda m: "" if m.group(1).startswith(("Category:", "File:")) else m.group(1).split("|")[-1])
    sub("wiki", _template_path, _TEMPLATE, lambda m: "" if m.group(1).startswith("cite") else m.group(1).split("|")[-1])
    sub("wiki", "emphasis", _WIKI_EM, "")
    sub("wiki", "table", _TABLE_LINES, "")
    sub("markdown", "image", _IMAGE, r"\1")
    sub("markdown", "link", _LINK, r"\1")
    sub("markdown", "table", _RULE, "")
    sub("markdown", "quote", _QUOTE, "")
    sub("markdown", _emphasis_path, _STRIKE, r"\1")
    sub("markdown", _emphasis_path, _STRONG, r"\2")
    sub("markdown", _emphasis_path, _UNDER, lambda m: m.group(1) or m.group(2))
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], text)


def extract(records: DataFrame, keys: list[str], host: str, field: str, text: str) -> DataFrame:
    """``*keys, field, clean_text``: the records re-extracted with the winning paths of their host.

    Null texts stay null; texts without markup stay as they are; repeated rows come back as
    often as they came.
    """
    paths = winning_paths(scan(records, keys, host, field, text)).persist()
    table = paths.limit(BROADCAST_PATHS + 1).collect()
    few = len(table) <= BROADCAST_PATHS
    by_host: dict[str | None, set[tuple[str, str]]] = {}
    for r in table if few else ():
        by_host.setdefault(r["host"], set()).add((r["language"], r["path"]))
    shared = records.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})
    types = {f.name: f.dataType.simpleString() for f in records.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", field string, clean_text string"
    n = len(keys)

    def run(rows):
        hosts = shared.value
        for row in rows:
            won = hosts.get(row[n + 2], frozenset()) if few else frozenset(tuple(x.split("\t", 1)) for x in row[n + 3] or ())
            yield (*row[:n], row[n], clean(row[n + 1], won))

    base = records.select(*keys, F.col(field).alias("__field"), F.col(text).alias("__text"), F.col(host).cast("string").alias("__host"))
    if not few:
        won = paths.groupBy("host").agg(F.collect_set(F.concat_ws("\t", "language", "path")).alias("__won"))
        won = won.select(F.col("host").alias("__h"), "__won", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__s"))
        salted = base.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(SALT)).cast("int"))
        base = salted.join(won, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__s")), "left").select(*keys, "__field", "__text", "__host", "__won")
    return map_rows(base, run, schema)
