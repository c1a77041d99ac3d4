"""Text functions as Spark columns: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and their letters.
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"))
# Patterns of list markers, note and reader labels, and captions.
LIST_MARKER = r"^\s*(?:[-+*•▪■●]\s+|\d+[.)]\s+)"
NOTE_LABEL = r"(?i)^(?:[■▪●]\s*)?(?:note|tip|warning|caution|what[’']s new|注意|提示|警告|新增内容)\s*[:：]?\s*"
READER_LABEL = r"^\s*(?:读者注|译者注)\s*[:：]\s*"
CAPTION = r"^\s*(图|表)\s*(\d+(?:\s*[-–—]\s*\d+)*)\s*(?:[。.．:：]+\s*)?(\S(?:.*\S)?)\s*$"
# Patterns of tokens that a translation must keep, in their order.
PROTECTED = (
    r"https?://[^\s)>]+",
    r"(?U)\b(?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*\b",
    r"(?U)\b[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+\b",
    r"(?U)\b[A-Z]{2,8}(?:[A-Z0-9_.-]*[A-Z0-9])?\b",
    r"(?U)\b\d+(?:\.\d+)?\s?(?:%|ms|s|kg|m|cm|mm|Hz|kHz|MHz|Pa|K|bar)\b",
    r"\[(?:\d+(?:\s*[-,]\s*\d+)*)\]",
)
# Tokens that the patterns find and that aren't protected.
UNPROTECTED = ("EG", "IE", "E.G", "I.E", "THE", "AND", "USING", "MORE")
# Patterns of the tokens that are counted and compared.
MEMORY_TOKEN = r"[a-z][a-z0-9_.-]{1,}|[㐀-鿿]{2,}"
COVERAGE_TOKEN = r"[A-Za-z0-9]+|[Ͱ-Ͽ]|[∀-⋿]"
NUMBER = r"(?<![A-Za-z0-9^])[-+]?\d+(?:[.,]\d+)?(?:\s*[×x]\s*10\^?[-+]?\d+|\^[-+]?\d+)?"
UNIT = r"(?U)(?<![A-Za-z0-9^])[-+]?\d+(?:\.\d+)?(?:\s*[×x]\s*10\^?[-+]?\d+|\^[-+]?\d+)?\s*(?:%|ms|s|kg|m|cm|mm|Hz|kHz|MHz|Pa|K|bar)\b"
MATH_SUSPECT = r"\b(?:Re|R|St)\d+(?:/\d+)?\b|[ρντλ]\d+(?:/\d+)?\b|×\s*10\d{2,}\b"
CJK = r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def join_wrapped_lines(c: Column) -> Column:
    """Lines of one paragraph as one line: a hyphen before a small letter glues, so does punctuation."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    return F.aggregate(
        lines,
        F.lit(""),
        lambda acc, x: F.when(acc == "", x)
        .when(acc.endswith("-") & x.rlike("^[a-z]"), F.concat(F.regexp_replace(acc, "-$", ""), x))
        .when(x.rlike(r"^[,.;:!?)}\]]"), F.concat(acc, x))
        .otherwise(F.concat(acc, F.lit(" "), x)),
    )


def normalize_prose(c: Column) -> Column:
    """Ligatures, soft hyphens, control characters, broken words and wrapped lines undone."""
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.replace(c, F.lit("­"), F.lit(""))
    c = F.regexp_replace(c, "(?m)^\x02[ \t]*", "• ")
    c = F.regexp_replace(c, "[ \t]*\x02[ \t]*", " → ")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?=[a-z])", "")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])-\s+(?=[a-z])", "")
    return join_wrapped_lines(c)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def protected_tokens(c: Column) -> Column:
    """Tokens a translation must keep, each once, in the order of their kinds."""
    urls = F.transform(matches(c, PROTECTED[0]), lambda t: F.regexp_replace(t, "[.,;:!?]+$", ""))
    found = F.array_distinct(F.concat(urls, *[matches(c, p) for p in PROTECTED[1:]]))
    return F.filter(found, lambda t: (t != "") & ~F.regexp_replace(F.upper(t), r"\.+$", "").isin(*UNPROTECTED))


def memory_tokens(c: Column) -> Column:
    return F.array_distinct(matches(F.lower(c), MEMORY_TOKEN))


def comparable(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def slugify(c: Column, default: str = "document") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(s, F.lit(64)), "-+$", ""), F.lit("")), F.lit(default))


def safe_name(c: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens of a name; null where none is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""), F.lit(""))


def last_segment(batch_id: Column) -> Column:
    return F.substring_index(batch_id, "-", -1)


def batch_series(batch_id: Column) -> Column:
    return F.nullif(F.regexp_extract(batch_id, r"^(.+)-b\d+$", 1), F.lit(""))


def normalize_zh_caption(c: Column) -> Column:
    """One space between a figure's or table's number and its title; other texts as they are."""
    pattern = "(?s)" + CAPTION
    number = F.regexp_replace(F.regexp_extract(c, pattern, 2), r"\s+", "")
    return F.when(c.rlike(pattern), F.concat(F.regexp_extract(c, pattern, 1), F.lit(" "), number, F.lit(" "), F.regexp_extract(c, pattern, 3))).otherwise(c)


def without_quoted_titles(c: Column) -> Column:
    return F.regexp_replace(c, '["“][^"”]{2,}["”]', " ")


def list_body(c: Column) -> Column:
    return F.regexp_replace(c, LIST_MARKER, "")


def list_ordinal(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+)[.)]\s+", 1), F.lit("")).cast("int")


def note_body(c: Column) -> Column:
    return F.regexp_replace(c, NOTE_LABEL, "")


def note_variant(c: Column, explicit: Column) -> Column:
    found = F.lower(F.regexp_extract(c, r"(?i)^(?:[■▪●]\s*)?(note|tip|warning|caution|what[’']s new)\b", 1))
    return F.coalesce(explicit, F.when(found.rlike("^what"), F.lit("whats-new")).when(found != "", found).otherwise(F.lit("note")))


def reader_note_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, READER_LABEL, ""))


def escape_prose(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fenced_code(c: Column, language: Column) -> Column:
    """A fence longer than the longest run of back-ticks in the text, three at least."""
    runs = F.transform(matches(c, "`+"), lambda x: F.length(x))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.coalesce(F.nullif(language, F.lit("")), F.lit("text")), F.lit("\n"), c, F.lit("\n"), fence)


def continuation_separator(left: Column, right: Column) -> Column:
    """What stands between two parts of a continued text: a space or nothing."""
    def bare(c: Column) -> Column:
        plain = F.regexp_replace(c, "<[^>]+>", "")
        return F.replace(F.replace(F.replace(F.replace(plain, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))

    a, b = F.regexp_replace(bare(left), r"\s+$", ""), F.regexp_replace(bare(right), r"^\s+", "")
    code_right, code_left = b.startswith("`") | F.ltrim(right).startswith("<code"), a.endswith("`") | F.rtrim(left).endswith("</code>")
    cjk_left, cjk_right = a.rlike(CJK + "$"), b.rlike("^" + CJK)
    return (
        F.when((a == "") | (b == ""), "")
        .when((cjk_left & code_right) | (code_left & cjk_right), " ")
        .when(a.rlike("[-‐‑]$") & b.rlike(r"^[\p{L}\p{N}]"), "")
        .when(cjk_left | cjk_right, "")
        .otherwise(" ")
    )


def model_matches(requested: Column, actual: Column) -> Column:
    """Two labels agree if one holds the other, letters and digits only."""
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]+", "") for x in (requested, actual))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def json_body(c: Column) -> Column:
    """The JSON object inside a fenced or chatty answer: from the first brace to the last."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
