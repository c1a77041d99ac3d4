"""Predicates and classifiers over blocks and units, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of captions, list items, notes, formulas, ends, code and page margins.
CAPTION = r"(?i)^(figure|fig\.|table)\s*\d+(?:[-–.]\d+)?[.:]?"
PROSE_CAPTION = r"(?i)^(?:figure|fig\.|table)\s*\d+(?:[-–.]\d+)?\s+(?:and|compares|demonstrates|illustrates|includes|lists|provides|sheds|shows|summarizes)\b"
LIST_ITEM = r"(?i)^(?:[•▪■●○◦–—-]|\(?\d+[.)]|[a-z][.)])\s+"
NOTE = r"(?i)^(?:[■▪●]\s*)?(tip|note|warning|caution|what[’']s new)\b"
EQUATION_SIGN = r"[=∑∫√∂∇±≤≥∞ρτλσνε]|\b(?:Re|PDF)\s*[=<>]"
TERMINAL = r"[.!?。！？:：;；][\"'”’）)\]]*$"
CONTINUING = r"^(?:[a-z]|and\b|or\b|but\b|which\b|that\b|with\b)"
CODE_START = r"(?m)^\s*using\s+[\w.]+\s*;\s*$|^\s*(?:(?:public|private|protected|internal)\s+)?(?:class|interface|enum|namespace)\s+\w+|^\s*(?:public|private|protected|internal)\s+[^.!?\n]+[;{]\s*$|^\s*(?:while|for|foreach|if)\s*\(|^\s*(?:xmlns[:A-Za-z0-9]*|x:(?:Class|TypeArguments))\s*="
MONOSPACE = r"courier|consol|typewriter|lucida ?console|mono(?:spaced?|[-_ ]|$)"
MARGIN_HEAD = r"^[■▪●]?\s*[A-Z][A-Z0-9 .&:;–—-]{2,}$"
MARGIN_NUMBER = r"(?i)^(?:(?:page\s*)?\d+|[ivxlcdm]+)$"


# What tells a listing from prose.
CODE_LINE = (
    r"(?m)^\s*(?:(?:public|private|protected|internal|static|async|override|virtual|new)\s+\w|(?:namespace|class|interface|enum|struct|delegate|record)\s+\w|"
    r"(?:using|return|throw|yield|await|lock|fixed)\s|(?:void|var|string|int|bool|byte|char|decimal|double|float|long|object)\s+[A-Za-z_]|"
    r"(?:while|for|foreach|if|switch|catch|using)\s*\(|try\s*\{|else\b|xmlns|x:\w+=|//|/\*|</?[A-Za-z]|\})"
)
DECLARATION = (
    r"(?m)^\s*(?:(?:public|private|protected|internal|static|partial|sealed|abstract|readonly|unsafe|new)\s+)*"
    r"(?:class|interface|enum|struct|delegate|record)\s+[A-Za-z_]\w*(?:\s*<[^>\n]+>)?\s*(?:[:{]|$)"
)
CODE_SIGN = r"[;{}=<>]|://|\(\)|=>"
API_CALL = r"\bnew\s+[A-Za-z_]|\w+\.\w+\s*=|\w+\.\w+\("
ATTRIBUTE = r"^(?:xmlns[:A-Za-z0-9]*=|x:[A-Za-z]+=)"
PROSE_WORD = r"(?i)\b(?:the|this(?!\s*\.)|that|you|your|when|which|however|because|although|unfortunately|instead|imagine|consider|remember)\b"
INDEX_ENTRY = r",\s*\d+(?:\s*[–-]\s*\d+)?\b"
INDEX_WORD = r"(?i)\b(?:class|document|field|method|object|operation|propert)"
MARKUP_LISTING = r"(?s)</?[A-Za-z][^>]*(?:=|/)[^>]*>|<([A-Za-z]\w*)[^>]*>.*</\1\s*>"
LISTING_OPENS = r"^(?://|/\*|if |while |for |foreach )"


def is_program_code(c: Column) -> Column:
    """A listing rather than prose, from what its lines show; null and blank texts are none."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    line = F.regexp_replace(t, r"\s+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    closed = F.size(F.filter(lines, lambda x: x.rlike(r";|[{}]$")))
    prose, api = line.rlike(PROSE_WORD), t.rlike(API_CALL)
    index = (F.size(F.regexp_extract_all(line, F.lit(INDEX_ENTRY), F.lit(0))) >= 2) & line.rlike(INDEX_WORD)
    tagged_prose = t.startswith("<") & ~t.rlike(MARKUP_LISTING)
    explains = prose & ((line.rlike(r"[.?!]$") & ~t.rlike(LISTING_OPENS)) | (closed < F.greatest(F.lit(2), F.floor((F.size(lines) + 1) / 2))))
    short = (F.length(line) < 280) & ~prose & api & t.rlike("[;{}]")
    return (
        F.when((t == "") | index | tagged_prose, False)
        .when((t.rlike(CODE_LINE) & t.rlike(CODE_SIGN)) | t.rlike(DECLARATION), True)
        .when((closed >= 1) & api, ~explains)
        .otherwise(t.rlike(ATTRIBUTE) | short)
    )


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"\n", " ")


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION) & ~c.rlike(PROSE_CAPTION)


def code_language(c: Column) -> Column:
    """Language of a listing by ordered rules; ``text`` where none holds."""
    tag = c.rlike(r"</?[A-Za-z][^>]*>")
    start = F.regexp_replace(c, r"^\s+", "")
    return (
        F.when(c.rlike(r"\bxmlns(?::\w+)?=") | c.rlike(r"\bx:(?:Class|Name|Key|TypeArguments)="), "xaml")
        .when(tag & (F.contains(c, F.lit("xmlns")) | F.contains(c, F.lit("x:Class")) | c.rlike(r"<(Grid|Window|Button)\b")), "xaml")
        .when(start.startswith("<") & tag, "xml")
        .when(c.rlike(r"\b(namespace|using|public|private|protected|internal|class|foreach|override)\b") & c.rlike("[;{}]"), "csharp")
        .when(c.rlike(r"(?m)^\s*(def|class|from|import)\s+"), "python")
        .when(c.rlike(r"(?mi)^\s*(SELECT|INSERT|UPDATE|CREATE)\b"), "sql")
        .when(c.rlike(r"(?m)^\s*(Get-|Set-|New-|\$[A-Za-z_])"), "powershell")
        .when(start.rlike(r"^[\{\[]") & c.rlike('"[^"\\n]+"\\s*:'), "json")
        .otherwise("text")
    )


def is_monospace(fonts: Column) -> Column:
    """Courier, Consolas, Lucida Console, typewriter or mono faces; Monotype isn't one."""
    return F.lower(F.array_join(fonts, " ")).rlike(MONOSPACE)


def looks_like_equation(text: Column, bbox: Column, width: Column) -> Column:
    """Centred, short, dense in mathematical signs, and no sentence."""
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    signs = F.size(F.regexp_extract_all(text, F.lit(EQUATION_SIGN), F.lit(0)))
    prose = F.size(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]{4,}\b"), F.lit(0)))
    formula = text.rlike(r"[A-Za-zρτλσνεημχ](?:\s*\^\s*[-+]?\d+)?\s*=") | text.rlike(r"[A-Za-z](?:\s*\^\s*[-+]?\d+)?(?:\s*[+\-*/]\s*[A-Za-z0-9])")
    centred = F.abs((bbox["x0"] + bbox["x1"]) / 2 - width / 2) < width * 0.28
    return centred & (words <= 35) & ((signs >= 1) | formula) & (prose <= 10) & (signs / words >= 0.08) & ~text.endswith(".")


def looks_like_continuation(previous: Column, current: Column) -> Column:
    """The previous text has no end and the current one begins small (code is the caller's matter)."""
    a, b = F.regexp_replace(previous, r"\s+$", ""), F.regexp_replace(current, r"^\s+", "")
    return (a != "") & (b != "") & ~a.rlike(TERMINAL) & b.rlike(CONTINUING)


def marginal_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\d+", "#")


def is_marginal(text: Column, bbox: Column, width: Column, height: Column, repeated: Column) -> Column:
    """Page furniture: repeated head or foot, capitals at the top, number at the bottom, side text."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    tall, wide = bbox["y1"] - bbox["y0"], bbox["x1"] - bbox["x0"]
    return (
        (repeated & ((bbox["y1"] < height * 0.14) | (bbox["y0"] > height * 0.86)))
        | ((bbox["y1"] < height * 0.08) & (tall < 20) & t.rlike(MARGIN_HEAD))
        | ((bbox["y0"] > height * 0.92) & (tall < 28) & t.rlike(MARGIN_NUMBER))
        | ((bbox["x0"] < width * 0.09) & (tall > height * 0.35) & (wide < 45))
    )


def looks_like_figure_labels(text: Column, kind: Column) -> Column:
    lines = F.size(F.split(text, "\n"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    digits = F.length(text) - F.length(F.regexp_replace(text, r"\d", ""))
    prose = one_line(text).rlike(r"[.!?]\s+[A-Z]")
    return kind.isin("paragraph", "list_item", "heading") & (words <= 55) & ~prose & (lines >= 2) & ((digits >= 2) | ((words > 0) & (words / lines < 4.5)))


def target_structure_error(kind: Column, target: Column) -> Column:
    """A heading, list item or note must not carry its own marker; null where it doesn't."""
    return (
        F.when((kind == "heading") & target.rlike(r"^\s*#{1,6}\s+"), "heading-marker")
        .when((kind == "list_item") & target.rlike(r"^\s*(?:[-+*•▪■●]\s+|\d+[.)]\s+)"), "list-marker")
        .when(
            (kind == "note") & (target.rlike(r"^\s*>") | target.rlike(r"(?i)\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]") | target.rlike(r"(?i)^\s*(?:注意|提示|警告|新增内容|note|tip|warning|caution|what[’']s new)\s*[:：]")),
            "note-shell",
        )
    )


def block_class(text: Column, bbox: Column, width: Column, height: Column, size: Column, median_size: Column, fonts: Column, is_code: Column, outline_match: Column) -> Column:
    """``kind, confidence, translatable`` of a block by ordered rules.

    ``is_code`` is the listing test, ``outline_match`` the best ratio (0 to 100) of the text with
    the page's outline titles.
    """
    line = one_line(text)
    large = (F.length(line) < 130) & (size >= F.greatest(median_size * 1.28, median_size + 1.5))
    code = is_monospace(fonts) | F.ltrim(text).startswith("<") | text.rlike(CODE_START) | is_code
    heading = F.least(F.lit(0.99), F.lit(0.78) + outline_match / 500)

    def of(kind: str, confidence, translatable: bool) -> Column:
        c = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(F.lit(kind).alias("kind"), c.alias("confidence"), F.lit(translatable).alias("translatable"))

    return (
        F.when(is_caption(line), of("caption", 0.97, True))
        .when(line.rlike(NOTE), of("note", 0.95, True))
        .when(code, of("code", 0.96, False))
        .when((bbox["y0"] > height * 0.80) & (size < median_size * 0.83), of("footnote", 0.78, True))
        .when(looks_like_equation(text, bbox, width), of("equation", 0.88, False))
        .when(line.rlike(LIST_ITEM), of("list_item", 0.92, True))
        .when((outline_match >= 70) | large, of("heading", heading, True))
        .when(line.rlike("(?i)^(references|literature cited|bibliography)$"), of("heading", 0.98, True))
        .otherwise(of("paragraph", 0.90, True))
    )


def table_shape_ok(rows: Column) -> Column:
    """Two rows and columns at least, 35 % of the cells filled, and enough of them for its size."""
    r = F.size(rows)
    c = F.coalesce(F.array_max(F.transform(rows, lambda x: F.size(x))), F.lit(0))
    filled = F.size(F.filter(F.flatten(rows), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return (r >= 2) & (c >= 2) & (filled >= F.lit(0.35) * r * c) & (filled >= F.greatest(F.lit(4), r + c - 2))
