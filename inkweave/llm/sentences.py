"""Sentence boundaries in texts of any script.

Terminators, closing marks and continuing marks are the characters of Unicode's
Sentence_Break property, so every script's own terminators count.  Four additions: the
abbreviations of the text's language suppress a break, quotations and brackets that hold
terminators stay whole, a break without a space needs a capital or a closed-class word of
the language behind it, and Thai is cut at spaces.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows

# Abbreviations after which no sentence ends, by language.
ABBREVIATIONS = {
    "en": frozenset("dr prof mr mrs ms st messrs fig figs no nos pp p vs e.g i.e cf eq eqs sec ch chap vol ed eds al ca approx dept est gen gov hon rev sen rep capt col lt sgt".split()),
    "de": frozenset("dr prof st ch chap abb nr vgl z.b u.a d.h bzw s kap tab bd bde hrsg ca inkl exkl sog resp evtl ggf usf z b u a d h fig vs al i.d.r o.ä v.a p pp vol jh jhd".split()),
}
ANY_LANGUAGE = frozenset().union(*ABBREVIATIONS.values())
# Units that are written like an abbreviation.
UNITS = frozenset("ms s h m b a d".split())
# Names of months after a day's ordinal.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Closed-class words, which open a sentence but no identifier.
CLOSED_CLASS = {
    "en": frozenset(
        "a an the this that these those my your his her its our their some any no every each all both either neither another such what which whose "
        "i you he she it we they who one there here and or but nor yet so for if unless until while when whenever where wherever why how because since though although whether once as than "
        "in on at by with without within from to of off over under about above below after before during between through across against among around behind beside beyond despite except into onto toward upon via per "
        "however therefore thus hence moreover otherwise instead still also then now not".split()
    ),
    "de": frozenset(
        "der die das den dem des ein eine einen einem einer eines dieser diese dieses diesen diesem jener jene jeder jede jedes alle beide mancher solche kein keine mein dein sein ihr unser euer welcher welche "
        "ich du er sie es wir man wer was und oder aber denn sondern noch sobald solange wenn falls weil da dass damit obwohl während bevor nachdem bis seit ob als wie wo woher wohin warum wann weshalb "
        "in im an am auf aus außer bei beim mit nach von vom vor zu zum zur über unter durch für gegen ohne um wegen trotz zwischen entlang innerhalb laut ab hinter neben "
        "jedoch deshalb daher also dennoch sonst dann nun nicht hier dort weder entweder".split()
    ),
}
CLOSED_IN_ANY = frozenset().union(*CLOSED_CLASS.values())
# Prepositions before an identifier such as Grid.Flush.
BEFORE_IDENTIFIER = frozenset("through by with using in on of from to at via per durch über mit in auf von aus zu bei nach um an als".split())

_ALL = "".join(chr(c) for c in (*range(0xD800), *range(0xE000, 0x12000), *range(0x16A00, 0x16B80), *range(0x1BC00, 0x1BCA0)))
#: Terminators but the full stop and its forms, and what may stand behind a terminator.
_STERM = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _ALL))
_SPACED = ".!?"
_OWN_TERMS = "".join(c for c in _STERM if c not in _SPACED)
_SET = re.escape(_OWN_TERMS)
_CJK = "぀-ヿ㐀-鿿"
_THAI = "฀-๿"
_CLOSERS = "\"'”’»」』）)\\]】"
_CANDIDATE = re.compile(rf"(?:[.!?](?![.])|\.\.+|[{_SET}])[.!?{_SET}]*[{_CLOSERS}]*")
_QUOTE = re.compile(r"„[^“”„]*(?:“|$)|“[^”“]*(?:”|$)|「[^」]*(?:」|$)|『[^』]*(?:』|$)|«[^»]*(?:»|$)|\"[^\"]*(?:\"|$)")
_BRACKET = re.compile(r"[（(\[【][^（）()\[\]【】]*[）)\]】]")
_WORD_BEFORE = re.compile(r"[^\s（(\[【「『“„\"'，、。：；]*$")
_NUMBER_BEFORE = re.compile(r"\d\s[^\s\d]+$")
_PREVIOUS_WORD = re.compile(r"(\S+)\s+\S*$")
_FURNITURE = re.compile(r"(?:\[\d+\]|[-–—] ?\d+ ?[-–—]|\(\d+\))[ \t]*(?:\n|$)")
_CAMEL = re.compile(r"[a-zäöü]+[A-ZÄÖÜ]")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]*>|~?\\(?:cite|ref|label)\{[^{}]*\}|\{\{cite[^{}]*\}\}", re.S)
_TAIL = re.compile(r"\s*(?:\||\{\||```|- \[|\\begin\{|\\[\[(]|\$|>\s*\n|<table|<ul|<br)")
_HAS_THAI = re.compile(f"[{_THAI}]")
_HAS_CJK = re.compile(f"[{_CJK}]")
_HAS_DEVA = re.compile("[ऀ-ॿ]")
_SPACE = re.compile(r"\s+")
_LATIN_LEFT = re.compile(r"([^\W\d_]\.|[^\W\d_]+)$")
_INITIAL_LEFT = re.compile(r"[A-Z]\.$")


def sentence_ends(text: str | None, lang: str | None = None) -> list[int]:
    """Ends of the sentences of ``text`` in code points, exclusive, closing marks included.

    A null, empty or blank text has no sentence.  What follows the last terminator is a
    sentence too if it holds a letter or digit.  ``lang`` chooses the abbreviations and
    closed-class words; those of all languages count where it is null or has no list.
    """
    if not text or not text.strip():
        return []
    whole = text
    if "<" in text or "\\" in text or "{{" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    thai = len(_HAS_THAI.findall(text))
    if thai and thai * 3 > len(text):
        ends = _thai(text)
    else:
        ends = _general(text, (lang or "").split("-")[0].lower())
    n = len(text.rstrip())
    ends = [e for e in ends if e <= n]
    last = ends[-1] if ends else 0
    if last < n:
        if last and _TAIL.match(whole, last):
            pass
        elif any(c.isalnum() for c in text[last:n]):
            ends.append(n)
        elif ends:
            ends[-1] = n
    return ends


def _thai(text: str) -> list[int]:
    ends = []
    for m in _SPACE.finditer(text):
        i, j = m.span()
        if i == 0 or j == len(text):
            continue
        left, right = text[i - 1], text[j]
        if right in "([,;:" or left in "([,;:":
            continue
        if "฀" > left and "฀" > right and (left.isalpha() or left == ".") and right.isalpha():
            word = text[:i].rsplit(None, 1)[-1]
            if _INITIAL_LEFT.search(word) and not re.search(r"\.[A-Z]\.$|[a-z0-9]\.$", word):
                continue
            tail = _LATIN_LEFT.search(word)
            latin = re.search(r"[A-Za-zÀ-ÿ0-9.\-_]*$", word).group()
            if tail and "." not in latin and not any(c.isdigit() for c in latin) and latin[:1].isupper() and right.isupper():
                before = text[:i][: -len(latin)].rstrip() if latin else ""
                closed = before != text[:i][: -len(latin)] and (_INITIAL_LEFT.search(before) or _second_name(before))
                if not closed:
                    continue
        elif left.isdigit() and right.isascii() and right.isalpha():
            continue
        ends.append(i)
    return ends


def _second_name(before: str) -> bool:
    """Is what precedes the space before a name already the name's first word?"""
    word = re.search(r"[A-Za-zÀ-ÿ0-9.\-_]*$", before).group()
    return bool(word) and word[:1].isupper() and "." not in word and not any(c.isdigit() for c in word)


def _general(text: str, lang: str) -> list[int]:
    never, closed = ABBREVIATIONS.get(lang, ANY_LANGUAGE), CLOSED_CLASS.get(lang, CLOSED_IN_ANY)
    cjk = bool(_HAS_CJK.search(text)) and len(_HAS_CJK.findall(text)) * 4 > len(text)
    deva = not cjk and bool(_HAS_DEVA.search(text))
    quotes = [m.span() for m in _QUOTE.finditer(text)]
    brackets = [m.span() for m in _BRACKET.finditer(text)] if ("(" in text or "（" in text or "[" in text or "【" in text) else []
    ends: list[int] = []
    start = 0
    qi = bi = 0
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        if at < start:
            continue
        end = m.end()
        while qi < len(quotes) and quotes[qi][1] <= at:
            qi += 1
        while bi < len(brackets) and brackets[bi][1] <= at:
            bi += 1
        if bi < len(brackets) and brackets[bi][0] < at:
            continue
        if qi < len(quotes) and quotes[qi][0] < at < quotes[qi][1]:
            a, b = quotes[qi]
            if b > end + (text[end : end + 1] == "“") or not (text[b - 1] in "”“」』»\"" and b - a > 1):
                continue
            end = b
            if _quotation_goes_on(text, start, a, b, cjk, deva):
                continue
        else:
            k = qi
            while k < len(quotes) and quotes[k][0] < end:
                if quotes[k][0] > at:
                    end = quotes[k][0]
                k += 1
            if not _ends(text, at, text[at:end], end, cjk, deva, never, closed):
                continue
        if not any(c.isalnum() for c in text[start:end]):
            continue
        ends.append(end)
        start = end
    return ends


def _quotation_goes_on(text: str, start: int, a: int, b: int, cjk: bool, deva: bool) -> bool:
    rest = text[b:].lstrip()
    if not rest:
        return False
    c = rest[0]
    if text[b - 1] == "」":
        return c not in "「『\n" and not c.isupper() or c in "とと"
    if c in ",，、;；:：":
        return True
    if c.islower() and not _CAMEL.match(rest):
        return True
    opened = not text[start:a].strip()
    return opened and (cjk or deva) and c not in "“„\"「"


def _ends(text: str, at: int, mark: str, end: int, cjk: bool, deva: bool, never: frozenset[str], closed: frozenset[str]) -> bool:
    first = text[at]
    if first != ".":
        if first in _OWN_TERMS:
            return not (text[end : end + 1] and text[end : end + 1] in "，、；،؛")
        rest = text[end:]
        stripped = rest.lstrip()
        if not stripped:
            return True
        c = stripped[0]
        return not (c.islower() and not _CAMEL.match(stripped)) and c not in ",;:，；"
    if mark.startswith(".."):
        return not text[end:].strip()
    rest = text[end:]
    stripped = rest.lstrip()
    if not stripped:
        return True
    if cjk or (deva and ((at and text[at - 1] >= "ऀ") or not rest[0].isspace())):
        return False
    c = stripped[0]
    if c in ",;:，；、）)":
        return False
    word = _WORD_BEFORE.search(text[max(0, at - 40) : at]).group()
    low = word.lower().lstrip("-–—")
    if rest[0].isspace() or mark[-1] not in ".":
        gap = rest[: len(rest) - len(stripped)]
        unit = low in UNITS and _NUMBER_BEFORE.search(text[max(0, at - 40) : at])
        if not unit and (low in never or (len(word) == 1 and word.isupper())):
            return False
        if c == "[" or c in "-–—" or c == "(":
            return "\n" in gap and bool(_FURNITURE.match(stripped))
        if c.islower():
            return bool(_CAMEL.match(stripped))
        if c.isdigit():
            return not deva
        nxt = _NEXT_WORD.match(stripped)
        if word.isdigit() and nxt and nxt.group() in MONTHS:
            return False
        if deva and "ऀ" <= c <= "ॿ":
            return False
        return True
    if c.isdigit() or not (c.isupper() or c in "\"“„" or _CAMEL.match(stripped)):
        return False
    if c in "\"“„":
        return bool(word) and (word[-1].islower() or word[-1].isdigit())
    nxt = _NEXT_WORD.match(stripped)
    after = stripped[nxt.end() :] if nxt else ""
    if not nxt or not after or not (after[0].isspace() or after[0] == ","):
        return False
    if len(nxt.group()) < 2 or low in never or (len(word) == 1 and word.isupper()):
        return False
    if nxt.group().lower() in closed:
        return True
    if _CAMEL.match(stripped):
        return word[-1:].islower()
    previous = _PREVIOUS_WORD.search(text[max(0, at - 80) : at])
    if previous and previous.group(1).lower() in BEFORE_IDENTIFIER and word[:1].isupper():
        return False
    if word[:1].isupper() and "." in word:
        return False
    return word[-1:].islower() or word[-1:].isdigit() or word[-1:] in ")]"


def sentences(text: str | None, lang: str | None = None) -> list[str]:
    """The sentences of ``text`` without surrounding space."""
    out, start = [], 0
    for e in sentence_ends(text, lang):
        out.append(text[start:e].strip())
        start = e
    return out


def split_table(df: DataFrame, keys: list[str], text: str, lang: str | None = None) -> DataFrame:
    """``*keys, sentence_no, end_char``: one row per sentence of the column ``text``.

    Null, empty and blank texts give no row; repeated rows are split again; a record of any
    length is split whole.  Only ``keys``, ``text`` and ``lang`` are read, other columns are
    pruned.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", sentence_no int, end_char int"
    n = len(keys)

    def run(rows):
        for row in rows:
            for i, e in enumerate(sentence_ends(row[n], row[n + 1]), 1):
                yield (*row[:n], i, e)

    picked = df.select(*keys, F.col(text).alias("__text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("__lang"))
    return map_rows(picked.where(F.length(F.trim("__text")) > 0), run, schema)
