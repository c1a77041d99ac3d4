"""Defective prompt-response pairs; here a unit's source text and a record's target text.

Copies are found by aligning the two token sequences: containment of the target's shingles
in the source, and the longest common subsequence.  Refusals are found by aligning the
target's opening with templates of two pieces: the speaker declines, and what is declined.  Language and truncation compare scripts,
function words and closing marks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows
from inkweave.llm.markup import clean

SHINGLE = 3
CONTAINED = 0.8
LCS_SHARE = 0.8
ENOUGH_WORDS = 2

# Stand-ins for a missing answer.
STAND_INS = frozenset(
    "todo tbd n/a na null none nil xxx fixme pending untranslated 无 （无） (无) 暂无 空 待译 [待译] 【待译】 待补 <待补> 待翻译 未翻译 未訳 未翻訳 なし leer offen अनुवाद शेष รอแปล".split()
)
# The two pieces of a refusal, by language: the speaker declines, and what is declined.
DECLINING = {
    "en": "i cannot|i could not|i am sorry i can|i can not|i can t|i am unable|i m unable|i am not able|i m not able|i won t|i will not|i must decline|i have to decline|i decline|i refuse|i must refuse|cannot be translated by me|i m afraid i can|i don t feel able",
    "de": "kann ich … nicht|ich kann … nicht|darf ich … nicht|ich darf … nicht|ich werde … nicht|werde ich … nicht|muss ich … ablehnen|ich muss … ablehnen|ich lehne … ab|ich bin nicht in der lage|bin ich nicht in der lage|ist mir nicht möglich",
    "fr": "je ne peux|je ne suis pas en mesure|je dois refuser|je refuse|je ne saurais",
    "es": "no puedo|no me es posible|debo rechazar|no estoy en condiciones|me niego",
    "it": "non posso|non sono in grado|devo rifiutare",
    "pt": "não posso|não consigo|devo recusar|recuso",
    "zh": "我无法|我不能|我没法|我没有办法|我拒绝|我必须拒绝|我只能拒绝|恕我不能|恕我无法|我不便",
    "ja": "できません|できかねます|お応えできません|お断り|致しかねます|いたしかねます|ご遠慮",
    "hi": "नहीं कर सकता|नहीं कर सकती|नहीं कर पाऊँगा|असमर्थ हूँ|स्वीकार नहीं|मना करना|मदद नहीं",
    "th": "ฉันไม่สามารถ|ฉันแปล|ฉันขอปฏิเสธ|ผมไม่สามารถ|ไม่สามารถช่วย|ขอปฏิเสธ|แปลข้อความนี้ไม่ได้",
}
DECLINED = {
    "en": "translate|translated|translating|translation|rendering|help|assist|request|this content|this text|this passage|this unit|this task|provide|comply|fulfil|fulfill",
    "de": "übersetzen|übersetzung|helfen|anfrage|bitte|text|aufgabe|inhalt|abschnitt|weiterhelfen|wiedergabe",
    "fr": "traduire|traduction|aider|demande|texte|passage|contenu",
    "es": "traducir|traducción|ayudar|ayudarte|solicitud|texto|contenido|pasaje",
    "it": "tradurre|traduzione|aiutare|aiutarti|richiesta|testo|contenuto",
    "pt": "traduzir|tradução|ajudar|pedido|texto|conteúdo",
    "zh": "翻译|译文|协助|帮助|处理|请求|提供|内容|文本|任务",
    "ja": "翻訳|訳|ご依頼|依頼|お手伝い|リクエスト|文章|要求",
    "hi": "अनुवाद|मदद|सहायता|अनुरोध|अंश|पाठ",
    "th": "แปล|ช่วย|คำขอ|ข้อความ|คำแปล",
}
# What may stand before the speaker declines.
APOLOGY = re.compile(
    r"(?:i m sorry|i am sorry|sorry|unfortunately|i apologi[sz]e|my apologies|regrettably|as an? [a-z ]{0,40}?(?:assistant|model)|this content|but|es tut mir leid|aber|leider|entschuldigung|tut mir leid|diesen text|diese anfrage|dabei|das|als [a-zäöüß ]{0,40}?(?:assistent|modell)|"
    r"je suis désolée?|désolée?|malheureusement|mais|lo siento|lamentablemente|pero|mi dispiace|purtroppo|ma|desculpe|infelizmente|mas|抱歉|很抱歉|非常抱歉|对不起|很遗憾|遗憾的是|不好意思|作为(?:一个|一名)?[^我]{0,12}?(?:助手|模型)|但是?|"
    r"申し訳ありませんが|申し訳ございませんが|恐れ入りますが|すみませんが|残念ながら|この(?:文章|ご依頼|テキスト|リクエスト)[はにを]|ご依頼[のにを]?|翻訳[はを]?|お手伝い|क्षमा करें|माफ़ कीजिए|खेद है|मैं|मुझे खेद है|किंतु|लेकिन|पर |इस|अनुरोध को|अंश का|अनुवाद|ขออภัย|ขอโทษ|เสียใจ)\s*"
)

# Notes of uncertainty that decline.
DECLINES = re.compile(r"\b(?:declined|refused|refusal|refuses)\b|拒绝|拒訳|翻訳を拒否|abgelehnt|verweigert|अस्वीकार|ปฏิเสธ", re.I)
# Function words by language, for Latin script.
FUNCTION_WORDS = {
    "en": frozenset("the and of is it its every once neither nor why does on in as for this by with through because since before until not which that to a an or at".split()),
    "fr": frozenset("le la les et est une des du que qui dans pour pas sur avec sont ce cette aux par plus mais ou leur nous vous il elle".split()),
    "es": frozenset("el la los las y es una del que en por con para no se su al lo como más pero sus este esta son".split()),
    "it": frozenset("il lo gli e è una di che nel per con non sono della delle dei si come più ma questo questa anche".split()),
    "pt": frozenset("o os as e é uma do da dos das que em por com para não se ao como mais mas este esta são".split()),
    "nl": frozenset("de het een en is van dat die niet op te zijn voor met aan ook als maar bij deze door wordt".split()),
    "de": frozenset("der die das und ist sind nicht alle sobald weder noch warum brauchen wie laut weil ihre sie über unter um den dem mit von bei ab vor bis gilt oder usw beim im in auf innerhalb".split()),
}

_WRAP = re.compile(r"[-‐­¬][ \t]*\n\s*(?=[a-zà-ÿ])")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[฀-๿]{1,3}|[^\W_]+")
_IDENTIFIER = re.compile(r"[A-Za-z]+\d[\w.]*|\d[\w.,:–-]*|\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b\w+(?:\.\w+)+\b|\b[A-Z]{2,}(?:-\d+)?\b")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­᠎]")
_SCRIPTS = (
    ("han", re.compile("[㐀-鿿]")),
    ("kana", re.compile("[぀-ヿ]")),
    ("deva", re.compile("[ऀ-ॿ]")),
    ("thai", re.compile("[฀-๿]")),
)
_ELSEWHERE = (("ru", re.compile("[Ѐ-ԯ]")), ("ar", re.compile("[؀-ۿ]")), ("ko", re.compile("[가-힣]")), ("el", re.compile("[Ͱ-Ͽ]")), ("he", re.compile("[֐-׿]")))
_WORD = re.compile(r"(?<![\w.])[a-zà-öø-ÿß]{2,}(?![\w]|\.\w)")
_TERMINAL = re.compile(r"(?:[.!?。！？।…])[\"'”’“»」』）)\]】*_~`]*\s*$")
_STRUCTURE = re.compile(r"\n\s*(?:\||\{\||```|- |\* |\$\$|<table|<ul|\\begin|\\\[|>\s*\n|> \*\*|\[\[)")
_FORMULA = re.compile(r"\s*(?:\$[^$\n]+\$|\\\([^\n]*?\\\))\s*$")
_CITE = re.compile(r"(?:~?\\(?:cite|ref|label)\{[^{}]*\}?|\{\{cite[^{}]*\}?\}?|<!--.*?(?:-->|$)|</?[a-z][^<>]*>|\[\[Category:[^\]]*\]\]|\s)+$", re.I | re.S)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(_WRAP.sub("", text).casefold())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for x in b:
        m = where.get(x, 0)
        u = s & m
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def _shingles(t: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(t))
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}


def is_copy(source: str, target: str) -> bool:
    """The target repeats the source; what is only names, numbers and identifiers may stay."""
    a, b = tokens(source), tokens(target)
    if not a or not b:
        return False
    if len(_ordinary(source)) < 1:
        return False
    if a == b:
        return True
    sb, sa = _shingles(b), _shingles(a)
    if len(sb) < 3 or len(sb & sa) < 0.4 * len(sb):
        return False
    if len(_ordinary(target)) < ENOUGH_WORDS:
        return False
    return len(sb & sa) >= CONTAINED * len(sb) or lcs(a, b) >= LCS_SHARE * len(b)


def _ordinary(text: str) -> list[str]:
    """Words that a translator would have translated, or letters of a script without spaces."""
    t = _IDENTIFIER.sub(" ", text)
    out = [w for w in re.findall(r"[^\W\d_]+", t) if len(w) > 1 ]
    return [w for w in out if not re.fullmatch(r"ms|mm|nm|kHz|kPa|GB|MB|dB|ns", w)]


_OPENING = re.compile(r".*?(?:[.!?。！？।…\n]|$)", re.S)
_PUNCTUATION = re.compile(r"[^\w\u0900-\u097f\u0e00-\u0e7f]+")
#: Characters of other text, besides apologies, that a refusal may begin with; and of what is declined.
BEFORE_REFUSAL, DECLINED_FIRST = 3, 16


def _piece(piece: str, spaced: bool) -> str:
    """A piece as a pattern; ``…`` stands for words between its parts."""
    body = r"\b.*?\b".join(map(re.escape, piece.split(" … "))) if spaced else re.escape(piece)
    return rf"(?<![^\W_]){body}(?![^\W_])" if spaced else body


def _alternatives(pieces: str, language: str, ends: bool) -> re.Pattern[str]:
    spaced = language not in ("zh", "ja", "th", "hi")
    out = "|".join(_piece(x, spaced) for x in pieces.split("|"))
    return re.compile(out if ends else out.replace("(?![^\\W_])", ""))


_BY_LANGUAGE = [(_alternatives(DECLINING[k], k, k != "en"), _alternatives(DECLINED[k], k, False)) for k in DECLINING]


def is_refusal(target: str) -> bool:
    """The speaker declines at the beginning of the target, and names what: two pieces in one sentence.

    The pieces are aligned with the opening sentence (and the next, where the first is only an
    apology); what follows may have any length.
    """
    text = target
    for _ in range(2):
        sentence = _OPENING.match(text).group()
        text = text[len(sentence) :]
        plain = " ".join(_PUNCTUATION.sub(" ", sentence.casefold()).split())
        for declining, declined in _BY_LANGUAGE:
            m = declining.search(plain)
            if m and declined.search(plain):
                opening = plain[: m.start()].strip()
                before = _unapologetic(opening)
                # In languages that put the verb last, what is declined stands first, behind an apology.
                if len(before) <= BEFORE_REFUSAL or len(before) <= min(DECLINED_FIRST, len(opening) - 1) and declined.search(before):
                    return True
        if _unapologetic(plain):
            return False
    return False


def _unapologetic(text: str) -> str:
    while text and (m := APOLOGY.match(text)):
        text = text[m.end() :].strip()
    return text


def main_language(text: str) -> tuple[str | None, float]:
    """The language most of the text is in, and how many letters or words speak for it."""
    if not text.isascii():
        letters = sum(map(str.isalpha, text))
        for name, p in _ELSEWHERE:
            n = len(p.findall(text))
            if 2 * n > letters:
                return name, n
    counts = {name: len(p.findall(text)) for name, p in _SCRIPTS}
    words = _WORD.findall(text)
    latin = sum(map(len, words)) * 0.4
    top = max(counts, key=counts.get)
    cjk = counts["han"] + counts["kana"]
    if cjk >= max(counts["deva"], counts["thai"], latin) and cjk:
        return ("ja" if counts["kana"] * 5 > cjk else "zh"), cjk
    if counts[top] > latin and top in ("deva", "thai"):
        return ("hi" if top == "deva" else "th"), counts[top]
    if not words:
        return None, 0
    votes = {k: sum(w in v for w in words) for k, v in FUNCTION_WORDS.items()}
    best = max(votes, key=votes.get)
    if votes[best] == 0 or sum(v == votes[best] for v in votes.values()) > 1:
        return None, 0
    return best, votes[best] * 2


def ends_whole(text: str) -> bool:
    return bool(_TERMINAL.search(text[-24:])) or text.rstrip()[-1:] in "”」" or text.rstrip()[-1:] == '"' and text.count('"') % 2 == 0 or text.rstrip()[-1:] == "“" and "„" in text


def body(target: str) -> str:
    """The running text of a record: without markup around it and structures after it."""
    if any(c in target for c in "<\\{`*_#=|~&["):
        cut = _STRUCTURE.search(target, 1)
        if cut and cut.start() > 0 and ends_whole(_CITE.sub("", target[: cut.start()])):
            target = target[: cut.start()]
        target = _FORMULA.sub("", _CITE.sub("", target))
        target = clean(target) or ""
    return target


def defect(source: str | None, target: str | None, uncertainties: list[str] | None, language: str | None, kind: str | None = None) -> str | None:
    """The defect of one pair: empty, truncated, refusal, copy, language, or None."""
    plain = _INVISIBLE.sub("", target or "").strip()
    low = plain.casefold().strip(" .。[]【】<>()（）")
    declined = any(u and DECLINES.search(u) for u in uncertainties or ())
    if not any(c.isalnum() for c in plain) or plain.casefold() in STAND_INS or low in STAND_INS:
        return "refusal" if declined else "empty"
    source = source or ""
    want = (language or "").split("-")[0].lower()
    judged = kind not in ("code", "equation", "table", "figure", "bibliography")
    if is_refusal(plain) and not is_refusal(source):
        return "refusal"
    text = body(plain)
    if kind == "table":
        return "copy" if tokens(source) == tokens(plain) and _ordinary(source) else None
    if is_copy(source, text) or text != plain and is_copy(source, plain):
        return "copy"
    if want and judged:
        got, weight = main_language(text)
        if got == "zh" and want == "ja" and _SCRIPTS[1][1].search(text):
            got = "ja"
        if got and got != want and weight >= (4 if got in FUNCTION_WORDS else 3):
            return "language"
    if judged and want != "th" and ends_whole(source.strip()):
        text = text.strip()
        if not ends_whole(text) or _left_open(source, text):
            return "truncated"
    return None


def _left_open(source: str, text: str) -> bool:
    """Does the last quotation of the text lack its end, though the text has terminators?"""
    for a, b in (("“", "”"), ("「", "」"), ("„", "“")):
        if a in text and not (a == "“" and "„" in text) and text.rfind(a) > text.rfind(b):
            return True
    return '"' in text and text.count('"') % 2 == 1 and source.count('"') % 2 == 0


def defects(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, defect`` of the defective rows of ``pairs``.

    ``pairs`` holds ``source_text, target_text, uncertainties, language, kind`` beside the
    keys.  A null or blank target is ``empty``; a null source is one without content; null
    ``uncertainties`` have no entry; repeated rows are judged again and give equal rows.
    """
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", defect string"
    n = len(keys)

    def run(rows):
        for row in rows:
            d = defect(*row[n:])
            if d:
                yield (*row[:n], d)

    picked = pairs.select(*keys, "source_text", "target_text", F.col("uncertainties"), "language", "kind")
    return map_rows(picked, run, schema).distinct()
