"""Visually identical text with different characters.

``fold`` brings compatibility forms, accents, spaces, hyphens and invisible characters to
one form.  Look-alike letters of other scripts are repaired per token: the token's dominant
script is determined, the letters of other scripts are substituted in tokens of mixed script,
and the substitution holds only where its result occurs in the corpus vocabulary (as a clean
token, or as the result of repairing a differently damaged token).  A token wholly of
look-alikes is mixed with its text instead: it is repaired only in a text that holds no
letter of the token's script without a Latin twin, so words of a text in that script stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows
from inkweave.sources.scratch import cut

# Letters of the same shape, Latin on the right.
CYRILLIC = dict(zip("асԁеһіјӏоԛрѕѵԝхугкАВСԌЕНІЈКМОԚРЅТѴԜХУҮЅӀ", "acdehijloqpsvwxyrkABCGEHIJKMOQPSTVWXYYSI"))
GREEK = dict(zip("αγικνορυϲϳωΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ayiknopucjwABEZHIKMNOPTYXC"))
ARMENIAN = dict(zip("օոսհցզՍՕԼ", "onuhgqUOL"))
LATIN_FORMS = dict(zip("ɡɑɩ", "gai"))
TO_LATIN = CYRILLIC | GREEK | ARMENIAN | LATIN_FORMS
TO_SCRIPT = {
    "CYRILLIC": {v: k for k, v in reversed(CYRILLIC.items())},
    "GREEK": {v: k for k, v in reversed(GREEK.items())},
}

#: Parts into which the units of one text are split when pairs are expanded.
SALT = 8

_TOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_FOREIGN = re.compile("[" + "".join(map(re.escape, TO_LATIN)) + "]")
#: The same class for the JVM, which picks the few texts that need token repair.
FOREIGN_JVM = "[Ͱ-ϿЀ-ԯ԰-֏ɑɡɩ]"
#: Texts whose folded tokens may differ from the tokens the JVM sees.
UNFOLDED_JVM = "[\u00ad\u0300-\u036f\u180e\u2000-\u200f\u202a-\u206f\u2100-\u218f\u2e80-\u2fdf\ufb00-\ufb4f\ufe00-\ufe0f\ufe50-\ufe6f\ufeff\uff0d-\uff5a]"
#: Tokens of a text as the JVM sees them, in the folded form of clean tokens.
TOKEN_JVM = r"[\p{L}\p{M}\p{N}]+(?:[-'][\p{L}\p{M}\p{N}]+)*"

_SPACES = re.compile(r"[^\S\n]+")
_HYPHENS = dict.fromkeys((0x2010, 0x2011, 0xFE63, 0xFF0D), "-")
_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)])
_MAP = _HYPHENS | _INVISIBLE
_SOFT_BREAK = re.compile("­[^\\S\\n]*(?=\\n)")
_RAISED = {
    c: chr(0xE000 + i)
    for i, c in enumerate(chr(n) for n in range(0x80, 0x2100) if unicodedata.decomposition(chr(n)).startswith(("<super>", "<sub>")))
}
_RAISED_IN = re.compile("[" + "".join(_RAISED) + "]")
_RAISED_OUT = {ord(v): k for k, v in _RAISED.items()}


def fold(text: str) -> str:
    """One form for everything but look-alike letters; raised and lowered signs stay apart."""
    if text.isascii():
        return _SPACES.sub(" ", text).strip(" ")
    text = _SOFT_BREAK.sub("-", text).translate(_MAP)
    raised = _RAISED_IN.search(text)
    if raised:
        text = _RAISED_IN.sub(lambda m: _RAISED[m.group()], text)
    text = unicodedata.normalize("NFKC", text).translate(_MAP)
    if raised:
        text = text.translate(_RAISED_OUT)
    return _SPACES.sub(" ", text).strip(" ")


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ", 1)[0]


def candidate(token: str) -> str | None:
    """The token with the letters of other scripts substituted, or None where nothing applies.

    The dominant script is that of most letters; where every letter has a Latin look-alike,
    ties and look-alike scripts among themselves go to Latin.
    """
    if not _FOREIGN.search(token):
        return None
    bases = [c for c in unicodedata.normalize("NFD", token) if c.isalpha()]
    scripts = Counter(_script(c) for c in bases)
    if all(_script(c) == "LATIN" or c in TO_LATIN for c in bases):
        table = TO_LATIN
    else:
        main = max((s for s in scripts if s in TO_SCRIPT), key=lambda s: scripts[s], default=None)
        if main is None:
            if any(_script(c) in ("CJK", "HIRAGANA", "KATAKANA", "DEVANAGARI", "THAI") for c in bases):
                table = TO_LATIN
            else:
                return None
        else:
            table = TO_SCRIPT[main]
    out = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", token)))
    return out if out != token else None


def candidates(folded: str) -> dict[str, str]:
    """Token -> substitution of the tokens of a folded text that are of mixed script, or stand in a text of another script."""
    out: dict[str, str] = {}
    at_home: dict[str, bool] = {}
    for token in set(_TOKEN.findall(folded)):
        c = candidate(token)
        if c is None:
            continue
        scripts = {_script(x) for x in unicodedata.normalize("NFD", token) if x.isalpha()}
        if len(scripts) == 1:
            script = scripts.pop()
            if script not in at_home:
                at_home[script] = any(_script(x) == script and x not in TO_LATIN for x in unicodedata.normalize("NFD", folded) if x.isalpha() and not x.isascii())
            if at_home[script]:
                continue
        out[token] = c
    return out


def repair(text: str, accepted: dict[str, str]) -> str:
    """``fold``, with the accepted tokens substituted."""
    folded = fold(text)
    return _TOKEN.sub(lambda m: accepted.get(m.group(), m.group()), folded) if accepted else folded


def accepted_tokens(texts: DataFrame, text: str) -> DataFrame:
    """``token, candidate`` of the repairs that the vocabulary of all ``texts`` bears out."""

    def run(rows):
        for (t,) in rows:
            yield from candidates(fold(t)).items()

    damaged = texts.where(F.col(text).rlike(FOREIGN_JVM)).select(text)
    pairs = map_rows(damaged, run, "token string, candidate string").groupBy("token", "candidate").agg(F.count("*").alias("n"))
    wanted = pairs.groupBy("candidate").agg(F.count("*").alias("forms"))

    def folded(rows):
        for (t,) in rows:
            for token in set(_TOKEN.findall(fold(t))) - set(_TOKEN.findall(t)):
                yield (token,)

    known = (
        texts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_JVM), 0))).alias("candidate"))
        .unionByName(map_rows(texts.where(F.col(text).rlike(UNFOLDED_JVM)).select(text), folded, "candidate string"))
        .join(wanted.select("candidate"), "candidate", "left_semi")
        .distinct()
        .select("candidate", F.lit(True).alias("clean"))
    )
    good = wanted.join(known, "candidate", "left").where(F.col("clean") | (F.col("forms") > 1)).select("candidate")
    return pairs.join(good, "candidate", "left_semi").select("token", "candidate")


def canonical(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, canonical``: the consistent form of each text.

    ``id_col`` is unique.  A null text gives null, an empty or blank one the empty string; a
    text is processed whole whatever its length; other columns are ignored.
    """
    base = texts.select(F.col(id_col).alias("id"), F.col(text).alias("t"))

    def tokens(rows):
        for i, t in rows:
            for token in candidates(fold(t)):
                yield i, token

    id_type = base.schema["id"].dataType.simpleString()
    damaged = base.where(F.col("t").rlike(FOREIGN_JVM))
    found = map_rows(damaged, tokens, f"id {id_type}, token string").join(accepted_tokens(base, "t"), "token")
    fixes = found.groupBy("id").agg(F.collect_list("token").alias("a"), F.collect_list("candidate").alias("b"))

    def run(rows):
        for i, t, a, b in rows:
            yield i, None if t is None else repair(t, dict(zip(a, b)) if a else {})

    return map_rows(base.join(fixes, "id", "left"), run, f"`{id_col}` {id_type}, canonical string")


def canonical_fields(members: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``*keys, canonical``: the consistent form of the texts of all fields, by one vocabulary.

    Equal texts are one row until the forms are known; repeated rows give one row, null texts null.
    """
    m = members.select(*keys, F.md5(text).alias("h"), F.col(text).alias("t"))
    texts = m.where(F.col("h").isNotNull()).groupBy("h").agg(F.first("t").alias("t"))
    return m.drop("t").distinct().join(canonical(texts, "h", "t"), "h", "left").select(*keys, "canonical")


def _nodes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``field, unit_id, h, text`` that are compared, and ``h, k`` of each distinct text: its hash and its form's."""
    m = members.where(F.col("text").rlike(r"[\p{L}\p{N}]") & F.col("unit_id").isNotNull()).select("field", "unit_id", F.md5("text").alias("h"), "text")
    texts = m.groupBy("h").agg(F.first("text").alias("text"))
    return m, cut(canonical(texts, "h", "text").select("h", F.md5("canonical").alias("k")))


def alike_classes(members: DataFrame) -> DataFrame:
    """``field, unit_id, class, spellings, units``: one row per unit whose text is printed like a different string.

    ``class`` is the smallest unit of the class in the field, ``spellings`` the number of its
    different strings.  A class of any size gives one row per unit; the pairs of ``alike_pairs``
    are those of one class with different strings.
    """
    m, keyed = _nodes(members)
    per = m.select("field", "unit_id", "h").distinct().join(keyed, "h")
    classes = per.groupBy("field", "k").agg(F.min("unit_id").alias("class"))
    spellings = per.select("field", "k", "h").distinct().groupBy("field", "k").agg(F.count("*").alias("spellings")).where("spellings > 1")
    units = per.select("field", "k", "unit_id").distinct().groupBy("field", "k").agg(F.count("*").alias("units"))
    found = classes.select("field", "k", "class").join(spellings, ["field", "k"]).join(units, ["field", "k"])
    return per.select("field", "k", "unit_id").distinct().join(found, ["field", "k"]).select("field", "unit_id", "class", "spellings", "units")


def alike_pairs(members: DataFrame) -> DataFrame:
    """``field, unit_a, unit_b`` of ``members(field, unit_id, text)``: equal in print, not in characters.

    Texts without a letter or digit and nulls aren't compared; repeated rows count once; a
    unit isn't paired with itself.  Equal texts are one node: the pairs are found between
    distinct texts and only then expanded to their units, as the result demands.
    """
    m, keyed = _nodes(members)
    many = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    nodes = keyed.join(many, "k", "left_semi")
    a, b = nodes.select("k", F.col("h").alias("ha")), nodes.select("k", F.col("h").alias("hb"))
    pairs = a.join(b, "k").where("ha < hb").select("ha", "hb")
    own = m.select("field", "unit_id", "h").distinct()
    left = own.select("field", F.col("unit_id").alias("ua"), F.col("h").alias("ha"), F.pmod(F.xxhash64("unit_id"), F.lit(SALT)).cast("int").alias("part"))
    right = own.select("field", F.col("unit_id").alias("ub"), F.col("h").alias("hb"))
    # The units of one text are split, so that no task expands all of a frequent text's pairs.
    parts = pairs.select("ha", "hb", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    spread = parts.join(left, ["ha", "part"]).withColumn("side", F.pmod(F.xxhash64("ua", "hb"), F.lit(SALT)).cast("int"))
    return (
        spread.join(right.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("side")).join(pairs.select("hb").distinct(), "hb", "left_semi"), ["hb", "field", "side"])
        .where("ua <> ub")
        .select("field", F.least("ua", "ub").alias("unit_a"), F.greatest("ua", "ub").alias("unit_b"))
        .distinct()
    )
