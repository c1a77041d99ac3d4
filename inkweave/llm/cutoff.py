"""Texts cut off by field limits.

Every intact value is cut artificially to make a positive; a hashed logistic regression is
trained on closing characters, punctuation, structure and length-to-limit features of all
of them; every record is scored.  The corpus gives two statistics over all rows: how much
the lengths of a source pile up at a record's length (in characters and in bytes), and how often a closing
line stands as a whole line elsewhere.  Texts are read once for their narrow closing
features, as they are and cut, and once for their lines; no text is shuffled.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows
from inkweave.sources.scratch import cut

#: Half of the rows in a part of the documents that is fitted at once; the parts' weights are averaged.
TRAIN_ROWS = 6000
#: Steps of one in which weights are summed, exactly in any order.
STEPS = 1 << 20
DIMENSIONS = 1 << 13
EPOCHS = 12
#: Neighbouring lengths against which a pile-up is measured, and the least pile-up.
NEAR, PILE = 40, 6.0
#: Probability from which a text counts as cut; few texts lie near it.
THRESHOLD = 0.35
#: Length below which the model calls a closing line short; lines of every length are looked up.
SHORT_LINE = 90
#: Pile-ups that are broadcast at most.
BROADCAST_PILES = 200_000
#: Parts into which the documents of one closing line are split.
SALT = 8

#: Signs that mark a cut, in runs; and other markers, at most 13 characters each.
_MARKS = ".…�"
_MARKER = re.compile(r"(?:\[(?:\.\.\.|…)\]|\[?\(?(?:truncated|cut|more|gekürzt)\)?\]?)\Z", re.I)
_TERMINALS, _CLOSERS = ".!?。！？।؟", "\"'”’“»」』）)]】*_"
_THAI = re.compile("[฀-๿]")
_STRUCTURES = (
    ("table", re.compile(r"\|.*\|$")),
    ("item", re.compile(r"(?:[-*+•]|\d+[.)])\s+\S")),
    ("signature", re.compile(r"[—–-]{1,2}\s*\S")),
    ("link", re.compile(r"\S*https?://\S+$")),
    ("code", re.compile(r".*[;{}>]$|.*\bFROM \w+|\s+return\b|.*\w\(\w*\)$|.* [*+<>=]+ \d+$")),
    ("contents", re.compile(r".*[:：].*\d+(?:, ?\d+)+$")),
)
_OPEN = (("(", ")"), ("（", "）"), ("[", "]"), ("“", "”"), ("「", "」"), ("„", "“"))


def _kind(c: str) -> str:
    o = ord(c)
    if c.isdigit():
        return "9"
    if 0x0E00 <= o < 0x0E80:
        return "T"
    if 0x0900 <= o < 0x0980:
        return "D"
    if 0x3040 <= o < 0x3100:
        return "K"
    if 0x3400 <= o < 0xA000:
        return "H"
    if c.isalpha():
        return "A" if c.isupper() else "a"
    return "_" if c.isspace() else c


def _marked(text: str) -> tuple[int, str]:
    """Where the markers at the end of ``text`` begin, with the space before, and the first one's first sign."""
    end, first = len(text), "none"
    while True:
        while end and text[end - 1].isspace():
            end -= 1
        start, last = end, text[end - 1 : end]
        if last and last in _MARKS:
            while start and text[start - 1] == last:
                start -= 1
            if last == "." and end - start < 2:
                return end, first
        else:
            m = _MARKER.search(text[max(0, end - 13) : end])
            if not m:
                return end, first
            start -= len(m.group())
        end, first = start, text[start]


def _ended(text: str) -> bool:
    last = text.rstrip(_CLOSERS)[-1:]
    return bool(last) and last in _TERMINALS


def closing(text: str) -> list[str]:
    """What the end of a text shows by itself; the whole last paragraph counts."""
    text = text.rstrip()
    end, mark = _marked(text)
    bare = text[:end]
    paragraph = text.rsplit("\n\n", 1)[-1]
    line = paragraph.rsplit("\n", 1)[-1]
    kinds = "".join(map(_kind, bare[-4:]))
    ended = _ended(bare)
    structure = next((n for n, p in _STRUCTURES if p.match(line)), "none")
    words = re.findall(r"[^\W\d_]+", line)
    unclosed = any(paragraph.count(a) > paragraph.count(b) for a, b in _OPEN if not (a == "“" and "„" in paragraph))
    short = len(line) < SHORT_LINE and paragraph.count("\n") == 0
    return [kinds[-2:], str(ended), mark, structure, str(unclosed), str(short), f"{len(words) <= 4}|{line[:1].isupper()}", words[-1].casefold() if words else ""]


def features(shown: list[str], piled: bool, seen: int) -> list[str]:
    """Names of the features of a text whose end shows ``closing``."""
    kinds, ended, mark, structure, unclosed, short, shape, word = shown
    known = "0" if seen <= 1 else "few" if seen < 4 else "often"
    f = [
        f"last={kinds[-1:]}",
        f"last2={kinds}",
        f"ended={ended}",
        f"mark={mark}",
        f"mark|ended={mark}|{ended}",
        f"structure={structure}",
        f"structure|ended={structure}|{ended}",
        f"unclosed={unclosed}|{ended}",
        f"piled={piled}",
        f"piled|ended={piled}|{ended}|{structure != 'none'}",
        f"seen={known}|{short}|{ended}",
        f"seen|mark={known}|{short}|{mark}",
        f"alone={short}|{shape}|{ended}|{known}",
        f"script|ended={kinds[-1:]}|{ended}|{mark}",
        "bias",
    ]
    if word:
        f.append(f"word={word}|{ended}")
    return f


def _slots(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % DIMENSIONS for n in names]


def is_thai(text: str) -> bool:
    return len(_THAI.findall(text)) * 3 > len(text.strip() or " ")


def cut_at_random(key: str | None, text: str, seed: int = 7) -> tuple[list[str], bool, int] | None:
    """What an intact text shows if cut at a place that its key picks: (closing, piled, seen); None where it is whole there too."""
    t = text.rstrip()
    rnd = random.Random(zlib.crc32(f"{seed} {key}".encode()))
    head = t[: rnd.randrange(max(1, len(t) // 3), max(2, len(t)))]
    line = head.rsplit("\n", 1)[-1]
    if _ended(head.rstrip()) or head.endswith("\n") or any(p.match(line) for _, p in _STRUCTURES):
        return None
    mark = rnd.choice(("", "", "", "", "...", "…", "�", "�", " […]", "[...]", " (more)", " [truncated]"))
    # Half of the limits are taken to be ones at which the source's lengths pile up.
    return closing(head + mark), rnd.random() < 0.5, 0 if len(line) > 3 else 1


def fit(xs: list[list[int]], ys: list[float], seed: int = 7) -> list[float]:
    """Weights of the hashed features from the slots and labels of examples."""
    rnd = random.Random(seed)
    w = [0.0] * DIMENSIONS
    order = list(range(len(xs)))
    for epoch in range(EPOCHS):
        rnd.shuffle(order)
        rate = 0.3 / (1 + epoch)
        for k in order:
            x = xs[k]
            g = rate * (ys[k] - _p(sum([w[i] for i in x])))
            for i in x:
                w[i] += g - 1e-5 * w[i]
    return w


def _p(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _piles(narrow: DataFrame, size: str) -> DataFrame:
    """``source, size``: the lengths at which a source's texts pile up against the lengths near."""
    near = Window.partitionBy("source").orderBy(size).rangeBetween(-NEAR, NEAR)
    counted = narrow.groupBy("source", size).agg(F.count("*").alias("n"))
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    by = Window.partitionBy("source").orderBy(size)
    highest = F.greatest(*[F.coalesce(F.max("n").over(by.rangeBetween(a, b)), F.lit(0)) for a, b in ((-NEAR, -1), (1, NEAR))])
    counted = counted.withColumn("around", around).withColumn("highest", highest)
    return counted.where((F.col("n") >= 4) & (F.col("n") >= PILE * (F.col("around") + 0.3)) & (F.col("n") >= 3 * F.col("highest"))).select("source", size, F.lit(True).alias(f"piled_{size}"))


def _lines(docs: DataFrame) -> DataFrame:
    """``last, seen``: hashes of the lines that stand more than once in the corpus."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    return docs.select(F.explode(lines).alias("x")).groupBy(F.xxhash64(F.trim("x")).alias("last")).agg(F.count("*").cast("int").alias("seen")).where("seen > 1")


def _described(docs: DataFrame) -> DataFrame:
    """The documents that hold a letter or digit: what their ends show, and the intact ones' if they are cut."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(rows):
        for doc_id, key, source, chars, size, last, closed, marked, text in rows:
            thai = is_thai(text)
            closed = closed and not thai
            yield doc_id, source, chars, size, last, thai, closing(text), closed, marked, *(closed and cut_at_random(key, text) or (None, None, None))

    text = F.col("text")
    closed = text.rlike(r"(?:[.!?。！？।][\"'”’“»」)）\]]*|\n(?:- |\||— |https?:)[^\n]*|\n[^\n]*[;}>]|\n[^\n]{1,60})\s*$")
    marked = text.rlike(r"(?:\.\.|…|\])\s*$")
    last = F.xxhash64(F.trim(F.substring_index(F.rtrim("text"), "\n", -1)))
    picked = docs.where(text.rlike(r"[\p{L}\p{N}]")).select("doc_id", F.col("doc_id").cast("string").alias("key"), F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), last.alias("last"), closed.alias("closed"), marked.alias("marked"), "text")
    return map_rows(picked, run, f"doc_id {id_type}, source string, chars int, bytes int, last bigint, thai boolean, shown array<string>, closed boolean, marked boolean, cut_shown array<string>, cut_piled boolean, cut_seen int")


def _statistics(docs: DataFrame) -> DataFrame:
    """The described documents with ``piled`` and ``seen``, and whether they are ``intact``, written once."""
    narrow = cut(_described(docs))
    out = narrow
    for size in ("chars", "bytes"):
        piles = _piles(narrow, size).persist()
        few = piles.limit(BROADCAST_PILES + 1).count() <= BROADCAST_PILES
        out = out.join(F.broadcast(piles) if few else piles, ["source", size], "left")
    # A closing line may end a third of all texts: one row a line is looked up, then spread back.
    lines = _lines(docs).join(narrow.select("last").distinct(), "last", "left_semi")
    lines = lines.select("last", "seen", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(lines, ["last", "part"], "left")
    piled = F.coalesce("piled_chars", F.lit(False)) | F.coalesce("piled_bytes", F.lit(False))
    seen = F.coalesce("seen", F.lit(0))
    intact = F.col("closed") & ~piled & (~F.col("marked") | (seen > 3))
    return cut(out.select("doc_id", "source", "thai", "shown", piled.alias("piled"), seen.alias("seen"), intact.alias("intact"), "cut_shown", "cut_piled", "cut_seen"))


def _weights(table: DataFrame) -> list[float]:
    """Weights fitted on all intact texts, as they are and cut.

    The rows are dealt by hash to parts of about ``2 * TRAIN_ROWS`` documents.  Each part is
    fitted by itself, and a feature's weight is the mean over the parts, each counted as
    often as the feature is in it.  Repeated rows count once.
    """
    parts = max(1, math.ceil(table.count() / (2 * TRAIN_ROWS)))
    part = F.pmod(F.xxhash64("doc_id", "shown", F.lit("fit")), F.lit(parts)).cast("int")
    examples = table.where("intact").select(part.alias("part"), F.col("doc_id").cast("string").alias("key"), "shown", "seen", "cut_shown", "cut_piled", "cut_seen")
    dealt = examples.repartition(parts, "part").sortWithinPartitions(*examples.columns)

    def run(rows):
        for _, own in groupby(rows, itemgetter(0)):
            xs, ys = [], []
            for (_, _, shown, seen, cut_shown, cut_piled, cut_seen), _ in groupby(own):
                xs.append(_slots(features(shown, False, seen)))
                ys.append(0.0)
                if cut_shown is not None:
                    xs.append(_slots(features(cut_shown, cut_piled, cut_seen)))
                    ys.append(1.0)
            w = fit(xs, ys)
            for i, n in sorted(Counter(i for x in xs for i in x).items()):
                yield i, n, n * round(w[i] * STEPS)

    out = [0.0] * DIMENSIONS
    for i, n, w in map_rows(dealt, run, "slot int, n bigint, w bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():
        out[i] = w / n / STEPS
    return out


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, source, p_cut``: the probability that a document's text was cut off.

    Null, empty and blank texts, and texts without a letter or digit, aren't scored; texts in
    Thai score 0 (nothing marks their ends); a null source is a source of its own, reported
    as the empty string; repeated rows are scored again.  Ties need no order.  The model is
    fitted on all intact texts.
    """
    docs = docs.select("doc_id", "source", "text")
    table = _statistics(docs)
    weights = docs.sparkSession.sparkContext.broadcast(_weights(table))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        w = weights.value
        for doc_id, source, thai, shown, piled, seen in it:
            yield doc_id, source, _p(-30.0 if thai else sum(w[i] for i in _slots(features(shown, piled, seen))))

    return map_rows(table.select("doc_id", "source", "thai", "shown", "piled", "seen"), run, f"doc_id {id_type}, source string, p_cut double")


def cut_rates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``source, texts, cut_texts, cut_rate`` over all documents."""
    return scores(docs).groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("p_cut") > threshold).alias("cut_texts"),
        F.avg((F.col("p_cut") > threshold).cast("double")).alias("cut_rate"),
    )
