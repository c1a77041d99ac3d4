"""Evaluation texts leaking into training text.

Texts are reduced to their letters and digits.  Every item belongs to a length class, which
fixes the length of its windows, their stride in documents and how many bits are sampled how
often.  Windows of the items (at every offset) and of the documents (at the stride) are
embedded by CGK random walks, which turn edit distance into Hamming distance; repeated
bit-sampling of the embeddings gives LSH keys, so that windows within a small edit distance
meet in some repetition.  ``REPETITIONS`` meet the target recall ``TARGET``, which the tests
measure for each length class.  Pairs that meet are verified exactly: the matched passage must
cover the wanted share of the item at a bounded edit distance.

Documents are read once, whatever the number of items and classes.  Item keys below a checked
size are broadcast and looked up in that pass; more keys are joined with the documents' keys.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows

#: Recall wanted of the candidates in every length class.
TARGET = 0.9
#: Repetitions of the bit-sampling for short and for long windows, and the seed of all walks.
REPETITIONS, LONG_REPETITIONS, SEED = 4, 2, 1
#: Share of an item that must stand in the document, and the edit distance allowed in it.
SHARE = 0.5
EDITS = 0.25
#: Item keys that are broadcast at most (24 bytes each); beyond it keys are joined.
BROADCAST_KEYS = 2_000_000
#: Parts into which every key's documents are split for the join.
SALT = 8
#: Characters that a worker embeds at once.
BATCH_CHARS = 1_500_000

_TAG = re.compile(r"<[^<>\n]*>|&[A-Za-z]{2,8};|&#\d+;")
_CJK_RANGES = ((0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the one normalised character (0 where dropped), and whether it takes several."""
    one = np.zeros(0x11000, dtype=np.int32)
    many = np.zeros(0x11000, dtype=bool)
    for c in range(len(one)):
        if 0xD800 <= c < 0xE000:
            continue
        out = [x for x in unicodedata.normalize("NFKC", chr(c)).lower() if x.isalnum()]
        if len(out) > 1 or unicodedata.combining(chr(c)):
            many[c] = True
        elif out:
            one[c] = ord(out[0])
    return one, many


_ONE: list[np.ndarray] = []


def codes_of(text: str) -> np.ndarray:
    """Code points of the letters and digits only, without case, compatibility forms and markup tags."""
    if not _ONE:
        _ONE.extend(_letters())
    one, many = _ONE
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    if len(raw) and (int(raw.max()) >= len(one) or not text.isascii() and many[raw].any()):
        text = unicodedata.normalize("NFKC", text).lower()
        return np.array([ord(c) for c in text if c.isalnum()], dtype=np.int32)
    mapped = one[raw]
    return mapped[mapped > 0]


def normalise(text: str) -> str:
    return "".join(map(chr, codes_of(text).tolist()))


def _is_cjk(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), dtype=bool)
    for a, b in _CJK_RANGES:
        out |= (codes >= a) & (codes < b)
    return out


class Shape:
    """Windows of one length class: length, stride in documents, walk steps and sampled positions."""

    def __init__(self, cjk: bool, window: int):
        self.cjk, self.window = cjk, window
        self.stride = max(1, window // 4 if window < 16 else window // 2)
        self.repetitions = REPETITIONS if window < 16 else LONG_REPETITIONS
        self.steps = max(4, int(1.7 * window))
        sampled = min(window, 10 if cjk or window < 22 else 12, self.steps)
        rnd = np.random.default_rng((SEED * 1009 + window) * 2 + cjk)
        self.bits = rnd.integers(0, 2, size=(REPETITIONS, self.steps, 256), dtype=np.int64)
        self.sampled = [set(rnd.choice(self.steps, sampled, replace=False).tolist()) for _ in range(REPETITIONS)]
        self.mix = (rnd.integers(1, 1 << 62, size=self.steps, dtype=np.int64) | 1).tolist()

    def keys(self, codes: np.ndarray, classes: np.ndarray, starts: np.ndarray, repetition: int) -> np.ndarray:
        """Key of each window; behind the last start there are ``steps`` codes more."""
        bits, sampled = self.bits[repetition], self.sampled[repetition]
        at = starts.astype(np.int64)
        key = np.full(len(at), self.window * 2 + self.cjk, dtype=np.int64)
        with np.errstate(over="ignore"):
            for j in range(max(sampled) + 1):
                if j in sampled:
                    key ^= codes[at]
                    key += j
                    key *= self.mix[j]
                    key ^= key >> 29
                at += bits[j][classes[at]]
        return key


#: Window lengths of the classes, each about 1.4 times the last.
LADDER = (1, *sorted({int(2 * 2 ** (i / 2)) for i in range(19)}))


def shape_of(codes: np.ndarray) -> Shape | None:
    """The class of an item; None where it holds no letter or digit.

    Half an item must hold a window at any alignment with the stride; and with every sixth
    character exchanged some window must stay nearly whole, so windows grow with the item's
    length while it is short, and with its root beyond.
    """
    n = len(codes)
    if n == 0:
        return None
    cjk = bool(_is_cjk(codes).mean() > 0.3)
    want = min(max(0.145 * n, 2 if cjk else 8), (1.35 if cjk else 2.1) * n**0.5)
    nearest = min(LADDER, key=lambda w: abs(np.log(w / want)))
    return Shape(cjk, min(nearest, max(w for w in LADDER if w <= max(1, 0.31 * n))))


class Batch:
    """Texts in one array, ``pad`` zeros behind each, with what all classes need of them."""

    def __init__(self, texts: list[np.ndarray], pad: int):
        zeros = np.zeros(pad, dtype=np.int32)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.bases = np.cumsum(self.lengths + pad) - self.lengths - pad
        self.codes = np.concatenate([x for t in texts for x in (t, zeros)])
        self.classes = ((self.codes >> 8) ^ self.codes).astype(np.uint8)
        script = _is_cjk(self.codes)
        self.cjk = np.concatenate([[0], np.cumsum(script, dtype=np.int32)]) if script.any() else None

    def windows(self, shape: Shape, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, text number and offset of the windows of the class's script; the last one ends with its text."""
        w = shape.window
        none = np.zeros(0, dtype=np.int64)
        if shape.cjk and self.cjk is None:
            return none, none, none
        last = self.lengths - w
        count = np.where(last >= 0, -(-last // stride) + 1, 0)
        owner = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        offset = np.minimum(number * stride, last[owner])
        start = offset + self.bases[owner]
        if self.cjk is not None:
            inside = self.cjk[start + w] - self.cjk[start]
            keep = inside >= 0.2 * w if shape.cjk else inside <= 0.8 * w
            start, owner, offset = start[keep], owner[keep], offset[keep]
        return start, owner, offset


def keys_of(shape: Shape, batch: Batch, stride: int):
    """(repetition, key, text number, offset) arrays of the windows of a batch."""
    starts, owner, offset = batch.windows(shape, stride)
    if len(starts):
        for r in range(shape.repetitions):
            yield r, shape.keys(batch.codes, batch.classes, starts, r), owner, offset


#: Diagonals beside a meeting's own in which its surroundings are compared.
DRIFT = 8
#: Cells of a matrix that the checks hold at once.
CELLS = 4_000_000


def held_meetings(texts: list[np.ndarray], items: list[np.ndarray], met: np.ndarray) -> np.ndarray:
    """Which rows (item, text, text position, item position) of ``met`` lie in a passage that holds half the item.

    A passage with at most a quarter of its characters edited has half of them in pairs of
    neighbours that are equal on a diagonal near the meeting's (each edit parts two pairs);
    what has fewer can't hold and isn't aligned.  The rest is aligned exactly.
    """
    out = np.zeros(len(met), dtype=bool)
    lanes: list[tuple[int, int, int, int]] = []
    of: list[int] = []
    rows: list[int] = []
    for a, z in _runs(met[:, :1]):
        k = int(met[a, 0])
        half = max(1, int(SHARE * len(items[k])))
        step = max(1, CELLS // (2 * half + 2))
        good = np.concatenate([_covered(texts, items[k], met[x : min(x + step, z)]) for x in range(a, z, step)])
        band = int(EDITS * half) + 2
        seen: dict[tuple[int, int], int] = {}
        for x in (np.nonzero(good)[0] + a).tolist():
            t, d = int(met[x, 1]), int(met[x, 2] - met[x, 3])
            cell = t, d // max(1, band // 2)
            if cell not in seen:
                seen[cell] = len(lanes)
                lanes.append((len(items[k]), k, t, d))
            of.append(seen[cell])
            rows.append(x)
    if lanes:
        holds = np.zeros(len(lanes), dtype=bool)
        order = sorted(range(len(lanes)), key=lanes.__getitem__)
        at = 0
        while at < len(order):
            # Lanes of like lengths together, as many as the cells allow.
            n = lanes[order[at]][0]
            size = max(1, CELLS // 16 // (2 * (int(EDITS * SHARE * n * 1.5) + 2) + 1))
            part = [x for x in order[at : at + size] if lanes[x][0] <= 1.5 * n + 8]
            holds[part] = _aligned([texts[lanes[x][2]] for x in part], [items[lanes[x][1]] for x in part], [lanes[x][3] for x in part])
            at += len(part)
        out[rows] = holds[of]
    return out


def _runs(keys: np.ndarray):
    """(first, last + 1) of the runs of equal rows."""
    if len(keys):
        edges = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])


def _pairs(codes: np.ndarray, before: int, after: int, absent: int) -> np.ndarray:
    """Neighbouring characters as one number each, with ``absent`` on both sides."""
    two = codes[:-1].astype(np.int64) << 32 | codes[1:]
    return np.concatenate([np.full(before, absent), two, np.full(after, absent)])


def _covered(texts: list[np.ndarray], item: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Which meetings of one item have enough equal pairs around them."""
    half = max(1, int(SHARE * len(item)))
    if len(item) < 2:
        return np.ones(len(met), dtype=bool)
    span = 2 * half + 1
    wanted = np.lib.stride_tricks.sliding_window_view(_pairs(item, half, half + 1, -1), span)[met[:, 3]]
    beside = np.full((len(met), span + 2 * DRIFT), -2, dtype=np.int64)
    first = met[:, 2] - half - DRIFT
    for k, (t, d) in enumerate(zip(met[:, 1].tolist(), first.tolist())):
        a, z = max(0, d), min(len(texts[t]), d + beside.shape[1] + 1)
        if z - a > 1:
            x = texts[t][a:z]
            beside[k, a - d : z - d - 1] = x[:-1].astype(np.int64) << 32 | x[1:]
    pairs = np.zeros(wanted.shape, dtype=bool)
    for shift in range(2 * DRIFT + 1):
        pairs |= beside[:, shift : shift + span] == wanted
    chars = pairs.copy()
    chars[:, 1:] |= pairs[:, :-1]
    total = np.cumsum(np.concatenate([np.zeros((len(met), 1), dtype=np.int32), chars], axis=1, dtype=np.int32), axis=1)
    return (total[:, half:] - total[:, :-half]).max(axis=1) >= int((1 - 2 * EDITS) * half) - 1


def _aligned(texts: list[np.ndarray], items: list[np.ndarray], diagonals: list[int]) -> np.ndarray:
    """For each lane: does an alignment near its diagonal hold ``SHARE`` of its item at ``EDITS``?

    Local alignment of all lanes at once, row by row of the items.  A path's score is the length
    of its part of the item less three for each edit, so its edits follow from both.  A passage
    begins where its score leaves zero and ends where it is highest, so it doesn't run on into
    other text.  A cell carries in one number its score, where its path began, and how far the
    score has dropped from its highest.
    """
    lengths = np.array([len(x) for x in items])
    need = (SHARE * lengths - np.minimum(2, lengths // 40))[:, None]
    n = int(lengths.max())
    band = int(EDITS * SHARE * n) + 2
    width = 2 * band + 1
    wanted = np.full((len(items), n), -1, dtype=np.int32)
    beside = np.zeros((len(items), n + width), dtype=np.int32)
    for k, (t, x, d) in enumerate(zip(texts, items, diagonals)):
        wanted[k, : len(x)] = x
        a, z = max(0, d - band), min(len(t), d - band + n + width)
        if z > a:
            beside[k, a - (d - band) : z - (d - band)] = t[a:z]
    up, begin, dropped = 1 << 41, 1 << 19, (1 << 19) - 1
    latest = (1 << 22) - 1
    slope = np.arange(width, dtype=np.int64) * (3 * up - 3)
    row = np.zeros((len(items), width), dtype=np.int64)
    found = np.zeros(len(items), dtype=bool)
    least = int(need.min())
    for r in range(n):
        equal = beside[:, r : r + width] == wanted[:, r : r + 1]
        edited = row - (2 * up - 2)
        best = np.maximum(row, (latest - r) * begin)
        best += up
        best -= (best & dropped) > 0
        best = np.where(equal, best, edited)
        if r + 1 >= least:
            span = r + 1 - (latest - (best >> 19 & latest))
            found |= (equal & ((best & dropped) == 0) & (span >= need) & (span - (best >> 41) <= 3 * EDITS * span)).any(axis=1)
        best[:, :-1] = np.maximum(best[:, :-1], edited[:, 1:])
        # Characters of the text that are skipped: a cell hands its path on to the right, at one edit each.
        best += slope
        np.maximum.accumulate(best, axis=1, out=best)
        best -= slope
        row = np.where(best >= up, best, 0)
    return found


class Index:
    """What the workers need of the items: their codes, and the sorted keys of each class."""

    def __init__(self, ids: list, codes: list[np.ndarray], tables: dict[tuple[bool, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]):
        self.ids, self.codes, self.tables = ids, codes, tables

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> Index:
        codes = [codes_of(t) for _, t in items]
        classes: dict[tuple[bool, int], list[int]] = {}
        for k, c in enumerate(codes):
            shape = shape_of(c)
            if shape:
                classes.setdefault((shape.cjk, shape.window), []).append(k)
        tables = {}
        for (cjk, window), members in classes.items():
            shape, numbers = Shape(cjk, window), np.array(members, dtype=np.int32)
            reps = []
            for _, key, owner, offset in keys_of(shape, Batch([codes[k] for k in members], shape.steps + 1), 1):
                # A window that an item repeats stands once, where it is first; its other places lie in the same passage.
                _, order = np.unique(np.stack([key, owner], axis=1), axis=0, return_index=True)
                order = order[np.argsort(key[order], kind="stable")]
                reps.append((key[order], numbers[owner[order]], offset[order]))
            if reps:
                tables[cjk, window] = reps
        return cls([i for i, _ in items], codes, tables)

    def state(self) -> tuple:
        return self.ids, self.codes, self.tables

    def meetings(self, texts: list[np.ndarray]) -> np.ndarray:
        """Distinct rows (item number, text number, text position, item position) of windows that meet."""
        found = []
        shapes = [Shape(*c) for c in self.tables]
        batch = Batch(texts, max(s.steps for s in shapes) + 1)
        for shape, reps in zip(shapes, self.tables.values()):
            for r, mine, owner, offset in keys_of(shape, batch, shape.stride):
                keys, items, places = reps[r]
                lo = np.searchsorted(keys, mine, "left")
                met = np.nonzero(keys[np.minimum(lo, len(keys) - 1)] == mine)[0]
                if not len(met):
                    continue
                lo = lo[met]
                many = np.searchsorted(keys, mine[met], "right") - lo
                doc = np.repeat(met, many)
                entry = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
                found.append(np.stack([items[entry], owner[doc], offset[doc], places[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), dtype=np.int32)

    def held(self, texts: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text number, item number) of the texts that hold half an item."""
        met = self.meetings(texts).astype(np.int64)
        # Meetings on nearly the same diagonal stand for one another.
        _, one = np.unique(np.stack([met[:, 0], met[:, 1], (met[:, 2] - met[:, 3]) // (DRIFT // 2), met[:, 3] // 64], axis=1), axis=0, return_index=True)
        met = met[np.sort(one)]
        holds = met[held_meetings(texts, self.codes, met)]
        return sorted({(int(t), int(k)) for k, t in holds[:, :2].tolist()})


def _batches(rows, least: int):
    """(ids, codes) of documents in batches of bounded characters."""
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        c = codes_of(text)
        if len(c) >= least:
            ids.append(doc_id)
            texts.append(c)
            size += len(c)
        if size > BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of each document that holds at least half of an item as one passage.

    Null and empty texts, and texts without a letter or digit, hold and leak nothing; repeated
    rows give one row; other columns are ignored; without items the result is empty.  Texts are
    scanned whole; items of any length are looked for.
    """
    spark = documents.sparkSession
    types = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {types[0]}, item_id {types[1]}"
    docs = documents.where(F.length("text") > 0).select("doc_id", "text")
    wanted = items.where(F.col("text").rlike(r"[\p{L}\p{N}]") & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    # As many keys as the items have characters, times the repetitions.
    size = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size * REPETITIONS > BROADCAST_KEYS:
        return _joined(docs, wanted, types)
    shared = spark.sparkContext.broadcast(Index.of([tuple(r) for r in wanted.collect()]).state())

    def run(rows):
        index = Index(*shared.value)
        if index.tables:
            for ids, texts in _batches(rows, 1):
                for k, item in index.held(texts):
                    yield ids[k], index.ids[item]

    return map_rows(docs, run, schema).distinct()


def _joined(docs: DataFrame, items: DataFrame, types: tuple[str, str]) -> DataFrame:
    """``leaks`` with the keys of both sides joined; every key's documents are split into ``SALT`` parts."""

    def item_keys(rows):
        for item_id, text in rows:
            c = codes_of(text)
            shape = shape_of(c)
            if shape:
                for r, key, _, offset in keys_of(shape, Batch([c], shape.steps + 1), 1):
                    first, at = np.unique(key, return_index=True)
                    for k, i in zip(first.tolist(), offset[at].tolist()):
                        yield item_id, shape.cjk, shape.window, r, k, i

    keyed = map_rows(items, item_keys, f"item_id {types[1]}, cjk boolean, window int, r int, k bigint, i int").persist()
    # Bounded by the ladder of window lengths, two scripts.
    classes = [(bool(x[0]), int(x[1])) for x in keyed.select("cjk", "window").distinct().collect()]

    def doc_keys(rows):
        shapes = [Shape(*c) for c in classes]
        for ids, texts in _batches(rows, 1):
            batch = Batch(texts, max(s.steps for s in shapes) + 1)
            for shape in shapes:
                for r, key, owner, offset in keys_of(shape, batch, shape.stride):
                    for k, n, p in zip(key.tolist(), owner.tolist(), offset.tolist()):
                        yield ids[n], r, k, p

    theirs = map_rows(docs, doc_keys, f"doc_id {types[0]}, r int, k bigint, p int").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    mine = keyed.select("item_id", "r", "k", "i", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    met = theirs.join(mine.hint("merge"), ["r", "k", "part"]).groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("p", "i")).alias("places"))
    pairs = met.join(docs.distinct(), "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "item_id", "text", "item", "places")

    def check(rows):
        for doc_id, item_id, text, item, places in rows:
            met = np.array([(0, 0, x["p"], x["i"]) for x in places], dtype=np.int64)
            if held_meetings([codes_of(text)], [codes_of(item)], met).any():
                yield doc_id, item_id

    return map_rows(pairs, check, f"doc_id {types[0]}, item_id {types[1]}").distinct()
