"""Sentence alignment of units and their translations.

A bilingual lexicon is induced per language pair from the co-occurrence of word types in
aligned units, scored by the log-likelihood ratio.  Sentence pairs are scored by the share of
their words that the lexicon and shared anchors (numbers, identifiers, names) explain; a
maximum-weight assignment with null costs (Hungarian method) gives the links, and sentences
it leaves over are joined to a partner where the merged span explains clearly more.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.arrow import map_rows
from inkweave.llm.sentences import sentence_ends

LLR_LEAST = 12.0
TRANSLATIONS = 8
#: Counted cells and pairs that a worker holds before it hands its partial counts on.
HELD_CELLS, HELD_PAIRS = 12_000_000, 2_000_000
#: Cells in a batch that a worker hands on.
OUT_CELLS = 200_000
#: Largest lexicon (entries) that is broadcast; beyond it each unit gets its slice by a join.
BROADCAST_ENTRIES = 400_000
NULL_SCORE = 0.30
#: Least share that a left-over sentence must be explained by a partner, and add to it.
JOIN_SCORE, JOIN_GAIN = 0.42, 0.22
ANCHOR_WEIGHT = 4.0
ORDER_BONUS = 0.06

_CJK_RUN = re.compile("[぀-ヿ㐀-鿿]+|[฀-๿]+")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ॿ]+[^\W\d_]*)*")
_ANCHOR = re.compile(r"[A-Za-z]+(?:\.[A-Za-z0-9]+)+|v\d+(?:\.\d+)+|[A-Z]{1,3}-\d+|\d+(?:[.,:–-]\d+)*|[A-Z][a-z]+[A-Z]\w*|[A-ZÀ-Þ][a-zà-ÿ]+(?:[A-ZÀ-Þ]\w+)?")
_TAG = re.compile(r"<[^<>\n]{1,80}>|&[a-z#0-9]{2,8};")


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) >> 1 or 1


def lexical(text: str) -> set[str]:
    """Word types of a text: lower-cased words, and pairs of neighbouring letters in scripts without spaces."""
    out: set[str] = set()
    rest = text
    for m in _CJK_RUN.finditer(text):
        run = m.group()
        out.update(run[i : i + 2] for i in range(len(run) - 1)) if len(run) > 1 else out.add(run)
    if out:
        rest = _CJK_RUN.sub(" ", text)
    for w in _WORD.findall(rest):
        if len(w) > 1 and (w.islower() or not w.isascii() and not w[0].isupper() or w.istitle()):
            out.add(w.lower())
    return out


def anchors(text: str) -> set[str]:
    """Signs that a translation keeps: numbers (any decimal sign), identifiers, names."""
    return {a.replace(",", ".").replace(":", ".").replace("-", "–") if a[0].isdigit() else a for a in _ANCHOR.findall(text)}


def cooccurrence(units: DataFrame) -> DataFrame:
    """``pair, s, t, n``: counts over ``units(pair, source_text, target_text)``; s or t 0 is a margin.

    Every cell is handed on, so that the sums don't depend on how the units are partitioned.
    """

    def run(arrived):
        state: dict[str, dict] = {}
        rows = (row for batch in arrived for row in zip(*[c.to_pylist() for c in batch.columns]))

        def batches(pair, s, t, n):
            for i in range(0, len(n), OUT_CELLS):
                m = len(n[i : i + OUT_CELLS])
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(m, dtype=np.int32)), pa.array([pair], pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, *(pa.array(x[i : i + OUT_CELLS]) for x in (s, t, n))], names=["pair", "s", "t", "n"])

        def emit(pair, st):
            settle(st)
            count = st["m"][: len(st["s"]), : len(st["t"])]
            hs, ht = (np.fromiter(map(_hash, st[side]), dtype=np.int64, count=len(st[side])) for side in "st")
            zs, zt = np.zeros_like(hs), np.zeros_like(ht)
            yield from batches(pair, np.concatenate([[0], hs, zt]), np.concatenate([[0], zs, ht]), np.concatenate([[st["n"]], st["ns"], st["nt"]]).astype(np.int64))
            step = max(1, OUT_CELLS // max(1, len(ht)))
            for k in range(0, len(hs), step):
                i, j = np.nonzero(count[k : k + step])
                yield from batches(pair, hs[k + i], ht[j], count[k + i, j].astype(np.int64))

        def settle(st):
            if st["held"]:
                ns, nt = len(st["s"]), len(st["t"])
                m = st["m"]
                if ns > m.shape[0] or nt > m.shape[1]:
                    grown = np.zeros((max(ns * 5 // 4 + 16, m.shape[0]), max(nt * 5 // 4 + 16, m.shape[1])), dtype=np.int32)
                    grown[: m.shape[0], : m.shape[1]] = m
                    st["m"] = m = grown
                width = m.shape[1]
                code = np.concatenate([(np.repeat(x, len(y)) * width + np.tile(y, len(x))) for x, y in st["held"]])
                m += np.bincount(code, minlength=m.size).astype(np.int32).reshape(m.shape)
                st["held"], st["pairs"] = [], 0

        for pair, source, target in rows:
            st = state.get(pair)
            if st is None:
                st = state[pair] = {"s": {}, "t": {}, "ns": [], "nt": [], "n": 0, "held": [], "pairs": 0, "m": np.zeros((64, 256), dtype=np.int32)}
            st["n"] += 1
            ids = []
            for side, counts, text in (("s", "ns", source), ("t", "nt", target)):
                vocabulary, margin, own = st[side], st[counts], []
                for token in lexical(text):
                    i = vocabulary.setdefault(token, len(vocabulary))
                    if i == len(margin):
                        margin.append(0)
                    margin[i] += 1
                    own.append(i)
                ids.append(np.array(own, dtype=np.int64))
            if len(ids[0]) and len(ids[1]):
                st["held"].append(tuple(ids))
                st["pairs"] += len(ids[0]) * len(ids[1])
                if st["pairs"] > HELD_PAIRS:
                    settle(st)
                if len(st["s"]) * len(st["t"]) > HELD_CELLS or sum(x["m"].size for x in state.values()) > 2 * HELD_CELLS:
                    for k in list(state):
                        yield from emit(k, state.pop(k))
        for k in list(state):
            yield from emit(k, state.pop(k))

    return units.select("pair", "source_text", "target_text").mapInArrow(run, "pair string, s bigint, t bigint, n bigint").groupBy("pair", "s", "t").agg(F.sum("n").alias("n"))


def lexicon(units: DataFrame) -> DataFrame:
    """``pair, s, t, weight, u``: the best translations of each word type and its information."""
    counts = cooccurrence(units).where("s = 0 OR t = 0 OR n > 1").persist()
    total = counts.where("s = 0 AND t = 0").select("pair", F.col("n").alias("total"))
    ns = counts.where("s <> 0 AND t = 0").select("pair", "s", F.col("n").alias("ns"))
    nt = counts.where("s = 0 AND t <> 0").select("pair", "t", F.col("n").alias("nt"))
    cells = counts.where("s <> 0 AND t <> 0").join(ns, ["pair", "s"]).join(nt, ["pair", "t"]).join(F.broadcast(total), "pair")

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    c, a, b, n = (F.col(x).cast("double") for x in ("n", "ns", "nt", "total"))
    llr = 2 * (part(c, a * b / n) + part(a - c, a * (n - b) / n) + part(b - c, (n - a) * b / n) + part(n - a - b + c, (n - a) * (n - b) / n))
    scored = cells.select("pair", "s", "t", (2 * c / (a + b)).alias("weight"), F.log(n / a).alias("u"), F.log(n / b).alias("v"), llr.alias("llr"), (c * n > a * b).alias("up"))
    best = Window.partitionBy("pair", "s").orderBy(F.col("llr").desc(), "t")
    return scored.where(F.col("up") & (F.col("llr") >= LLR_LEAST)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TRANSLATIONS).select("pair", "s", "t", "weight", "u", "v")


def assign(score: list[list[float]], null: float) -> list[int]:
    """Maximum-weight assignment of rows to columns; -1 where leaving a row alone is worth more."""
    n, m = len(score), len(score[0])
    tops = [max(range(m), key=row.__getitem__) for row in score]
    if len(set(tops)) == n:
        return [j if score[i][j] > null else -1 for i, j in enumerate(tops)]
    width = m + n
    cost = [[-x for x in row] + [-null] * n for row in score]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (width + 1), [0] * (width + 1), [0] * (width + 1)
    for i in range(1, n + 1):
        match[0] = i
        j0, least, used = 0, [math.inf] * (width + 1), [False] * (width + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, width + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(width + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


class Scorer:
    """Scores sentence pairs with one language pair's lexicon: {s: [(t, weight)]}, {s: u}, {t: v}."""

    def __init__(self, table: dict[int, list[tuple[int, float]]], u: dict[int, float], v: dict[int, float], memo: dict[str, int]):
        self.table, self.u, self.v, self.memo = table, u, v, memo

    def side(self, text: str) -> tuple[list[int], set[str]]:
        memo = self.memo
        ids = []
        for token in lexical(_TAG.sub(" ", text)):
            h = memo.get(token)
            if h is None:
                h = memo[token] = _hash(token)
            ids.append(h)
        return ids, anchors(text)

    def links(self, source: list[str], target: list[str]) -> list[tuple[int, int]]:
        """Pairs of sentence numbers (from 0) of which the second renders the first."""
        n, m = len(source), len(target)
        S, T = [self.side(x) for x in source], [self.side(x) for x in target]
        both = set().union(*(a for _, a in S)) & set().union(*(a for _, a in T))
        spread = {a: sum(a in x for _, x in S) + sum(a in x for _, x in T) - 1 for a in both}
        anchor = {a: ANCHOR_WEIGHT / k for a, k in spread.items()}
        table, u, v = self.table, self.u, self.v
        known_t = [[(t, v[t]) for t in ids if t in v] for ids, _ in T]
        known_s = [[(s, u[s]) for s in ids if s in u] for ids, _ in S]
        ws = [sum(w for _, w in k) + sum(anchor.get(a, 0.5) for a in x) or 1.0 for k, (_, x) in zip(known_s, S)]
        wt = [sum(w for _, w in k) + sum(anchor.get(a, 0.5) for a in x) or 1.0 for k, (_, x) in zip(known_t, T)]
        where: dict[int, list[int]] = {}
        for j, (ids, _) in enumerate(T):
            for t in ids:
                where.setdefault(t, []).append(j)
        cover_s = [[0.0] * m for _ in range(n)]
        gain_t: list[list[dict[int, float]]] = [[{} for _ in range(m)] for _ in range(n)]
        for i in range(n):
            for s, us in known_s[i]:
                best: dict[int, float] = {}
                for t, w in table[s]:
                    for j in where.get(t, ()):
                        if w > best.get(j, 0.0):
                            best[j] = w
                        g = gain_t[i][j]
                        if w > g.get(t, 0.0):
                            g[t] = w
                top = table[s][0][1] if table[s] else 1.0
                for j, w in best.items():
                    cover_s[i][j] += us * min(1.0, w / top)
        shared = [[sum(anchor[a] for a in S[i][1] & T[j][1]) for j in range(m)] for i in range(n)]
        tops = self._tops()
        explained = [[{t: min(1.0, w / tops.get(t, 1.0)) * v[t] for t, w in gain_t[i][j].items()} for j in range(m)] for i in range(n)]
        src = [[(cover_s[i][j] + shared[i][j]) / ws[i] for j in range(m)] for i in range(n)]
        tgt = [[(sum(explained[i][j].values()) + shared[i][j]) / wt[j] for j in range(m)] for i in range(n)]
        score = [[0.5 * (src[i][j] + tgt[i][j]) + ORDER_BONUS * (1 - abs((i + 0.5) / n - (j + 0.5) / m)) for j in range(m)] for i in range(n)]
        links = {(i, j) for i, j in enumerate(assign(score, NULL_SCORE + ORDER_BONUS)) if j >= 0 and score[i][j] >= NULL_SCORE}
        by_s, by_t = {i: j for i, j in links}, {j: i for i, j in links}
        for i in range(n):
            if i in by_s:
                continue
            def added(j: int) -> float:
                k = by_t.get(j)
                if k is None:
                    return tgt[i][j]
                old, new = explained[k][j], explained[i][j]
                more = sum(w - old.get(t, 0.0) for t, w in new.items() if w > old.get(t, 0.0)) + sum(anchor[a] for a in (S[i][1] - S[k][1]) & T[j][1])
                return more / wt[j]
            j = max(range(m), key=lambda j: src[i][j] + added(j))
            if src[i][j] >= JOIN_SCORE and added(j) >= JOIN_GAIN:
                links.add((i, j))
        for j in range(m):
            if j in by_t:
                continue
            def left(i: int) -> float:
                k = by_s.get(i)
                if k is None:
                    return src[i][j]
                return max(0.0, min(src[i][j], 1.0 - src[i][k])) + sum(anchor[a] for a in (T[j][1] - T[k][1]) & S[i][1]) / ws[i]
            i = max(range(n), key=lambda i: tgt[i][j] + left(i))
            if tgt[i][j] >= JOIN_SCORE and left(i) >= 0.5 * JOIN_GAIN:
                links.add((i, j))
        return sorted(links)

    def _tops(self) -> dict[int, float]:
        """Best weight by target type; made once, unless the table is a slice and they were given."""
        if not hasattr(self, "tops"):
            tops: dict[int, float] = {}
            for entries in self.table.values():
                for t, w in entries:
                    if w > tops.get(t, 0.0):
                        tops[t] = w
            self.tops = tops
        return self.tops


def _scorers(rows) -> dict[str, Scorer]:
    memo: dict[str, int] = {}
    parts: dict[str, tuple[dict, dict, dict]] = {}
    for pair, s, t, w, u, v in rows:
        table, us, vs = parts.setdefault(pair, ({}, {}, {}))
        table.setdefault(s, []).append((t, w))
        us[s], vs[t] = u, v
    for table, _, _ in parts.values():
        for entries in table.values():
            entries.sort(key=lambda x: -x[1])
    return {k: Scorer(*x, memo) for k, x in parts.items()}


def cut(text: str) -> list[str]:
    out, start = [], 0
    for e in sentence_ends(text):
        out.append(text[start:e])
        start = e
    return out


def align(units: DataFrame, key: str) -> DataFrame:
    """``key, source_no, target_no`` of ``units(key, pair, source_text, target_text)``.

    Sentence numbers are those of the sentence splitter, from 1.  Null, empty and blank texts
    have no sentences and give no row; one row per unit is expected (repeated rows repeat
    their links, which are made distinct).
    """
    base = units.where((F.length(F.trim("source_text")) > 0) & (F.length(F.trim("target_text")) > 0)).select(key, "pair", "source_text", "target_text").persist()
    lex = lexicon(base)
    rows = lex.limit(BROADCAST_ENTRIES + 1).collect()
    type_ = units.schema[key].dataType.simpleString()
    schema = f"`{key}` {type_}, source_no int, target_no int"
    if len(rows) <= BROADCAST_ENTRIES:
        shared = units.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def run(it):
            scorers = _scorers(shared.value)
            empty = Scorer({}, {}, {}, {})
            for k, pair, source, target in it:
                a, b = cut(source), cut(target)
                if a and b:
                    for i, j in scorers.get(pair, empty).links(a, b):
                        yield k, i + 1, j + 1

        return map_rows(base, run, schema).distinct()

    def types(side):
        def run(it):
            for k, pair, text in it:
                for token in set().union(*(lexical(_TAG.sub(" ", x)) for x in cut(text))):
                    yield k, pair, _hash(token)

        return map_rows(base.select(key, "pair", f"{side}_text"), run, f"k {type_}, pair string, {side[0]} bigint").distinct()

    def entries(x: DataFrame, *columns: str) -> DataFrame:
        return x.groupBy("k").agg(F.collect_list(F.struct(*columns)).alias(columns[0]))

    # A slice holds the entries of the unit's source types, and what the whole lexicon has of its target types.
    known = lex.groupBy("pair", "t").agg(F.max("v").alias("v"), F.max("weight").alias("top"))
    own = entries(types("source").join(lex, ["pair", "s"]), "pair", "s", "t", "weight", "u", "v").withColumnRenamed("pair", "lex")
    theirs = entries(types("target").join(known, ["pair", "t"]), "t", "v", "top").withColumnsRenamed({"t": "known", "k": "k2"})

    def sliced(it):
        for k, pair, source, target, mine, known in it:
            a, b = cut(source), cut(target)
            if a and b:
                scorer = _scorers(tuple(e.values()) for e in mine or ()).get(pair) or Scorer({}, {}, {}, {})
                scorer.v, scorer.tops = {e["t"]: e["v"] for e in known or ()}, {e["t"]: e["top"] for e in known or ()}
                for i, j in scorer.links(a, b):
                    yield k, i + 1, j + 1

    joined = base.join(own, base[key] == own.k, "left").join(theirs, base[key] == theirs.k2, "left")
    return map_rows(joined.select(key, base.pair, "source_text", "target_text", "lex", "known"), sliced, schema).distinct()
