"""Terms, translation memory, fuzzy carry-over and covers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.python import indel_ratio
from inkweave.functions.text import memory_tokens

#: Largest glossary that is broadcast; a larger one is matched in blocks of this size.
TERM_BLOCK = 50_000


def contained_terms(texts: DataFrame, keys: list[str], text: str, language: str, terms: DataFrame, exact: bool = False) -> DataFrame:
    """``*keys, term_id`` of ``terms(term_id, language, form)`` that stand in a text, whatever the case unless ``exact``.

    The forms are a stated query set: an automaton over one block of them is broadcast and all
    texts are scanned in one narrow pass per block.
    """
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    id_type = terms.schema["term_id"].dataType.simpleString()
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", term_id {id_type}"
    n = len(keys)
    spark = texts.sparkSession
    picked = texts.where(F.length(text) > 0).select(*keys, F.col(text).alias("__t"), F.col(language).alias("__l"))
    forms = terms.where((F.length(F.trim("form")) > 0) & F.col("language").isNotNull()).select("term_id", "language", "form")
    out: DataFrame | None = None

    def scan(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(frames):
            import ahocorasick

            machines: dict[str, ahocorasick.Automaton] = {}
            grouped: dict[str, dict[str, list]] = {}
            for term_id, lang, form in shared.value:
                grouped.setdefault(lang, {}).setdefault(form if exact else form.lower(), []).append(term_id)
            for lang, words in grouped.items():
                machine = ahocorasick.Automaton()
                for word, ids in words.items():
                    machine.add_word(word, ids)
                machine.make_automaton()
                machines[lang] = machine
            for f in frames:
                rows = []
                for row in f.itertuples(index=False, name=None):
                    machine = machines.get(row[n + 1])
                    if machine is not None:
                        seen = {i for _, ids in machine.iter(row[n] if exact else row[n].lower()) for i in ids}
                        rows += [(*row[:n], i) for i in seen]
                yield pd.DataFrame(rows, columns=[*keys, "term_id"])

        return picked.mapInPandas(run, schema)

    block: list[tuple] = []
    for r in forms.toLocalIterator():
        block.append(tuple(r))
        if len(block) == TERM_BLOCK:
            part = scan(block)
            out, block = part if out is None else out.unionByName(part), []
    if block:
        part = scan(block)
        out = part if out is None else out.unionByName(part)
    return (spark.createDataFrame([], schema) if out is None else out).distinct()


def in_scope(scope, page, parent):
    """A term holds for the whole document, one page, or what stands under one heading."""
    return (scope == "document") | (scope == F.concat(F.lit("page:"), page.cast("string"))) | scope.eqNullSafe(parent)


def translation_memory(current: DataFrame, memory: DataFrame, k: int = 6) -> DataFrame:
    """``unit_id, score, rank``: the ``k`` memory entries most like one batch of current units.

    ``current(unit_id, source_text)`` is one batch and bounded by its word limit; its token set
    is one row.  ``memory(unit_id, line_no, source_text, adjacent)`` is scanned once.  Score is
    Jaccard similarity plus two for adjacent units; ties go to adjacency, then ledger order.
    """
    tokens = current.agg(F.array_distinct(F.flatten(F.collect_list(memory_tokens(F.col("source_text"))))).alias("mine"))
    m = memory.join(current.select("unit_id"), "unit_id", "left_anti").crossJoin(F.broadcast(tokens))
    t = memory_tokens(F.col("source_text"))
    union = F.size(F.array_union("mine", t))
    similar = F.when(union > 0, F.size(F.array_intersect("mine", t)) / union).otherwise(0.0)
    scored = m.select("unit_id", "line_no", F.col("adjacent").cast("int").alias("adjacent"), (similar + 2.0 * F.col("adjacent").cast("int")).alias("score"))
    top = scored.orderBy(F.col("score").desc(), F.col("adjacent").desc(), "line_no").limit(k)
    return top.select("unit_id", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("adjacent").desc(), "line_no")).alias("rank"))


def carry_over(old: DataFrame, new: DataFrame, least: float = 88.0) -> DataFrame:
    """``new_id, old_id, score``: one-to-one matches of re-extracted texts on the same page.

    ``(project_id, page, ord, id, kind, text)``; kinds must agree (paragraph and note count as
    one), tables are skipped.  In the order of the new texts each takes the unused old text of
    the best ratio, the first one of equals, if the ratio is ``least`` or more.  Pages are streamed
    in order, one at a time, so no group grows with the corpus; a null text counts as empty.
    """
    kind = F.when(F.col("kind").isin("paragraph", "note"), "prose").otherwise(F.col("kind"))
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", "")
    both = old.where("kind <> 'table'").select("project_id", "page", "ord", "id", kind.alias("kind"), key.alias("text"), F.lit(False).alias("fresh")).unionByName(
        new.where("kind <> 'table'").select("project_id", "page", "ord", "id", kind.alias("kind"), key.alias("text"), F.lit(True).alias("fresh"))
    )

    def matches(page: list[tuple]) -> list[tuple]:
        """Of one page's (id, kind, text, fresh) in order."""
        pool: dict[str, list[tuple]] = {}
        for i, k, t, x in page:
            if not x:
                pool.setdefault(k, []).append((i, t))
        out = []
        for i, k, t, x in page:
            best = (-1.0, None)
            for place, (_, text) in enumerate(pool.get(k, ()) if x else ()):
                bound = 200.0 * min(len(t), len(text)) / max(1, len(t) + len(text))
                if bound > best[0] and (t == text or bound >= least):
                    score = 100.0 if t == text else indel_ratio(t, text)
                    if score > best[0]:
                        best = (score, place)
            if best[1] is not None and best[0] >= least:
                out.append((i, pool[k].pop(best[1])[0], best[0]))
        return out

    def run(frames):
        key, page = None, []
        for f in frames:
            found = []
            for row in f.itertuples(index=False, name=None):
                if row[0] != key:
                    found += matches(page)
                    key, page = row[0], []
                page.append(row[1:])
            yield pd.DataFrame(found, columns=["new_id", "old_id", "score"])
        yield pd.DataFrame(matches(page), columns=["new_id", "old_id", "score"])

    keyed = both.select(F.to_json(F.struct("project_id", "page")).alias("key"), "ord", "id", "kind", F.coalesce("text", F.lit("")).alias("text"), "fresh")
    ordered = keyed.repartition("key").sortWithinPartitions("key", "ord", "id")
    return ordered.select("key", "id", "kind", "text", "fresh").mapInPandas(run, "new_id string, old_id string, score double")


def greedy_cover(selected: set[str], manifests: list[tuple[str, str, set[str]]]) -> list[str] | None:
    """Batches that cover the selected units: most uncovered first, then newest, then smallest id.

    ``manifests`` are (batch id, creation time, unit ids) of one series, bounded by its number of
    batches; None if they can't cover the selection.
    """
    left, cover, free = set(selected), [], list(manifests)
    while left:
        gains = [(len(left & ids), created, name, ids) for name, created, ids in free if left & ids]
        if not gains:
            return None
        most = max(g[0] for g in gains)
        newest = max(g[1] for g in gains if g[0] == most)
        chosen = min((g for g in gains if g[0] == most and g[1] == newest), key=lambda g: g[2])
        cover.append(chosen[2])
        left -= chosen[3]
        free = [m for m in free if m[0] != chosen[2]]
    return cover
