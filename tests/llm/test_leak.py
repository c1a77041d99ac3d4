"""Recall of the leak operator by length of the items, and its two ways to join."""

import random

import pytest

from inkweave.llm import leak

_WORDS = random.Random(1)
LATIN = ["".join(_WORDS.choice("eeettaaooiinnsshhrrdlucmfwgypbvk") for _ in range(_WORDS.randint(3, 9))) for _ in range(4000)]
HAN = [chr(0x4E00 + 7 * k) for k in range(700)]


def passage(rnd, cjk, n):
    out = ""
    while len(out) < n:
        out += rnd.choice(HAN) if cjk else rnd.choice(LATIN)
    return out[:n]


def planted(rnd, cjk, n, how):
    item = passage(rnd, cjk, n)
    text = item
    if how == "half":
        at = rnd.randrange(n - (n + 1) // 2 + 1)
        text = item[at : at + (n + 1) // 2]
    elif how == "edited":
        letters = list(item)
        for k in rnd.sample(range(n), int(0.15 * n)):
            letters[k] = passage(rnd, cjk, 1)
        text = "".join(letters)
    elif how == "third":
        at = rnd.randrange(n - n // 3)
        text = item[at : at + n // 3]
    return item, passage(rnd, cjk, rnd.randrange(400)) + text + passage(rnd, cjk, 200)


@pytest.mark.parametrize("cjk, lengths", [(False, (22, 33, 45, 56, 69, 80, 100, 150, 208, 300, 450)), (True, (12, 16, 24, 30, 45, 60, 81, 110, 200))])
def test_recall_by_length_class(cjk, lengths):
    rnd = random.Random(11)
    for n in lengths:
        for how in ("whole", "half", "edited", "third"):
            cases = [planted(rnd, cjk, n, how) for _ in range(30)]
            index = leak.Index.of([(k, item) for k, (item, _) in enumerate(cases)])
            held = set(index.held([leak.codes_of(t) for _, t in cases]))
            found = sum((k, k) in held for k in range(30))
            if how == "third":
                assert n < 60 or found <= 1, (n, how, found)
            else:
                assert found >= leak.TARGET * 30, (n, how, found)


def test_script_of_the_whole_document_does_not_matter():
    rnd = random.Random(3)
    zh, en = passage(rnd, True, 100), passage(rnd, False, 200)
    index = leak.Index.of([(1, zh), (2, en)])
    inside_latin, inside_han = passage(rnd, False, 6000) + zh + passage(rnd, False, 3000), passage(rnd, True, 4000) + en + passage(rnd, True, 2000)
    assert index.held([leak.codes_of(inside_latin), leak.codes_of(inside_han)]) == [(0, 0), (1, 1)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text, item):
    """Is there a passage of half the item, in whole characters, at a quarter of edits?"""
    n = len(item)
    need = leak.SHARE * n - min(2, n // 40)
    for a in range(n):
        for z in range(a + 1, n + 1):
            if z - a >= need:
                for p in range(len(text)):
                    for q in range(p, min(len(text), p + z - a + n) + 1):
                        if edit_distance(item[a:z], text[p:q]) <= leak.EDITS * (z - a):
                            return True
    return False


def test_alignment_against_brute_force():
    rnd = random.Random(5)
    for _ in range(15):
        item = "".join(rnd.choice("abcdefgh") for _ in range(10))
        letters = list(item)
        for _ in range(rnd.randrange(4)):
            letters[rnd.randrange(len(letters))] = rnd.choice("abcdefgh")
        text = "".join(rnd.choice("xyz") for _ in range(4)) + "".join(letters[: rnd.randrange(2, 10)]) + "zyx"
        t, x = leak.codes_of(text), leak.codes_of(item)
        got = any(leak._aligned([t], [x], [d])[0] for d in range(-8, 12))
        if got:
            assert brute(text, item)
        elif brute(text, item):
            # Passages whose own edges are edited are the only ones that the alignment leaves out.
            assert not brute_tight(text, item)


def brute_tight(text, item):
    n = len(item)
    return any(item[a : a + 6] in text for a in range(n - 5))


def test_joined_keys_find_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    cases = [planted(rnd, k % 3 == 0, rnd.choice((24, 60, 120, 300)), rnd.choice(("whole", "half", "edited", "third"))) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "clash") for k, (_, t) in enumerate(cases)] + [(500, None, None), (501, "", ""), (502, "?!", "")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)] + [(900, None), (901, ""), (902, "--")], "item_id bigint, text string")
    one = {tuple(r) for r in leak.leaks(docs.unionAll(docs), items).collect()}
    monkeypatch.setattr(leak, "BROADCAST_KEYS", 0)
    assert one and {tuple(r) for r in leak.leaks(docs.unionAll(docs), items).collect()} == one
    assert leak.leaks(docs, items.limit(0)).count() == 0
