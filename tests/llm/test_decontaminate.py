"""op13: benchmark hits against a plain version, removal, odd input."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ODD_TEXTS, documents, prose
from tidepool.llm import decontaminate as D
from tidepool.llm.decontaminate import ItemAutomaton, decontaminate, with_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows(items, window):
    out = {}
    for i, own in items:
        k = min(window, len(own))
        for a in range(len(own) - k + 1 if own else 0):
            out.setdefault(tuple(own[a:a + k]), set()).add(i)
    return out


def plain(own, found):
    hit, ids = set(), set()
    for k in {len(w) for w in found}:
        for a in range(len(own) - k + 1):
            if tuple(own[a:a + k]) in found:
                hit.update(range(a, a + k))
                ids |= found[tuple(own[a:a + k])]
    return sorted(hit), sorted(i for i in ids if i is not None)


def places(spans):
    return [p for s in spans for p in range(s["first"], s["end"])]


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(rng):
    items = [(i, " ".join(prose(rng, rng.choice([3, 9, 10, 11, 30]), 30))) for i in range(12)]
    items += [(50, items[4][1]), (4, "again one id"), (60, None), (61, ""), (62, " .,! "),
              (None, "no id here"), (63, "solo"), (64, "Ünï cödé 日本語 w1 w2")]
    texts = []
    for _ in range(60):
        t = prose(rng, rng.randrange(0, 120), 60)
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(own) + 1)
            t[len(t) // 2:len(t) // 2] = own[a:a + rng.choice([9, 10, 12, 40])]
        texts.append(rng.choice([" ", ", ", "\n"]).join(t))
    return items, texts + ODD_TEXTS + ["SOLO", "x solo y", "No ID here", texts[5], texts[5]]


@pytest.mark.parametrize("window,most", [(10, 200_000), (4, 200_000), (10, 60)])
def test_hits_equal_plain_version(spark, monkeypatch, window, most):
    monkeypatch.setattr(D, "AUTOMATON_WORDS", most)  # a small one: several passes
    items, texts = corpus(random.Random(window))
    found = windows([(i, words(t)) for i, t in items], window)
    docs = documents(spark, texts, extra=["hits", "items"]).repartition(3)
    got = {r.doc_id: r.hits for r in
           with_hits(docs, items_table(spark, items), "hits", window).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        own = words(t)
        hit, ids = plain(own, found)
        assert got[i].n_words == len(own)
        assert (places(got[i].spans), got[i].n_hit, got[i]["items"]) == (hit, len(hit), ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), min_size=1, max_size=5),
       st.lists(st.integers(0, 4), max_size=40), st.integers(1, 5))
def test_automaton_finds_what_comparing_all_windows_finds(items, text, window):
    import numpy as np
    coded = [(i, [b"%d" % w for w in own]) for i, own in enumerate(items)]
    automaton = ItemAutomaton(coded, window)
    known = {w: i for i, w in enumerate(automaton.words.to_pylist())}
    codes = np.array([known.get(b"%d" % w, -1) for w in text], dtype=np.int64)
    hit, ids = plain([b"%d" % w for w in text], windows(coded, window))
    got = list(automaton.matches(codes, np.array([len(codes)])))
    if not hit:
        assert got == []
        return
    (_, places_hit, longest, states), = got
    assert places_hit.tolist() == hit
    assert sorted({i for s in states for i in automaton.held[s]}) == ids
    runs = {tuple(own[a:b]) for _, own in coded for a in range(len(own))
            for b in range(a + 1, len(own) + 1)}
    own = [b"%d" % w for w in text]
    assert longest == max(b - a for a in range(len(own)) for b in range(a + 1, len(own) + 1)
                          if tuple(own[a:b]) in runs and set(hit) & set(range(a, b))
                          and b - 1 in hit)


def test_spans_are_cut_and_covered_documents_dropped(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, {item.upper()}! After.", "before one two three after", item, None, "",
             f"{item} and {' '.join(prose(random.Random(1), 30))}"]
    docs = documents(spark, texts, extra=["_hits"])
    out = {r.doc_id: r.text for r in decontaminate(
        docs, items_table(spark, [(1, item)]), max_percent=90).collect()}
    assert out[0] == "Before, ! After." and out[1] == texts[1]
    assert 2 not in out and out[3] is None and out[4] == ""
    assert out[5] == " and " + texts[5].split(" and ")[1]
    kept = decontaminate(docs, items_table(spark, [(1, item)]), min_span=12, max_percent=100)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == dict(enumerate(texts))


def test_no_items_and_no_documents(spark):
    docs = documents(spark, ["a b c", None])
    none = items_table(spark, [])
    assert [r.hits.n_hit for r in with_hits(docs, none).collect()] == [0, 0]
    assert with_hits(documents(spark, []), items_table(spark, [(1, "a")])).collect() == []
    assert [r.hits.n_hit for r in
            with_hits(docs, items_table(spark, [(1, "c")]), window=1).collect()] == [1, 0]
