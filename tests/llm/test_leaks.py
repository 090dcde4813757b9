import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import leaks as K


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def brute(docs, items, n):
    runs = {(i, tuple(w[k : k + n])) for i, t in items if (w := words(t)) for k in range(len(w) - n + 1)}
    found = set()
    for d, t in docs:
        w = words(t)
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        found |= {(d, i) for i, r in runs if r in own}
    return found


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["Ab", "b", "c1", "dé", "é"]
    sep = [" ", ", ", "_", "--", "\n", " $"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(n))

    items = [(i, text(rng.randint(0, 12))) for i in range(40)] + [(99, None), (98, ""), (97, "zz " * 12)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(500, None), (501, ""), (502, "ZZ." * 12)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id int, text string, item_id int")
    b = spark.createDataFrame(items, "item_id int, text string")
    got = {tuple(r) for r in K.leaks(d, b, words=5).collect()}
    assert got == brute(docs, items, 5) and (502, 97) in got
    blocks = K.leaked_passages(d, b, words=5, block_chars=100)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got


def test_offsets():
    p = K.Passages([(1, "one two three four"), (2, "two three four five")], 3)
    text = "x ONE,two  (three) four! five y one two"
    assert sorted((i, text[a:b], n) for i, a, b, n in p.matches(text)) == [(1, "ONE,two  (three) four", 4), (2, "two  (three) four! five", 4)]
    assert p.matches("one two") == [] and K.Passages([], 3).matches("a b c") == []
    twice = K.Passages([(1, "a b a b a b")], 3)
    assert twice.matches("a b a b") == [(1, 0, 7, 4)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc", max_size=40), max_size=4), st.text("abcz", max_size=90), st.integers(1, 12))
def test_passages_are_the_maximal_ones(items, text, n):
    """Letters stand for words; passages are runs of places where any part of the item of ``n`` words begins."""
    doc = " ".join(text)
    want = set()
    for item, run in enumerate(items):
        begins = [k for k in range(len(text) - n + 1) if text[k : k + n] in run]
        for k in begins:
            if k - 1 not in begins:
                end = next(j for j in range(k, len(text) + 1) if j not in begins) + n - 1
                want.add((item, 2 * k, 2 * end - 1, end - k))
    got = K.Passages([(i, " ".join(x)) for i, x in enumerate(items)], n).matches(doc)
    assert len(got) == len(set(got)) and set(got) == want


def test_long_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, "x " * 300_000 + item + " y" * 300_000), (1, item)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, item), (8, item)], "item_id bigint, text string")
    assert {tuple(r) for r in K.leaks(d, b).collect()} == {(1, 7), (1, 8)}
    assert K.leaks(d.limit(0), b).count() == 0 and K.leaks(d, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.leaked_passages(d, b, words=0)
