import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import abuse as A

CLEAN = ["The operator is linear and $x + 1$ holds.", "Table 4 lists the mass of each reactor.", "Note that the bound is sharp for every prime.", "The word jerk is counted in our moderation study.", "Run the solver with 3 threads and kill the child."]
TOXIC = ["You are a worthless jerk and everyone knows it.", "Shut up, you filthy jerk, nobody asked you.", "I will find you and break your fingers, loser."]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [rng.choice(CLEAN) for _ in range(rng.randint(2, 9))]
        toxic = i % 10 == 0
        if toxic:
            parts.insert(rng.randrange(len(parts)), rng.choice(TOXIC))
        rows.append((i, " ".join(parts), toxic))
    return rows


@pytest.mark.parametrize(
    "text, plain",
    [
        ("Y0u p4r4s1t3!", " you parasite! "),
        ("f.i.l.t.h.y  dumbаѕѕ", " filthy dumbass "),
        ("HATEEEE c-a-g-e-s", " hate cages "),
        ("x_{73} 123", " x_{0} 0 "),
        ("", "  "),
    ],
)
def test_plain_text(text, plain):
    assert A.plain_text(text) == plain


def frames(spark, rows, rated):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id int, text string")
    return docs, spark.createDataFrame([(i, int(y)) for i, y in rated], "doc_id int, toxic int")


def test_held_out_accuracy_with_wrong_ratings(spark):
    train = corpus(1500, 1)
    rng = random.Random(5)
    rated = [(i, y if rng.random() > 0.02 else not y) for i, _, y in train]
    weights, level = A.fitted(*frames(spark, train, rated))
    test = corpus(600, 2)
    flags = A.worst_windows([A.plain_text(t) for _, t, _ in test], weights)[0] + A.BIAS > level
    assert sum(f == y for f, (_, _, y) in zip(flags, test, strict=True)) >= 0.99 * len(test)
    shouted = "filler text about a bound. " * 400 + "SHUT UP, YOU F1LTHY JERK, NOBODY ASKED YOU." + " more filler" * 400
    assert A.worst_windows([A.plain_text(shouted)], weights)[0][0] + A.BIAS > level


def test_nothing_to_learn_from(spark):
    for texts, rated in (([], []), (["a"] * 20, [0] * 20), (["a"] * 20, [1] * 20), (["a", "b"], [0, 1])):
        rows = [(i, t, None) for i, t in enumerate(texts)]
        assert A.fitted(*frames(spark, rows, enumerate(rated))) is None


def slow_worst(text, weights):
    values = [sum(float(weights[g[0]]) for n in A.LENGTHS if i + n <= len(text) for g in [A.Texts([text[i : i + n]]).grams[A.LENGTHS.index(n)]]) for i in range(len(text))]
    starts = range(max(1, len(text) - A.WINDOW + 1))
    return max(sum(values[i : i + A.WINDOW]) for i in starts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab ü😀", max_size=70), max_size=6))
def test_windows_of_many_texts_are_those_of_each(texts):
    weights = np.random.default_rng(1).normal(size=2**A.BITS).astype(np.float32)
    scores, windows = A.worst_windows(texts, weights)
    assert (A.worst_scores(texts, [weights, -weights]) == [scores, A.worst_windows(texts, -weights)[0]]).all()
    for text, score, window in zip(texts, scores, windows, strict=True):
        assert score == pytest.approx(slow_worst(text, weights) if text else 0.0, abs=1e-4) and window in text


@pytest.mark.parametrize("piece", [60, 10**6])
def test_windows(monkeypatch, piece):
    """A text longer than a piece has its worst window, also where pieces meet."""
    monkeypatch.setattr(A, "PIECE", piece)
    weights = np.zeros(2**A.BITS, np.float32)
    assert A.worst_windows(["", "a"], weights)[0].tolist() == [0.0, 0.0]
    weights[A.Texts(["bad"]).features()[1]] = 1.0
    for n in (500, 540, 3):
        scores, windows = A.worst_windows(["x" * n + "bad" + "y" * 500, "y" * 9], weights)
        assert scores.tolist() == [3.0, 0.0] and "bad" in windows[0]
        assert A.worst_scores(["x" * n + "bad" + "y" * 500, "y" * 9], [weights]).tolist() == [[3.0, 0.0]]


def test_level_is_in_the_gap():
    rng = np.random.default_rng(2)
    scores = np.concatenate((rng.uniform(-20, -6, 900), rng.uniform(2, 9, 100)))
    toxic = np.append(np.zeros(900, bool), np.ones(100, bool))
    wrong = rng.random(1000) < 0.02
    assert -6.1 < A.level_of(scores, toxic ^ wrong) < 2.1


def test_frames(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, 0.5) for i, t, _ in rows] + [(900, None, "s", 0.1), (901, "", "s", 0.1)], "doc_id int, text string, source string, score double")
    labels = [(i, 3, int(y)) for i, _, y in rows] + [(0, 1, 0), (1, None, None), (900, 2, 1), (777, 1, 1)]
    rated = spark.createDataFrame(labels, "doc_id int, quality int, toxic int")
    got = {r.doc_id: r for r in A.scored(docs, rated).collect()}
    assert len(got) == 402 and got[900].score is None and not got[900].flagged and not got[901].flagged
    wrong = [i for i, _, y in rows if got[i].flagged != y]
    assert len(wrong) <= 4
    rates = {r.source: r for r in A.source_rates(A.scored(docs, rated)).collect()}
    assert rates[None].documents == 200 and rates["s"].documents == 202 and rates[None].rate > rates["s"].rate
    blank = A.scored(docs, rated.limit(0)).collect()
    assert not any(r.flagged for r in blank) and {r.score for r in blank} == {A.BIAS, None}
    assert A.scored(docs.limit(0), rated).count() == 0
