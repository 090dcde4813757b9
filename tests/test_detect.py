import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.operators import detect as D

TEMPLATES = [
    "$x_{#} + y^{2} = z$",
    "$$E = mc^2 + #$$",
    r"\[ \frac{a_#}{b} \]",
    r"\( \sqrt{x^2 + y^2} \)",
    r"\begin{pmatrix} a & b \\ c & # \end{pmatrix}",
    r"\begin{align} x &= # \\ y &= 2 \end{align}",
    r"\begin{equation} \int_0^{\infty} e^{-x^2} \, dx = \frac{\sqrt{\pi}}{#} \end{equation}",
    r"\begin{equation*} \sum_{i=1}^n i = \prod\limits_{j=1}^m \left( j \right) \end{equation*}",
    r"\begin{align*} \alpha + \beta &= \gamma \quad # \end{align*}",
]


def brute(text):
    """All nine patterns by themselves, with nothing skipped."""
    found = [(m.start(), m.end(), kind, m[1].strip()) for kind, p in D.PATTERNS for m in re.finditer(p, text)]
    return sorted(found, key=lambda f: f[0])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$$E = mc^2$$", [(0, "display", "E = mc^2"), (1, "inline", "E = mc^2")]),
        (r"Price is \$100 and formula is $x + y$", [(10, "inline", "100 and formula is")]),
        ("$a\nb$", []),
        (r"\[ a", []),
        ("", []),
        (r"\begin{pmatrix}1\end{bmatrix}", [(0, "matrix", "1")]),
        ("é $x$", [(2, "inline", "x")]),
    ],
)
def test_reference_semantics(text, expected):
    assert [(a, k, x) for _, a, _, k, x, _ in D.find(text)] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$$E = mc^2$$", [(0, "display", "E = mc^2")]),
        (r"Price is \$100 and formula is $x + y$", [(30, "inline", "x + y")]),
        (r"\[ \begin{pmatrix} $a$ \end{pmatrix} \]", [(0, "display", r"\begin{pmatrix} $a$ \end{pmatrix}")]),
        (r"$\$5 + x$", [(0, "inline", "$5 + x")]),
        ("$$a$$ b $c$ $$d$$ and $e$", [(0, "display", "a"), (8, "inline", "c"), (12, "display", "d"), (22, "inline", "e")]),
        (r"$a$ \[ b \] $c$", [(0, "inline", "a"), (4, "display", "b"), (12, "inline", "c")]),
    ],
)
def test_intended_semantics(text, expected):
    assert [(a, k, x.replace("\\$", "$")) for _, a, _, k, x, _ in D.find(text, "intended")] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"We see $a$ and $M = \begin{pmatrix}1 & 2\end{pmatrix} + q$ for all $c$ here", ["a", r"M = \begin{pmatrix}1 & 2\end{pmatrix} + q", "c"]),
        (r"\(\begin{bmatrix} 1 \\[2pt] 2 \end{bmatrix} = v\) and $x$", [r"\begin{bmatrix} 1 \\[2pt] 2 \end{bmatrix} = v", "x"]),
        (r"\begin{pmatrix} $a$ \end{pmatrix} and $b$", ["$a$", "b"]),
        (r"\begin{equation} x $$y$$ \end{equation} $z$", ["x $$y$$", "z"]),
        ("$a$$b$ and $$c$$", ["a", "b", "c"]),
        ("costs $5: $$x$$ and $y$", ["x", "y"]),
        (r"costs $5. \[ x \] and $y$", ["x", "y"]),
        (r"\[ a $$b$$ \[ c \] \( d \( e \)", ["b", "c", "e"]),
        ("$$ open and $x$", ["open and"]),
    ],
)
def test_the_outermost_opener_wins(text, expected):
    found = D.find(text, "intended")
    assert [x for *_, x, _ in found] == expected
    assert all(raw in text[a:b] for _, a, b, _, _, raw in found)


def test_unclosed_openers_take_linear_time_as_intended():
    text = r"\[ x " * 20_000 + r"\( \begin{pmatrix} " * 20_000 + "$$a$$ " * 20_000 + r"\) \end{pmatrix}"
    assert len(D.find(text, "intended")) == 20_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*TEMPLATES, "$", "$$", r"\[", r"\]", r"\(", r"\)", r"\begin{align}", r"\end{align}", r"\end{matrix}", "text", "\n", "é"]), max_size=12))
def test_skipping_hopeless_openers_changes_nothing(parts):
    text = " ".join(parts).replace("#", "7")
    assert [(a, b, k, x) for _, a, b, k, x, _ in D.find(text)] == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*TEMPLATES, "$", "$$", r"\\$", "text", "\n"]), max_size=12))
def test_intended_spans_never_overlap(parts):
    spans = [(a, b) for _, a, b, *_ in D.find(" ".join(parts), "intended")]
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_many_formulas_take_little_time():
    assert len(D.find("$x$ and $$y$$ " * 20_000, "intended")) == 40_000


def test_unclosed_openers_take_linear_time():
    text = r"\[ x " * 20_000 + r"\begin{equation} " * 20_000
    assert D.find(text) == []


def test_frame(spark):
    rows = [(1, "$x + y = z$ and $n$", "s"), (1, "$x + y = z$ and $n$", "s"), (2, None, "s"), (3, "", None), (4, "no formula", "s"), (None, "$$q$$", "s")]
    df = spark.createDataFrame(rows, "doc_id int, text string, latex string")
    got = D.detect(df).collect()
    assert sorted((r.doc_id or 0, r.ordinal, r.math_type, r.latex) for r in got) == sorted(
        [(1, 0, "inline", "x + y = z"), (1, 1, "inline", "n")] * 2 + [(0, 0, "display", "q"), (0, 1, "inline", "q")]
    )
    first = next(r for r in got if r.latex == "x + y = z")
    assert first.confidence == 0.5 + 2 * 0.05 + 0.1 and first.position.y == 0 and first.position.width == 100
    assert D.detect(df.limit(0)).count() == 0
    assert D.detect(df, min_confidence=0.7).count() == 2


def test_very_long_text(spark):
    text = "Let $x = 1$ be a number. " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert D.detect(df).count() == 20_000


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "$x$", 9, 9, "raw")], "doc_id int, text string, start int, `end` int, raw string")
    (row,) = D.detect(df).collect()
    assert (row.start, row.end, row.raw) == (0, 3, "x")


def test_environments(spark):
    df = spark.createDataFrame([(1, r"\begin{align*}a\end{align*}\begin{cases}\begin{cases}"), (2, None)], "doc_id int, text string")
    assert {(r.doc_id, r.environment, r.n) for r in D.environments(df).collect()} == {(1, "align*", 1), (1, "cases", 2)}


def test_every_pattern(spark):
    df = spark.createDataFrame([(i, t.replace("#", str(i))) for i, t in enumerate(TEMPLATES)], "doc_id int, text string")
    kinds = {(r.doc_id, r.math_type) for r in D.detect(df).collect()}
    assert kinds == {(0, "inline"), (1, "display"), (1, "inline"), (2, "display"), (3, "inline"), (4, "matrix"), (5, "align"), (6, "equation"), (7, "equation"), (8, "align")}
