import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.operators import grammar as G


def kinds(latex):
    return [(t.type, t.value) for t in G.parse(latex).tokens]


def test_nested_fractions():
    p = G.parse(r"\frac{1}{\frac{2}{\frac{3}{\frac{4}{5}}}}")
    assert (p.counts["depth"], len(p.tokens)) == (5, 25)
    assert p.complexity == pytest.approx(5.65)


def test_simple_expression():
    p = G.parse("2x^2 + 3x + 1")
    assert p.complexity == pytest.approx(1.65) and not p.errors


@pytest.mark.parametrize(
    "latex, expected",
    [
        (r"\alpha", [("symbol", r"\alpha")]),
        (r"\sin x", [("operator", r"\sin"), ("spacing", " "), ("variable", "x")]),
        (r"\times", [("command", r"\times")]),
        (r"\,", [("spacing", r"\,")]),
        ("\\", [("symbol", "\\")]),
        (r"\begin{align*}", [("environment", r"\begin{align*}")]),
        (r"\begin x", [("environment", r"\begin"), ("spacing", " "), ("variable", "x")]),
        ("1.5e-3", [("number", "1.5e-3")]),
        (".5", [("number", "5")]),
        ("x²", [("variable", "x")]),
        ("a.", [("variable", "a"), ("symbol", ".")]),
        ("[x]", [("delimiter", "["), ("variable", "x"), ("delimiter", "]")]),
        (r"\sqrt[3]{x}", [("command", r"\sqrt"), ("optional", "[3]"), ("group", "{"), ("variable", "x"), ("group", "}")]),
        (r"\sqrt[3", [("command", r"\sqrt"), ("delimiter", "["), ("number", "3")]),
        (r"\sqrt[a[b]\]c]", [("command", r"\sqrt"), ("optional", r"[a[b]\]c]")]),
        ("a|b&!", [("variable", "a"), ("symbol", "|"), ("variable", "b"), ("symbol", "&"), ("symbol", "!")]),
        ("", []),
    ],
)
def test_tokens(latex, expected):
    assert kinds(latex) == expected


def test_options():
    (_, option) = G.parse(r"\box[width=3, color=,x]").tokens
    assert option.metadata["content"] == "width=3, color=,x" and option.metadata["options"] == '{"width": "3", "color": ""}'
    assert [w.message for w in G.parse(r"\box[color=]").warnings] == ["Empty value for option: color", r"Unknown command: \box"]


def test_comments_keep_their_offsets():
    p = G.parse("a % note\nb")
    assert [(t.type, t.value, t.position) for t in p.tokens] == [("variable", "a", 0), ("spacing", " \n", 1), ("comment", "% note", 2), ("variable", "b", 3)]
    assert p.comment_count == 1 and G.parse(r"50\% x").comment_count == 0


def test_macros():
    p = G.parse(r"\newcommand{\half}[1]{x}\def\two{2}\half\two")
    assert p.macros == {"half": (1, "x"), "two": (0, "2")} and p.counts["macros"] == 4
    assert not [w for w in p.warnings if w.type == "unknown_command"]


@pytest.mark.parametrize(
    "latex, errors",
    [
        (r"\frac{a}{b", ["unmatched_brace"]),
        ("a}", ["unmatched_brace"]),
        (r"\left( x", ["unmatched_delimiter"]),
        (r"\right) x", ["unmatched_delimiter"]),
        (r"\left[ x \right]", ["unmatched_delimiter"]),
        (r"\begin{a} \end{b}", ["mismatched_environment", "unclosed_environment"]),
        (r"\end{b}", ["mismatched_environment"]),
        (r"\left( x \right)", []),
        ("", []),
    ],
)
def test_errors(latex, errors):
    assert [e.type for e in G.parse(latex).errors] == errors


def test_warnings():
    p = G.parse(r"\foo (x \foo \times \textbar")
    assert [(w.message, w.position, w.token_index) for w in p.warnings] == [
        ("Possibly unmatched delimiter: (", 5, 2),
        (r"Unknown command: \foo", 0, 0),
        (r"Unknown command: \times", 13, 2),
    ]


def test_tree():
    p = G.parse(r"x^{a b}_c \left. y")
    rows = [(r[2], r[4], r[5], r[6], r[9]) for r in G.node_rows(p.tree)]
    assert rows == [
        ("root", 0, "root", None, False),
        ("child", 1, "subscript", None, True),
        ("base", None, "superscript", None, False),
        ("base", None, "variable", "x", False),
        ("child", None, "variable", "a", False),
        ("child", None, "spacing", " ", False),
        ("child", None, "variable", "b", False),
        ("child", 2, "variable", "c", False),
        ("child", 1, "delimiter_pair", r"\left", False),
        ("delimiter", None, "null_delimiter", ".", False),
        ("child", 1, "variable", "y", False),
    ]
    assert p.counts["nested_scripts"] == 1


def test_script_without_base_or_argument():
    assert [r[5] for r in G.node_rows(G.parse("^").tree)] == ["root", "superscript", "empty"]
    assert [r[5] for r in G.node_rows(G.parse("_{").tree)] == ["root", "subscript", "empty"]


def test_nesting_has_no_bound():
    p = G.parse("{" * 100_000)
    assert p.counts["depth"] == 100_000 and len(p.errors) == 100_000 and p.complexity == 10.0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\{}[]()_^$%&ab1.²é \n+=<>", max_size=60))
def test_any_text_parses(latex):
    p = G.parse(latex)
    assert 0 <= p.complexity <= 10
    rows = G.node_rows(p.tree)
    assert all(r[1] is None or r[1] < r[0] for r in rows)
    assert max((r[4] for r in rows if r[4] is not None), default=0) == p.counts["depth"]
    # Without comments, tokens and dropped characters cover the text.
    if not p.comment_count:
        assert sum(t.length for t in p.tokens) <= len(latex)
