import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.operators import mathml as M


def flat(latex, **options):
    return re.sub(r"\n\s*", "", M.convert(latex, **options))


@pytest.mark.parametrize(
    "latex, parts",
    [
        (r"\begin{cases} q & r \\ 8 \end{cases}", ["<mtext> if </mtext>", "<mi>q</mi>"]),
        (r"\lim_{h} g", ["lim", "<mi>g</mi>"]),
        ("u > 4", ["<mo>&gt;</mo>", "<mn>4</mn>"]),
        ("_7", ["<msub><mi/><mn>7</mn></msub>"]),
        ("k_{m_{5}}", ["<msub><mi>k</mi><msub><mi>m</mi><mn>5</mn></msub></msub>"]),
        ("t_8^9", ["<msubsup><mi>t</mi><mn>8</mn><mn>9</mn></msubsup>"]),
        ("t^9_8", ["<msubsup><mi>t</mi><mn>8</mn><mn>9</mn></msubsup>"]),
        (r"\sqrt[5]{w}", ["<mroot><mi>w</mi><mn>5</mn></mroot>"]),
        (r"\sqrt{h}", ["<msqrt><mi>h</mi></msqrt>"]),
        (r"\frac{}{s}", ["<mfrac><mrow/><mi>s</mi></mfrac>"]),
        (r"\frac78", ["<mfrac><mn>78</mn><mi/></mfrac>"]),
        (r"\frac{p}{\frac{q}{r}}", ["<mfrac><mi>p</mi><mfrac><mi>q</mi><mi>r</mi></mfrac></mfrac>"]),
        (r"\gamma \leq \Omega", ["<mi>γ</mi>", "≤", "<mi>Ω</mi>"]),
        (r"f \cdot g \mp h \in S", ["⋅", "∓", "∈"]),
        (r"\prod_{r=2}^m r", ['<mo largeop="true" movablelimits="true">∏</mo>']),
        (r"\oint f \, dz", ["∮", '<mspace width="0.5em"/>']),
        (r"5 \text{ is odd}", ["<mtext> is odd</mtext>", "<mn>5</mn>"]),
        (r"\vec{v} + \bar{w}", ["<mover>", '<mo accent="true">→</mo>', '<mo accent="true">¯</mo>']),
        (r"\mathfrak{G}", ['<mstyle mathvariant="fraktur"><mi>G</mi></mstyle>']),
        (r"\binom{5}{j}", ['<mfrac linethickness="0"><mn>5</mn><mi>j</mi></mfrac>']),
        (r"\left( v \right.", ['<mo fence="true" stretchy="true">(</mo><mi>v</mi>']),
        (r"\begin{array}{rl} 6 & 7 \end{array}", ['columnalign="right left"']),
        (r"\begin{align*} v &= 3 \\ &= w \end{align*}", ['columnalign="right left"', '<mtd columnalign="right"/>']),
        (r"\begin{multline} u \\ v \\ w \end{multline}", ['"left"', '"center"', '"right"']),
        ("e - 9 = 0", ['xmlns="http://www.w3.org/1998/Math/MathML"', "<mi>e</mi>", "<mo>−</mo>", "<mo>=</mo>"]),
        (" ", ['display="inline"/>']),
    ],
)
def test_intended(latex, parts):
    got = flat(latex)
    for part in parts:
        assert part in got
    assert M.validate_mathml(got) == []


def test_matrix():
    got = flat(r"\begin{pmatrix} a & b \\ c & d \end{pmatrix}")
    assert got.count("<mtr>") == 2 and got.count("<mtd>") == 4 and ">(</mo>" in got


def test_display_and_limits():
    assert 'display="block"' in M.convert("x", display=True)
    assert M.convert("x" * 10_001) is None and M.convert("x" * 10_000) is not None
    assert M.convert("x" * 10_001, limit=None).count("<mi>") == 10_001
    assert M.convert("a\x01b").count("<mi>") == 2


def test_deep_nesting_gives_an_error_document():
    assert "Failed to convert" in M.convert("{" * 5000)


def test_validation():
    ns = 'xmlns="http://www.w3.org/1998/Math/MathML"'
    assert M.validate_mathml(f"<math {ns}><mi>x</mi></math>") == []
    assert M.validate_mathml(f"<math {ns}><mi>x</mi></math>", "reference") == ["Missing or incorrect MathML namespace"]
    assert M.validate_mathml("<math><mi>x</mi></math>") == ["Missing or incorrect MathML namespace"]
    assert M.validate_mathml(f"<math {ns}><mfrac><mi>x</mi></mfrac><foo/><mi><mn>1</mn></mi></math>") == [
        "Element <mfrac> requires 2 children, found 1",
        "Invalid MathML element: <foo>",
        "Element <mi> should not have child elements",
    ]
    assert M.validate_mathml("<math>")[0].startswith("XML syntax error") and M.validate_mathml("")


def test_optimisation():
    ns = 'xmlns="http://www.w3.org/1998/Math/MathML"'
    got = M.optimise_mathml(f"<math {ns}><mrow><mrow><mi>x</mi></mrow></mrow><mrow/><mstyle><mn>1</mn><mn>2</mn></mstyle><mrow><mi>a</mi><mi>b</mi></mrow></math>")
    assert re.sub(r"\n\s*", "", got) == f"<math {ns}><mi>x</mi><mn>1</mn><mn>2</mn><mrow><mi>a</mi><mi>b</mi></mrow></math>"
    assert M.optimise_mathml("no xml") == "no xml"


def test_symbol_file(tmp_path):
    path = tmp_path / "symbols.json"
    path.write_text('{"operators": {"\\\\foo": "F"}}')
    assert "<mo>F</mo>" in M.convert(r"\foo", symbols=M.load_symbols(str(path)))
    assert M.load_symbols(str(tmp_path / "none.json")) is M.vocab.SYMBOLS


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\{}[]()_^&ab1 \n<%", max_size=40))
def test_any_text_converts_to_xml(latex):
    assert not any(e.startswith("XML") for e in M.validate_mathml(M.convert(latex)))


def test_frames(spark):
    rows = [(1, "x<1", "display"), (2, "", "inline"), (3, None, None), (4, "x" * 10_001, "inline"), (5, "x<1", "inline"), (6, "a\x01", "inline")]
    df = spark.createDataFrame(rows, "id int, latex string, math_type string")
    block = df["math_type"] == "display"
    ref = {r.id: r.mathml for r in M.to_mathml(df, display=block).collect()}
    assert ref[1] == '<math xmlns="http://www.w3.org/1998/Math/MathML" display="block">\n  <merror>\n    <mtext>Failed to convert: x&lt;1...</mtext>\n  </merror>\n</math>\n'
    assert ref[1] == M.error_document("x<1", True) and ref[5] == M.error_document("x<1")
    assert ref[2] == '<math xmlns="http://www.w3.org/1998/Math/MathML" display="inline"/>\n' and ref[3] is ref[4] is ref[6] is None
    done = M.to_mathml(df, "intended", display=block)
    got = {r.id: r.mathml for r in done.collect()}
    assert got[1] == M.convert("x<1", True) and got[5] == M.convert("x<1") and got[3] is got[4] is None
    checked = {r.id: (r.is_valid, r.errors) for r in M.validate(done).collect()}
    assert checked[1] == (True, []) and checked[3] == (None, None)
    assert {r.id: r.optimised for r in M.optimise_documents(done).collect()}[1] == got[1]
    assert M.to_mathml(df.limit(0), "intended").count() == 0
    with pytest.raises(ValueError):
        M.to_mathml(df, "other")
