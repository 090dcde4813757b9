import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import visual as V

CASES = [
    ("１８ ｂ ＋ ９", "18 b + 9"),
    ("a\u200b+\u2060b\ufeff", "a+b"),
    ("a\u00a0+\u2003b\u3000", "a + b "),
    ("\\text{Fla\u0308che}", "\\text{Fläche}"),
    ("Fla\u200b\u0308che", "Fläche"),
    ("q\u0303", "q\u0303"),
    ("Р(у = 1)", "P(y = 1)"),
    ("\\text{ratе оf cһangе}", "\\text{rate of change}"),
    ("соѕ", "cos"),
    ("х\u0302", "x\u0302"),
    ("\\text{если} \\text{скорость}", "\\text{если} \\text{скорость}"),
    ("\\text{ес\u200bли}", "\\text{если}"),
    ("\\text{σταθερά} α + π Δz", "\\text{σταθερά} α + π Δz"),
    ("\\text{bοund} Ο(n)", "\\text{bound} O(n)"),
    ("f\u2061(x)\u2062y", "f\u2061(x)\u2062y"),
    ("a\tb\r\nc", "a\tb\r\nc"),
    ("ｅ\u0301", "é"),
    ("其中", "其中"),
    ("Ԍ(х)", "G(x)"),
    ("е\u0308", "ё"),
    ("x\u0591 + ｙ", "x\u0591 + y"),
    ("\u0661 ｘ \U0001d431", "\u0661 x \U0001d431"),
    ("x\u0001", "x"),
    ("", ""),
]


@pytest.mark.parametrize("value, form", CASES)
def test_forms(value, form):
    assert V.BASE.one_form(value) == form
    assert V.BASE.one_form(form) == form


@pytest.mark.parametrize(
    "value, form",
    [
        ("<mi>x&#8203;</mi>", "<mi>x</mi>"),
        ("<mi>x&#xA0;</mi>", "<mi>x </mi>"),
        ("<mo>&#8289;</mo>", "<mo>\u2061</mo>"),
        ("<mi>&#x3B1;</mi>", "<mi>α</mi>"),
        ("<mo>＜</mo><mo>&#60;</mo>", "<mo>&lt;</mo><mo>&lt;</mo>"),
        ("&#xD800; &#0; &#9999999;", "&#xD800; &#0; &#9999999;"),
        ("<mi>&#x445;</mi>", "<mi>x</mi>"),
        ("a&#x00000A0;b&#000000160;c", "a b c"),
    ],
)
def test_markup(value, form):
    assert V.BASE.one_form(value, markup=True) == form


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abx1 \u200b\u00a0\u0301\u0308\u0303оесхлиοＡｂ\u2061é<\t", max_size=20))
def test_one_form_is_stable_and_clean(value):
    form = V.BASE.one_form(value)
    assert V.BASE.one_form(form) == form
    assert unicodedata.normalize("NFC", form) == form
    assert not any(c in "\u200b\u00a0" or "\uff01" <= c <= "\uff5e" for c in form)


def test_grouping_and_joining_back(spark):
    values = [v for v, _ in CASES] + ["x\u200b"] * 3 + ["x\u00ad", "X\u200b", "f\u2061x\u200b", "f\u2062x\u200b", None]
    df = spark.createDataFrame([(i, v, f"<mi>{v}</mi>" if v else v, "clash") for i, v in enumerate(values)], "formula_id int, latex string, mathml string, mapped string")
    rows = V.melt(df)
    got = {(r.row_id, r.field_name): (r.decoded, r.canonical) for r in V.canonical_forms(rows).collect()}
    for r in rows.collect():
        markup = r.field_name == "mathml"
        form = V.BASE.one_form(r.value, markup)
        # Values outside the grouping are their own form.
        assert got.get((r.row_id, r.field_name), (None, r.value))[1] == form
    changed = {k for k, (a, b) in got.items() if a != b}
    assert changed == {(r.row_id, r.field_name) for r in rows.collect() if V.BASE.one_form(r.value, r.field_name == "mathml") != r.value}
    forms = {(r.row_id, r.field_name): r.form for r in V.all_forms(rows).collect()}
    assert forms == {(r.row_id, r.field_name): V.BASE.one_form(r.value, r.field_name == "mathml") for r in rows.collect()}
    assert V.canonical_forms(V.melt(df.limit(0))).count() == 0 == V.all_forms(V.melt(df.limit(0))).count()


def test_other_scripts(spark):
    forms = V.forms_for(spark)
    assert [forms.one_form(x) for x in ("ꓮꓐꓲ", "ⲟⲞ", "ᗅ", "ᎪᎢ", "օս", "a\u05e1", "ლა", "ア")] == ["ABI", "oO", "A", "AT", "ou", "a\u05e1", "ლა", "ア"]


def test_collation_tells_apart_what_looks_different(spark):
    """Each character that enters the grouping as itself has a weight, and no two of them the same unless they are canonically equal."""
    kept = sorted(chr(c) for c in {*range(32, 127), *V.composing(), *range(0x1100, 0x1200)} if not V._invisible.match(chr(c)) and c not in V._SPACES)
    df = spark.createDataFrame([(f"a{c}a",) for c in kept], "s string")
    groups = df.selectExpr("s COLLATE UNICODE AS look", "s").groupBy("look").agg({"s": "collect_set"}).collect()
    for r in groups:
        assert len({unicodedata.normalize("NFC", x) for x in r[1]}) == 1 and "aa" not in r[1], r
    assert df.where("s COLLATE UNICODE = 'aa'").count() == 0
    spelled = V._spelled_out("\u0591\u0661\U0001d431\uf8f0é\u200bx\u2062")
    assert "\u0591" not in spelled and "\u2062" not in spelled and "é\u200bx" in spelled and V._read_back(spelled) == "\u0591\u0661\U0001d431\uf8f0é\u200bx\u2062"


def test_a_form_never_depends_on_other_rows(spark):
    """Marks and letters that the collation alone would take for nothing or for each other, alone and together."""
    odd = ["\u0591", "\u06dd", "\u0661", "\u06f1", "\U0001d431", "\U0001d465", "\u2062", "\u0488", "\U0001d165", "\u0301", "é", "\u1cd0", "二"]
    values = [f"{x} + １{y}" for x in ("x", "х", "ｘ", "x\u200b") for y in ["", *odd]] + [f"x{c}" for c in odd]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "formula_id int, latex string, mathml string")
    together = {r.row_id: r.form for r in V.all_forms(V.melt(df)).collect()}
    assert together == {i: V.BASE.one_form(v) for i, v in enumerate(values)}


def test_collation_decides_the_classes(spark):
    plan = V.canonical_forms(V.melt(spark.createDataFrame([(1, "x\u200b", None)], "formula_id int, latex string, mathml string")))
    text = plan._jdf.queryExecution().toString()
    assert "UNICODE" in text and "SortMergeJoin" in text and "NestedLoop" not in text


@pytest.mark.parametrize("least", [10, 10_000])
def test_hot_class(spark, least):
    df = spark.range(4000).selectExpr("id AS formula_id", "CASE WHEN id % 3 = 0 THEN concat('x', repeat('\u200b', id % 7)) ELSE concat(id, '\u00a0') END AS latex", "CAST(NULL AS STRING) AS mathml")
    got = {r.row_id: r.canonical for r in V.canonical_forms(V.melt(df), least=least).collect()}
    assert all(got.get(i, "x") == ("x" if i % 3 == 0 else f"{i} ") for i in range(4000)) and len(got) > 3500


def test_long_value(spark):
    df = spark.createDataFrame([(1, "x\u200b" * 200_000, None)], "formula_id int, latex string, mathml string")
    assert V.canonical_forms(V.melt(df)).first().canonical == "x" * 200_000
