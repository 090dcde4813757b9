import re

import pytest
from pyspark.sql import functions as F

from mathloom.functions import latex as L


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first().r


def python_normal(latex, preserve=False, aggressive=False):
    out = re.sub(r"\s+", " ", latex.strip())
    for name in ("limits", "nolimits", *(("left", "right") if aggressive else ())):
        out = re.sub(rf"\\{name}\s*", "", out)
    if not preserve and aggressive:
        out = re.sub(r"\\(quad|qquad)\s*", " ", re.sub(r"\\[,;:!]\s*", " ", out))
    elif not preserve:
        out = re.sub(r"\\,(?![a-zA-Z])", " ", out)
        out = re.sub(r"\\,\s*(?=d[a-z])", r"\\,", out)
        out = re.sub(r"(?<=[0-9])\s*\\,\s*(?=[0-9])", " ", out)
    out = re.sub(r"\s*([_^])\s*", r"\1", out)
    return re.sub(r"\s+", " ", re.sub(r"\s*([+\-*/=<>])\s*", r" \1 ", out)).strip()


SAMPLES = ["x+y=z", " x \u2003+ y ", r"\sum\limits_{i} x", r"\left( a \right)", r"a\,b \, dx", r"1 \, 2", r"a \quad b\;c", "x _ 1 ^ 2", "", "\u3000", r"\int f\,dx", r"2\,3\,d x", "é+\u00a0ß"]


@pytest.mark.parametrize("options", [{}, {"preserve": True}, {"aggressive": True}])
def test_normalize(spark, options):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "v string")
    keywords = {"preserve_spacing": options.get("preserve", False), "aggressive": options.get("aggressive", False)}
    got = [r.r for r in df.select(L.normalize(F.col("v"), **keywords).alias("r")).collect()]
    assert got == [python_normal(s, **options) for s in SAMPLES]


def test_equal_formulas_share_a_hash(spark):
    a, b = (one(spark, v, L.formula_hash) for v in ("x+y=z", "x + y = z"))
    assert a == b and len(a) == 16


@pytest.mark.parametrize("raw, expected", [("x + y = z", 0.5 + 2 * 0.05 + 0.1), ("hello world", 0.6), ("x", 0.5), ("", 0.5), (None, None), (r"\frac{\alpha}{\beta^2_1} + - = < > \sqrt \sum \int \prod", 1.0)])
def test_confidence(spark, raw, expected):
    got = one(spark, raw, L.confidence)
    assert got == expected or got == pytest.approx(expected)


@pytest.mark.parametrize("text, expected", [(" a/b ", r"\frac{a}{b}"), ("1/2/3", "1/2/3"), ("x>=pi/2", r"x\geq\pi/2"), ("point", r"po\int"), ("/b", "/b"), ("", ""), (None, None)])
def test_text_to_latex(spark, text, expected):
    assert one(spark, text, L.text_to_latex) == expected


@pytest.mark.parametrize("latex, expected", [("{a}", 0), ("{a", 1), ("}a{", 2), (r"\{a", 0), ("", 0), (None, None)])
def test_brace_errors(spark, latex, expected):
    assert one(spark, latex, L.brace_errors) == expected


@pytest.mark.parametrize(
    "output, expected",
    [
        ("line\n! Undefined control sequence.\nl.5 \\foo\n\nmore", "! Undefined control sequence. l.5 \\foo"),
        ("! a\nb\nc\n! d", "! a b c"),
        ("one\ntwo\n\nthree\nfour", "two three four"),
        ("", "Unknown error"),
        ("\n \n", "Unknown error"),
    ],
)
def test_latex_error_message(spark, output, expected):
    assert one(spark, output, L.latex_error_message) == expected


def test_bands(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (0.5,), (0.1,), (None,)], "c double")
    assert [r.r for r in df.select(L.confidence_band(F.col("c")).alias("r")).collect()] == ["high", "medium", "medium", "low", None]


def test_very_long_formula(spark):
    assert len(one(spark, "x+" * 50_000, lambda c: L.normalize(c, aggressive=True))) == 4 * 50_000 - 1
