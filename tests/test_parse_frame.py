import pytest
from pyspark.sql import functions as F

from mathloom.operators import grammar, parse
from mathloom.plans import queries


@pytest.fixture(scope="module")
def formulas(spark):
    rows = [(1, r"\frac{a}{b}", 5), (2, r"\frac{a}{b}", 6), (3, "", 7), (4, None, 8), (5, r"x^2 + \widehat{y} \begin{bmatrix}1\end{bmatrix}", 9), (6, r"\int_0^1 \left( x \right)", 1)]
    return spark.createDataFrame(rows, "id int, latex string, token_count int")


def test_parts(formulas):
    got = {r.id: r for r in parse.parse(formulas, tuple(parse.PARTS)).collect()}
    assert len(got) == 6
    assert got[1].token_count == 7 and got[1].is_valid and got[1].tree_depth == 2
    assert [t.value for t in got[2].tokens] == [r"\frac", "{", "a", "}", "{", "b", "}"]
    assert (got[3].is_valid, got[3].token_count, got[3].tree_depth, got[3].complexity_score) == (True, 0, 0, 0.0)
    assert all(got[4][p] is None for p in parse.PARTS)
    assert got[5].nodes[0].type == "root" and got[5].counts.matrices == 1
    assert got[1].tokens[0].metadata == {}


def test_python_is_planned_once(formulas):
    plan = parse.parse(formulas, ("is_valid", "complexity_score", "token_count"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_empty(formulas):
    assert parse.parse(formulas.limit(0)).count() == 0
    assert parse.parse_distinct(formulas).count() == 4


def test_simple_and_size(formulas):
    parsed = parse.parse(formulas, ("tokens", "tree_depth", "complexity_score"))
    t, d, c = F.col("tokens"), F.col("tree_depth"), F.col("complexity_score")
    got = {r.id: r for r in parsed.select("id", parse.is_simple(t, d, c).alias("simple"), parse.render_size(t, d).alias("size"), parse.components(t).alias("parts")).collect()}
    assert [got[i].simple for i in (1, 3, 5)] == [False, True, False]

    def size(latex):
        p = grammar.parse(latex)
        values = [x.value for x in p.tokens]
        width = sum(x.type not in ("spacing", "comment") for x in p.tokens) * (12.0 * 0.6) * 0.5
        height = 12.0 * 1.2
        if r"\frac" in values:
            height, width = height * (2.0 + 1 * 0.2), width * 0.9
        if "bmatrix" in latex:
            height, width = height * (2.5 + 1 * 0.5), width * 1.5
        if r"\int" in values:
            height, width = height * 1.8, width * 1.2
        for _ in range(values.count(r"\left") + values.count(r"\right")):
            height *= 1.1
        scripts = sum(x.type in ("subscript", "superscript") for x in p.tokens)
        if scripts:
            height *= 1 + min(scripts * 0.2, 0.6)
        height *= 1 + p.counts["depth"] * 0.1
        if r"\widehat" in values:
            height *= 1.2
        return round(width), round(height)

    for r in formulas.where("latex IS NOT NULL").collect():
        assert tuple(got[r.id].size) == size(r.latex)
    parts = got[5].parts
    assert parts.accents == [r"\widehat"] and parts.environments == ["bmatrix"] == parts.matrices and parts.variables == ["x", "y"] and parts.numbers == ["2", "1"]


def test_macro_definitions(spark):
    df = spark.createDataFrame([(1, "\\newcommand{\\a}[2]{x\ny} \\def\\b{z} \\newcommand{\\c}{}"), (2, None), (3, "plain")], "id int, latex string")
    assert {tuple(r) for r in parse.macro_definitions(df, ("id",)).collect()} == {(1, "a", 2, "x\ny"), (1, "b", 0, "z")}


@pytest.mark.parametrize("chunk", [1, 2, 20_000])
def test_document_macros(spark, chunk):
    rows = [
        (1, 0, r"\newcommand{\a}{x}"), (1, 1, r"\a + \a"), (1, 2, r"\def\a{y} \def\b{z}"), (1, 5, r"\a \b"), (1, 6, r"\b}"),
        (2, 0, r"\a"), (2, 1, None), (3, 0, "}"), (None, 0, r"\a"), (4, None, r"\def\c{x}\c"), (5, 3, r"\c"), (5, 4, r"\def\c{x}"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, ordinal int, latex string")
    got = {(r.doc_id, r.ordinal): (r.is_valid, r.macro_count) for r in parse.parse_with_document_macros(df, chunk=chunk).collect()}
    # A definition names its macro once in itself.
    want = {(1, 0): (True, 1), (1, 1): (True, 2), (1, 2): (True, 2), (1, 5): (True, 2), (1, 6): (False, 1), (2, 0): (True, 0), (3, 0): (False, 0), (None, 0): (True, 0), (4, None): (True, 2), (5, 3): (True, 0), (5, 4): (True, 1)}
    assert got == want
    ordered = df.where("doc_id = 1").orderBy("ordinal").collect()
    macros, folded = {}, {}
    for r in ordered:
        p = grammar.parse(r.latex, macros=macros)
        macros = p.macros
        folded[1, r.ordinal] = (not p.errors, p.counts["macros"])
    assert folded == {k: v for k, v in got.items() if k[0] == 1}


def test_latex_code_by_language_or_content(spark, tmp_path):
    rows = [
        (1, 0, r"\newcommand{\rate}[1]{#1}", None), (1, 1, r"\rate{15} + 127", "latex-0.10"), (1, 2, r"\rate{2}", "{.latex 0_3}"), (1, 3, r"\rate{3}", "Latex"), (1, 4, r"\rate{4}", "lang 0/16"),
        (1, 5, r"print('\n')", None), (1, 6, r"re.sub(r'\\frac{1}{2}', x)", "python"), (1, 7, "x = 1", "text-0.12"), (1, 8, "a {b}", ""), (1, 9, None, None), (1, 10, "x", "tex"),
    ]
    spark.createDataFrame(rows, "doc_id bigint, ordinal int, code string, language string").write.parquet(str(tmp_path / "code_blocks.parquet"))
    got = {r.ordinal: r.macro_count for r in queries.QUERIES["document_macros"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 10]
    assert got[1] == got[2] == got[3] == got[4] == 1
