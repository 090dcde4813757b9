from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mathloom.llm import formatting as D


@pytest.mark.parametrize(
    "one, two, same",
    [
        ("x + y", "X+Y", True),
        (r"\left( a \right)", "(a)", True),
        (r"\leftarrow a", "arrow a", False),
        (r"a \quad b\,c\;d", "abcd", True),
        (r"\quadratic", "ratic", False),
        ("a \\\\\\qquad b", "a \\\\ b", True),
        ("a \\\\, b", "a \\\\ b", True),
        ("a.", "a", True),
        ("a-b", "a b", False),
        ("１ ＋ х", "1+x", True),
        ("a\u200bb", "ab", True),
        ("ＡＢ\u2003c", "abc", True),
        (r"\text{Größe}", r"\TEXT{GRÖßE}", True),
    ],
)
def test_latex(one, two, same):
    assert (D.odd_latex_text(one) == D.odd_latex_text(two)) is same


@pytest.mark.parametrize(
    "one, two, same",
    [
        ('{"a": 1, "b": {"c": [1, 2], "d": null}}', "{'b'}", False),
        ('{"a": 1, "b": {"c": [1, 2], "d": null}}', '{\n "B": {"d": NULL, "c": [1,2]}, "a": 1 }', True),
        ('{"a": 1, "b": {"c": [1, 2], "d": null}}', '{\n "b": {"d": null, "c": [1,2]}, "A": 1 }', True),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
        ('{"a": 1.0}', '{"a": 1.00}', False),
        ('[{"a": 1, "b": 2}]', '[{"b": 2, "a": 1}]', False),
        ("print('a')", 'PRINT("a");', True),
        ("a\u2003b\u00a0", "ab", True),
    ],
)
def test_code(one, two, same):
    assert (D.odd_code_text(one) == D.odd_code_text(two)) is same


def test_deep_json():
    assert D.json_text("{" + '"a": {' * 500 + "}" * 501) is not None
    assert D.json_text('{"a": "b\\"{c"}') == "{ab\\{c}"
    deep = "[" * 50_000 + "]" * 50_000
    assert D.json_text(f'{{"a": {deep}, "b": 1}}') == D.json_text(f'{{"b": 1, "a": {deep}}}') is not None
    long = "7" * 5_000
    assert D.json_text(f'{{"a": 1, "b": {long}}}') == D.json_text(f'{{"b": {long}, "a": 1}}') is not None


@pytest.mark.parametrize("code", ["", "{", "{}}", "{} {}", "[]", "1", '{"a"}', '{"a": }', '{"a": 1,}', '{"a": 01}', "{'a': 1}", '{"a": [1 2]}', '{"a": "\n"}', '{"a": NaN}', '{, "a": 1}', '{"a": 1 "b": 2}', '{"a": 1]', "{:}"])
def test_not_a_json_object(code):
    assert D.json_text(code) is None


VALUES = ["x + y", "X+Y.", "x+y", "x+y", "a", "a", r"\left(b\right)", "(B)", "", " ", None, "１+x", "1 + x", "z" * 100_000, "Z" * 100_000 + ";"]


def expected(values, text):
    groups = defaultdict(list)
    for i, v in enumerate(values):
        if v is not None:
            groups[text(v)].append((i, v))
    return {(g[0][0], i) for g in groups.values() if len({v for _, v in g}) > 1 for i, _ in g[1:]}, groups


@pytest.mark.parametrize("kind, text", [("latex", D.odd_latex_text), ("code", D.odd_code_text)])
def test_frames(spark, kind, text):
    values = VALUES + ['{"a": 1, "b": 2}', '{"b": 2, "a": 1}', "{x", "{ x"]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "id int, value string, digest string")
    hashed = D.hashed(df, kind)
    want, groups = expected(values, text)
    assert {tuple(r) for r in D.copy_members(hashed).collect()} == want
    got = {(r.first_id, r.copies, r.differ) for r in D.copy_groups(hashed).collect()}
    assert got == {(g[0][0], len(g), len({v for _, v in g}) > 1) for g in groups.values()}
    assert D.collisions(D.copy_groups(hashed)).count() == 0
    assert D.copy_members(D.hashed(df.limit(0), kind)).count() == 0


def test_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("x y")).when(F.col("id") == 1, F.lit("xy")).otherwise(F.col("id").cast("string")).alias("value"))
    for least in (10, 10_000):
        members = D.copy_members(D.hashed(df, "latex"), least=least)
        assert members.count() == 1000 and members.where("first_id <> 0").count() == 0


def test_collisions_are_kept_apart_and_reported(spark):
    rows = spark.createDataFrame([(1, b"d", 5, 1), (2, b"d", 5, 2), (3, b"d", 6, 3)], "id bigint, digest binary, check bigint, stored bigint")
    assert {tuple(r) for r in D.copy_members(rows).collect()} == {(1, 2)}
    assert D.collisions(D.copy_groups(rows)).first().texts == 2
