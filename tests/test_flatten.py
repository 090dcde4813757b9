import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.operators import flatten as FL


def brute(payload):
    """Paths by plain recursion."""
    out = set()

    def value(v, path, parent):
        if isinstance(v, list):
            for i, x in enumerate(v):
                at = f"{path}/{i}" if path else str(i)
                if isinstance(x, dict):
                    out.add((at, parent))
                    fields(x, at, at)
                else:
                    value(x, at, parent)
        elif isinstance(v, dict):
            fields(v, path, parent)

    def fields(o, path, parent):
        for k, x in o.items():
            if k == "metadata" and isinstance(x, str):
                try:
                    held = json.loads(x)
                    x = held if isinstance(held, dict) else x
                except ValueError:
                    pass
            if k in FL.LIST_FIELDS and isinstance(x, dict):
                x = [x]
            value(x, f"{path}/{k}" if path else k, parent)

    try:
        value(json.loads(payload), "", "")
    except (ValueError, TypeError):
        pass
    return out


names = st.sampled_from(["formulas", "metadata", "alternatives", "context", "refs", "x"])
nested = st.recursive(st.none() | st.integers(0, 9) | st.text("ab", max_size=2), lambda c: st.lists(c, max_size=3) | st.dictionaries(names, c, max_size=3), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(names, nested | nested.map(json.dumps), max_size=4))
def test_paths_against_recursion(value):
    payload = json.dumps(value)
    assert {(p, parent) for _, p, parent, _ in FL.visit(payload)} == brute(payload)


@pytest.mark.parametrize("payload", [None, "", "{", '{"formulas": [{}', "[1, 2", "NaN", '{"formulas": [{"x": NaN}]}', "null", "3"])
def test_invalid_payloads_give_nothing(payload):
    assert list(FL.visit(payload)) == []


def test_details():
    payload = '{"formulas": [null, {"latex": "x", "metadata": "{\\"alternatives\\": {\\"score\\": 1}, \\"tags\\": [\\"a\\"]}"}], "diagrams": {"content": "c"}, "big": ' + "9" * 5000 + "}"
    rows = {p: (tag, parent, json.loads(body)) for tag, p, parent, body in FL.visit(payload)}
    assert rows == {
        "formulas/1": ("formulas", "", {"latex": "x", "tags": ["a"]}),
        "formulas/1/metadata/alternatives/0": ("alternatives", "formulas/1", {"score": 1}),
        "diagrams/0": ("diagrams", "", {"content": "c"}),
    }


def test_deep_nesting():
    depth = 400
    payload = '{"formulas": [' * depth + "{}" + "]}" * depth
    assert sum(1 for _ in FL.visit(payload)) == depth


def test_frames(spark):
    p = '{"formulas": [{"latex": "a", "confidence": 0.5, "metadata": {"alternatives": [{"latex": "b", "score": 0.25}]}}]}'
    rows = [(1, p, "x"), (1, p, "y"), (2, None, None), (3, "{", None), (None, p, None), (4, json.dumps({"formulas": [{"latex": "z" * 100_000}] * 50}), None)]
    df = spark.createDataFrame(rows, "content_id bigint, payload string, object_path string")
    links = {tuple(r) for r in FL.object_links(df).collect()}
    assert FL.object_links(df).count() == len(links) == 2 + 2 + 50
    assert (1, "formulas/0/metadata/alternatives/0", "formulas/0") in links
    folder = FL.write_tables(df)
    formulas = FL.read_table(spark, folder, "formulas")
    assert formulas.count() == 52
    assert formulas.where("content_id = 1").first()["confidence"] == 0.5
    assert FL.read_table(spark, folder, "alternatives").where("content_id = 1").first().score == 0.25
    plan = FL.read_table(spark, folder, "alternatives")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan
    assert FL.object_links(df.limit(0)).count() == 0


def test_links_come_from_the_tables(spark, monkeypatch):
    p = json.dumps({"formulas": [{"latex": "a"}], "": [{"x": 1}, [{}]], "k" * 300: [{"refs": {}}], "others": [{}]})
    df = spark.createDataFrame([(1, p), (1, p), (None, p), (None, '{"formulas": [{"latex": "b"}]}')], "content_id bigint, payload string")
    folders = []
    monkeypatch.setattr(FL, "write_tables", lambda *x, write=FL.write_tables: folders.append(write(*x)) or folders[-1])
    links = sorted(map(str, map(tuple, FL.object_links(df).collect())))
    assert links == sorted(str((i, path, parent)) for i in (1, None) for path, parent in brute(p)) and len(links) == 12
    (folder,) = folders
    assert FL.read_others(spark, folder).where("content_id = 1").count() == 4
    assert FL.read_table(spark, folder, "formulas").where("content_id IS NULL").count() == 2


def test_no_value_of_an_item_is_lost(spark):
    item = {"latex": "a", "page_number": "7a", "odd": 1, "tags": ["t"], "metadata": {"latex": "b", "x": {"odd": 2}}, "refs": [5, {"page": 1}, [None, 6]], "grid": [[1, 2], [3]]}
    payload = json.dumps({"formulas": [item], "extras": [{"k": 3}]})
    df = spark.createDataFrame([(1, payload), (1, payload)], "content_id bigint, payload string")
    folder = FL.write_tables(df)
    (row,) = FL.read_table(spark, folder, "formulas").collect()
    assert (row.latex, row.page_number, row.tags) == ("a", None, ["t"])
    assert json.loads(row.rest) == {"page_number": "7a", "odd": 1, "metadata/latex": "b", "metadata/x/odd": 2, "refs": [5, None, [None, 6]], "grid": [[1, 2], [3]]}
    (row,) = FL.read_table(spark, folder, "refs").collect()
    assert (row.object_path, row.page, row.rest) == ("formulas/0/refs/1", 1, None)
    (row,) = FL.read_others(spark, folder).collect()
    assert (row.field, json.loads(row.body)) == ("extras", {"k": 3})


def test_nesting_beyond_the_decoders_bound():
    depth = 20_000
    payload = '{"formulas": [' * depth + "{}" + "]}" * depth
    assert sum(1 for _ in FL.visit(payload)) == depth
    assert list(FL.visit(payload[:-1])) == list(FL.visit(payload + "]")) == []
    nested = "[" * depth + "1" + "]" * depth
    ((_, path, _, body),) = FL.visit('{"formulas": [{"x": ' + nested + "}]}")
    assert (path, body) == ("formulas/0", '{"x": ' + nested + "}")
    objects = '{"x": ' * depth + "1" + "}" * depth
    assert [body for *_, body in FL.visit('{"formulas": [' + objects + "]}")] == ['{"x": 1}']


def test_tables_of_deep_payloads(spark):
    nested = "[" * 20_000 + "1" + "]" * 20_000
    df = spark.createDataFrame([(1, '{"formulas": [{"latex": "a", "x": ' + nested + "}]}"), (2, '{"formulas": [' * 4_000 + "{}" + "]}" * 4_000)], "content_id bigint, payload string")
    row = FL.read_table(spark, FL.write_tables(df.where("content_id = 1")), "formulas").first()
    assert (row.latex, row.rest) == ("a", '{"x": ' + nested + "}")
    assert FL.emit_tagged(df.where("content_id = 2")).count() == 4_000


@settings(max_examples=400, deadline=None)
@given(nested.map(json.dumps), st.integers(0, 60), st.sampled_from(["", ",", "]", "}", ":", '"', " ", "[", "NaN", "1"]))
def test_decoding_by_a_stack(text, at, put):
    def result(decode, x):
        try:
            return decode(x)
        except ValueError:
            return ValueError

    for x in (text, text[:at], text[:at] + put + text[at:], f" {text}\n", json.dumps(json.loads(text), indent=1)):
        assert result(FL._decode, x) == result(FL._DECODER.decode, x)
