from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import heavy as H


def summary(values, capacity, step=7):
    s = H.Summary(capacity)
    for i in range(0, len(values), step):
        c = Counter(values[i : i + step])
        s.add(pa.array([*c], pa.string()), pa.array([*c.values()], pa.int64()), len(values[i : i + step]))
    return s


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aaabbcdefgh"), max_size=40), min_size=1, max_size=5), st.integers(1, 6))
def test_guarantee_through_merges(parts, capacity):
    merged = H.Summary(capacity)
    for p in parts:
        s = summary(p, capacity)
        merged.add(s.items, s.kept, s.seen, s.lost)
    true = Counter(x for p in parts for x in p)
    n = sum(true.values())
    kept = dict(zip(merged.items.to_pylist(), merged.kept.to_pylist(), strict=True))
    assert merged.seen == n and len(kept) <= capacity and merged.lost <= n / (capacity + 1)
    for item, count in true.items():
        assert count - merged.lost <= kept.get(item, 0) <= count


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_frames(spark, parts):
    values = ["hot"] * 400 + [""] * 50 + [f"v{i}" for i in range(550)] + [None] * 100
    df = spark.createDataFrame([("f", v, 1) for v in values] + [("g", "only", 1)] + [("h", None, 1)], "field_name string, item string, seen int").repartition(parts)
    got = {(r.field_name, r.item): (r.approx_count, r.max_error, r.seen_rows) for r in H.frequent_items(df, 0.05).collect()}
    assert {("f", "hot"), ("f", ""), ("g", "only")} <= set(got)
    for (field, item), (low, error, n) in got.items():
        true = values.count(item) if field == "f" else 1
        assert low <= true <= low + error and n == (1000 if field == "f" else 1)
    exact = {(r.field_name, r.item, r.n, r.seen_rows) for r in H.exact_frequent(df, 0.05).collect()}
    assert exact == {("f", "hot", 400, 1000), ("f", "", 50, 1000), ("g", "only", 1, 1)}


def test_edges(spark):
    empty = spark.createDataFrame([], "field_name string, item string")
    assert H.frequent_items(empty).count() == 0 and H.exact_frequent(empty).count() == 0
    long = spark.createDataFrame([("f", "x" * 1_000_000)] * 3, "field_name string, item string")
    assert H.exact_frequent(long).first().n == 3
    with pytest.raises(ValueError):
        H.frequent_items(empty, 0)
    with pytest.raises(ValueError):
        H.frequent_items(empty, 0.01, capacity=10)
