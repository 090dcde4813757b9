from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import terms as T


def counted(trie):
    return {p + s: (o, r) for p, ss, os, rs in trie.subtrees() for s, o, r in zip(ss, os, rs, strict=True)}


def containers(node):
    if isinstance(node, dict):
        yield node
    else:
        for child in node.children.values():
            yield from containers(child)


WORDS = st.lists(st.text("ab\\é", max_size=5) | st.text("ab", max_size=2).map(lambda s: "a" * 9 + s), max_size=60)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.integers(1, 4))
def test_trie_counts_and_covers(words, burst):
    trie = T.BurstTrie(burst)
    for w in words:
        trie.add(w, 1, 1)
    got = counted(trie)
    assert got == {w: (n, n) for w, n in Counter(words).items()} and len(trie) == len(got)
    assert [p + s for p, ss, _, _ in trie.subtrees() for s in ss] == sorted(got)
    assert all(len(c) <= burst for c in containers(trie.root))


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5), st.integers(1, 4), st.integers(1, 4))
def test_merged_tries_count_as_one(parts, burst, other):
    """Subtrees of tries that burst at different depths, in any order."""
    whole = T.BurstTrie(burst)
    for words in parts:
        trie = T.BurstTrie(other)
        for w in words:
            trie.add(w, 2, 1)
        for subtree in [*trie.subtrees()][::-1]:
            whole.graft(*subtree)
    assert counted(whole) == {w: (2 * n, n) for w, n in Counter(w for ws in parts for w in ws).items()}
    assert all(len(c) <= burst for c in containers(whole.root))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=6), st.integers(1, 9)), min_size=1, max_size=80), st.integers(1, 8))
def test_lighter_summaries_keep_weight_and_order(summary, size):
    kept = T.lighter(summary, size)
    assert sum(n for _, n in kept) == sum(n for _, n in summary)
    prefixes = [p for p, _ in kept]
    assert prefixes == sorted(set(prefixes)) and prefixes[0] == ""
    # Each prefix is the beginning of a value, so a value's weight lies under the last prefix at or before it.
    true = Counter()
    for value, n in summary:
        true[max(p for p in prefixes if p <= value)] += n
    assert true == Counter(dict(kept))


def frame(spark, rows):
    return spark.createDataFrame(rows, "field_name string, terms array<string>")


@pytest.mark.parametrize("burst, most, route_terms", [(2048, 500_000, 500_000), (2, 3, 2)])
def test_frames(spark, burst, most, route_terms):
    rows = [("f", ["\\a", "\\a", f"\\t{i}"]) for i in range(400)] + [("f", None), ("f", []), ("f", [None, ""]), ("g", ["\\a"])]
    got = {(r.field_name, r.term): (r.occurrences, r.records) for r in T.count_terms(frame(spark, rows).repartition(6), burst, most, route_terms).collect()}
    assert got == {("f", "\\a"): (800, 400), ("f", ""): (1, 1), ("g", "\\a"): (1, 1)} | {("f", f"\\t{i}"): (1, 1) for i in range(400)}


def test_long_common_prefix_is_divided(spark):
    """Terms that share 200 characters go to many routes of like size, and are counted right."""
    same = "x" * 200
    df = spark.range(100_000).selectExpr("'f' AS field_name", f"array(concat('{same}', id % 50000)) AS terms").repartition(5)
    rows = df.withColumn("distinct_terms", df.terms)
    subtrees = rows.mapInArrow(T._count(2048, 500_000), T.SUBTREE).cache()
    routes = T.routes_of(subtrees, 5_000)["f"]
    assert len(routes) >= 10 and all(p == "" or p.startswith(same) and len(p) < 206 for p in routes)
    sizes = Counter()
    for r in subtrees.mapInArrow(T._split({"f": routes}), "route int, " + T.SUBTREE).collect():
        sizes[r.route] += len(r.suffixes)
    assert max(sizes.values()) <= 10_000 and sum(sizes.values()) == subtrees.selectExpr("sum(size(suffixes))").first()[0]
    got = T.count_terms(df, route_terms=5_000)
    assert got.selectExpr("count(*)", "count(DISTINCT term)", "min(occurrences)", "max(records)").first() == (50_000, 50_000, 2, 2)
    subtrees.unpersist()


def test_hot_term(spark):
    df = spark.range(9_000).selectExpr("'f' AS field_name", "IF(id % 3 = 0, array('hot', 'hot'), array(concat('t', id))) AS terms").repartition(40)
    got = {r.term: (r.occurrences, r.records) for r in T.count_terms(df, route_terms=100).collect()}
    assert got["hot"] == (6_000, 3_000) and len(got) == 6_001


def test_marks(spark):
    counts = spark.createDataFrame([("f", "rare", 9, 2), ("f", "mid", 9, 3), ("f", "common", 9, 15)], "field_name string, term string, occurrences bigint, records bigint")
    totals = spark.createDataFrame([("f", 100)], "field_name string, total bigint")
    assert {r.term: r.mark for r in T.marked(counts, totals).collect()} == {"rare": "rare", "mid": None, "common": "common"}


def test_edges(spark):
    assert T.count_terms(frame(spark, [])).count() == 0
    (row,) = T.count_terms(frame(spark, [("f", ["x" * 500_000] * 2)])).collect()
    assert (len(row.term), row.occurrences, row.records) == (500_000, 2, 1)
