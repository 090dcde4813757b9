import pytest
from pyspark.sql import functions as F

from mathloom.llm import mixture as X


@pytest.fixture(scope="module")
def sizes(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 < 6, "b").otherwise("c").alias("source"), (F.col("id") % 17 + 1).alias("tokens"))
    return rows.withColumn("place", X._place()).persist()


def total(sizes, source, threshold):
    return sizes.where((F.col("source") == source) & (F.col("place") < threshold)).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


@pytest.mark.parametrize("share", [0.0, 0.013, 0.5, 0.999, 1.0, 2.0])
def test_thresholds(sizes, share):
    held = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    found = X.thresholds(sizes, {s: n * share for s, n in held.items()}, tolerance=0.0)
    for source, n in held.items():
        # One document, of 17 tokens at most, decides the rest.
        assert abs(total(sizes, source, found[source]) - min(1.0, share) * n) <= 17


def test_thresholds_are_nested(sizes):
    low, high = (X.thresholds(sizes, {"b": n}) for n in (1000, 5000))
    assert 0 < low["b"] < high["b"]


def test_plan(sizes):
    by = X.plan(sizes, [("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.1, 1), ("none", 0.1, 2), (None, 0.2, 1), ("b", None, 1)])
    held = by["a"]["available_tokens"]
    assert by["a"]["budget"] == pytest.approx(3 * held) and by["none"]["budget"] == 0
    assert by["b"]["budget"] == pytest.approx(3 * held / 0.5 * 0.3)
    assert X.plan(sizes, []) == {} and X.plan(sizes, [("a", 0.5, 0)])["a"]["budget"] == 0
    capped = X.plan(sizes, [("a", 1.0, 5)], total=held * 2.5)["a"]
    assert capped["copies"] == 2 and 0 < capped["threshold"] < 2**60


def test_frames(spark):
    docs = [(i, f"word number {i} of text " * (i % 5 + 1), "big" if i % 3 else "small", "x") for i in range(900)]
    docs += [(1000, None, "big", "x"), (1001, "", "small", "x"), (1002, "text", None, "x"), (1003, "text", "other", "x")]
    d = spark.createDataFrame(docs, "doc_id int, text string, source string, repeats string")
    t = spark.createDataFrame([("small", 0.6, 2), ("big", 0.4, 1), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, by = X.mixture(d, t)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"small", "big"} and not {r.doc_id for r in rows} & {1000, 1001, 1002, 1003}
    assert max(r.repeats for r in rows if r.source == "small") == 2 and max(r.repeats for r in rows if r.source == "big") == 1
    shares = {r.source: r for r in X.shares(mixed, by).collect()}
    assert shares["small"].share == pytest.approx(0.6, abs=0.005) and shares["big"].share == pytest.approx(0.4, abs=0.005)
    assert {(r.doc_id, r.repeats) for r in rows} == {(r.doc_id, r.repeats) for r in X.mixture(d.repartition(7), t)[0].collect()}
    assert X.mixture(d.limit(0), t)[0].count() == 0 and X.mixture(d, t.limit(0))[0].count() == 0
    empty, plan = X.mixture(d.limit(0), t)
    assert [r.share for r in X.shares(empty, plan).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        X.mixture(d, t, most_sources=1)


def test_tokens(spark):
    d = spark.createDataFrame([(1, "s", "hello world"), (2, "s", "<|endoftext|>"), (3, "s", "x" * 200_000)], "doc_id int, source string, text string")
    got = {r.doc_id: r.tokens for r in X.sized(d).collect()}
    assert got[1] == 2 and got[2] > 1 and got[3] > 1000


def test_many_sources(spark):
    """Ten thousand sources, one of which holds a third of all documents."""
    rows = spark.range(60_000).selectExpr("id AS doc_id", "concat('s', IF(id % 3 = 0, 0, id % 10000)) AS source", "id % 17 + 1 AS tokens")
    sizes = rows.withColumn("place", X._place()).persist()
    held = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    found = X.thresholds(sizes, {s: n / 2 for s, n in held.items()})
    limits = spark.createDataFrame([*found.items()], "source string, threshold bigint")
    got = {r.source: r.n for r in sizes.join(limits, "source").groupBy("source").agg(F.sum(F.when(F.col("place") < F.col("threshold"), F.col("tokens")).otherwise(0)).alias("n")).collect()}
    assert len(got) > 6_000 and all(abs(got[s] - n / 2) <= max(17, n * 1e-4) for s, n in held.items())
    sizes.unpersist()
