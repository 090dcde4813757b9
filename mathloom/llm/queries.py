"""The queries of the training-data operators, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathloom.llm import abuse, formatting, heavy, leaks, mixture, terms, visual
from mathloom.llm.oracle import SQL  # noqa: F401
from mathloom.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stored values whose characters differ from their canonical form."""
    forms = visual.canonical_forms(visual.melt(table(spark, sf, "formulas")))
    return forms.where("decoded <> canonical").select(F.col("row_id").alias("formula_id"), "field_name")


def p1_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of both fields in its one form."""
    return visual.all_forms(visual.melt(table(spark, sf, "formulas"))).withColumnRenamed("row_id", "formula_id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    latex = table(spark, sf, "formulas").select(F.lit("latex").alias("field_name"), F.col("latex").alias("item"))
    return latex.unionByName(table(spark, sf, "chemicals").select(F.lit("chem_text").alias("field_name"), F.col("text").alias("item")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values held by at least 1 % of the non-NULL rows: Misra-Gries candidates, counted exactly."""
    return heavy.exact_frequent(_items(spark, sf)).select("field_name", "item")


def p2_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates with approximate counts and the bound of their error."""
    return heavy.frequent_items(_items(spark, sf))


def p2_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent values with their exact counts, and whether these lie within the bounds of the approximate ones."""
    items = _items(spark, sf)
    exact, rough = heavy.exact_frequent(items), heavy.frequent_items(items)
    within = (F.col("n") >= F.col("approx_count")) & (F.col("n") <= F.col("approx_count") + F.col("max_error"))
    # Two tables of at most some 100 rows a field.
    both = exact.drop("seen_rows").join(rough, ["field_name", "item"], "left")
    return both.select("field_name", "item", "n", F.coalesce(within, F.lit(False)).alias("within_bounds"))


def p2_exact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent values with their exact counts."""
    return heavy.exact_frequent(_items(spark, sf)).select("field_name", "item", "n", "seen_rows")


def _hashed(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    formulas = table(spark, sf, "formulas").select(F.col("formula_id").alias("id"), F.col("latex").alias("value"))
    code = table(spark, sf, "code_blocks").select(F.col("code_id").alias("id"), F.col("code").alias("value"))
    return [("formulas", formatting.hashed(formulas, "latex")), ("code_blocks", formatting.hashed(code, "code"))]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Members of groups of copies that are stored differently."""
    one, two = (formatting.copy_members(rows).select(F.lit(name).alias("table_name"), "first_id", "copy_id") for name, rows in _hashed(spark, sf))
    return one.unionByName(two)


def p4_copies(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each group of copies, with their number."""
    one, two = (formatting.copy_groups(rows).select(F.lit(name).alias("table_name"), "first_id", "copies", "differ") for name, rows in _hashed(spark, sf))
    return one.unionByName(two)


def p4_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """128-bit digests that different canonical texts share; normally none."""
    one, two = (formatting.collisions(formatting.copy_groups(rows)).select(F.lit(name).alias("table_name"), F.hex("digest").alias("digest"), "texts") for name, rows in _hashed(spark, sf))
    return one.unionByName(two)


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    formulas, code = table(spark, sf, "formulas"), table(spark, sf, "code_blocks")
    # Both fields of formulas come from one scan.
    fields = F.inline(F.array(F.struct(F.lit("latex").alias("field_name"), F.regexp_extract_all("latex", F.lit(terms.COMMAND), F.lit(0)).alias("terms")), F.struct(F.lit("math_type").alias("field_name"), F.array("math_type").alias("terms"))))
    rows = formulas.select(fields).unionByName(code.select(F.lit("language").alias("field_name"), F.array("language").alias("terms")))
    n, m = formulas.count(), code.count()
    totals = spark.createDataFrame([("latex", n), ("math_type", n), ("language", m)], "field_name string, total bigint")
    return terms.marked(terms.count_terms(rows), totals)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return _marked(spark, sf).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    """All terms with their occurrences, records and mark."""
    return _marked(spark, sf).select("field_name", "term", "occurrences", "records", "mark")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the test items of which they hold at least twelve words in a row."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p6_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The passages themselves, with their offsets in the documents."""
    return leaks.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture with their sizes and numbers of copies."""
    return mixture.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixture.shares(*mixture.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per source with a target: its documents, and whether the mixture keeps to ``max_repeats`` and, but for one document or one in ten thousand, to the share.

    The target of a source without documents falls to the others in proportion.
    """
    documents = table(spark, sf, "documents")
    mixed, by = mixture.mixture(documents, table(spark, sf, "mix_targets"))
    held = documents.where("source IS NOT NULL AND text <> ''").groupBy("source").agg(F.count("*").alias("available"))
    largest = mixed.groupBy("source").agg(F.max("tokens").alias("largest"))
    # One row a source, at most as many as there are targets.
    rows = mixture.shares(mixed, by).join(held, "source", "left").join(largest, "source", "left").fillna(0, ["available", "largest"])
    everything = Window.partitionBy(F.lit(1))
    wanted = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0) / F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(everything)
    total = F.sum("tokens").over(everything)
    on_target = F.abs(F.col("tokens") - wanted * total) <= F.greatest(F.max("largest").over(everything), total * 1e-4)
    return rows.select("source", "target_share", "max_repeats", "available", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), on_target.alias("on_target"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, sf).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf)


def p8_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of flagged documents per source."""
    return abuse.source_rates(_scored(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_frequent, p2_bounds, p2_exact_counts, p4_found, p4_copies, p4_collisions, p5_found, p5_terms, p6_found, p6_passages, p7_mixture, p7_shares, p7_checked, p8_found, p8_scores, p8_source_rates)}
