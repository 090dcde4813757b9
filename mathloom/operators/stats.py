"""Counts and reports over formulas and the other content of documents.

All of them are partial aggregates before one shuffle.  Defined results: a NULL type is counted
under the key NULL where types are rows and left out of maps; an empty input gives no row per
document and a row of zeros for a total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions.latex import confidence_band

_SYMBOLS = ("+", "-", "=", "\\", "^", "_")


def type_counts(formulas: DataFrame, keys: tuple[str, ...] = (), kind: str = "math_type") -> DataFrame:
    """Formulas by type, per document if ``keys`` are given."""
    return formulas.groupBy(*keys, kind).agg(F.count("*").alias("n"))


def type_map(rows: DataFrame, keys: tuple[str, ...], kind: str, name: str) -> DataFrame:
    """A map from type to count per document."""
    counted = rows.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count("*").alias("__n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), F.col("__n").alias("v"))))).alias(name))


def has_math_symbols(latex: Column) -> Column:
    test = F.lit(False)
    for s in _SYMBOLS:
        test = test | latex.contains(F.lit(s))
    return test


def _quality() -> list[Column]:
    band, latex = confidence_band(F.col("confidence")), F.col("latex")
    return [
        F.count("*").alias("total"),
        F.count_if(band == "high").alias("high"),
        F.count_if(band == "medium").alias("medium"),
        F.count_if(band == "low").alias("low"),
        F.count_if(has_math_symbols(latex)).alias("has_math_symbols"),
        F.count_if(F.length(latex).between(2, 1000)).alias("proper_length"),
        F.lit(0).cast("bigint").alias("balanced_delimiters"),
    ]


_COUNTERS = ("total", "high", "medium", "low", "has_math_symbols", "proper_length", "balanced_delimiters")


def quality(formulas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, confidence bands and quality counters; balanced_delimiters is always 0, as nothing fills it."""
    return formulas.groupBy(*keys).agg(*_quality())


def extraction_validation(formulas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``quality`` with the counts by type as a map and the empty list of potential errors, in one pass."""
    kinds = formulas.groupBy(*keys, "math_type").agg(*_quality())
    pairs = F.collect_list(F.when(F.col("math_type").isNotNull(), F.struct(F.col("math_type").alias("k"), F.col("total").alias("v"))))
    found = kinds.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _COUNTERS), F.map_from_entries(F.array_sort(pairs)).alias("by_type"))
    return found.withColumn("potential_errors", F.array().cast("array<string>"))


def stats_report(formulas: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "start") -> DataFrame:
    """The text report of each document, in one pass; types come in order of first occurrence."""
    kinds = formulas.groupBy(*keys, "math_type").agg(*_quality(), F.min(order).alias("first"))
    types = F.array_sort(F.collect_list(F.struct("first", "math_type", "total")))
    both = kinds.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _COUNTERS), types.alias("types"))
    lines = F.transform("types", lambda t: F.concat(F.lit("  - "), t["math_type"], F.lit(": "), t["total"].cast("string")))
    report = F.concat(
        F.lit("Total formulas detected: "), F.col("total").cast("string"), F.lit("\n\nBy type:\n"), F.concat_ws("\n", lines),
        F.lit("\n\nConfidence levels:\n  - High (≥0.8): "), F.col("high").cast("string"),
        F.lit("\n  - Medium (0.5-0.8): "), F.col("medium").cast("string"),
        F.lit("\n  - Low (<0.5): "), F.col("low").cast("string"),
    )
    return both.select(*keys, report.alias("report"))


def content_statistics(formulas: DataFrame, chemicals: DataFrame, code_blocks: DataFrame, diagrams: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: totals of the four kinds of content, types of formulas and diagrams, code languages.

    The four tables meet as rows of document and type; these are counted before they are shuffled.
    """
    parts = []
    for name, table, kind in (("formulas", formulas, "math_type"), ("chemical_formulas", chemicals, None), ("code_blocks", code_blocks, "language"), ("diagrams", diagrams, "diagram_type")):
        rows = table.select(key, F.col(kind).alias("kind") if kind else F.lit(None).cast("string").alias("kind"))
        parts.append(rows.where(F.col(key).isNotNull()).withColumn("part", F.lit(name)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy(key, "part", "kind").agg(F.count("*").alias("n"))

    def total(part: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0)).alias(f"total_{part}")

    def kinds(part: str) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("part") == part) & F.col("kind").isNotNull(), F.struct(F.col("kind").alias("k"), F.col("n").alias("v")))))

    languages = F.sort_array(F.collect_set(F.when((F.col("part") == "code_blocks") & (F.col("kind") != ""), F.col("kind"))))
    return rows.groupBy(key).agg(
        total("formulas"), total("chemical_formulas"), total("code_blocks"), total("diagrams"),
        F.map_from_entries(kinds("formulas")).alias("formula_types"), F.map_from_entries(kinds("diagrams")).alias("diagram_types"), languages.alias("languages"),
    )


def ocr_confidence(words: DataFrame, keys: tuple[str, ...], confidence: str = "conf") -> DataFrame:
    """Mean of the word confidences above 0 as a share of 1, 0 where there is none."""
    above = F.avg(F.when(F.col(confidence) > 0, F.col(confidence)))
    return words.groupBy(*keys).agg((F.coalesce(above, F.lit(0.0)) / 100.0).alias("confidence"))


def duplicate_groups(formulas: DataFrame, hashed: Column, identity: str) -> DataFrame:
    """Formulas by hash: first id, copies and spellings; one row each."""
    return formulas.where("latex IS NOT NULL").select(hashed.alias("hash"), F.col(identity).alias("id"), "latex").groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.approx_count_distinct("latex").alias("spellings"))
