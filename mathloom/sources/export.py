"""Results as JSON, LaTeX and Markdown; every document is formed from its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "latex", "markdown")


def _shown(f: Column) -> Column:
    mark = F.when(f["math_type"] == "inline", "$").otherwise("$$")
    return F.concat(mark, f["latex"], mark)


def as_json() -> Column:
    """A result with the names of the exchange format: ``type`` for math_type, ``success``."""

    def one(f: Column) -> Column:
        p = f["position"]
        return F.struct(
            f["latex"].alias("latex"), f["math_type"].alias("type"), F.array(p["x"], p["y"], p["width"], p["height"]).alias("position"), f["page_number"].alias("page_number"),
            f["confidence"].alias("confidence"), f["mathml"].alias("mathml"), F.lit(None).cast("string").alias("rendered_image"), F.create_map().cast("map<string,string>").alias("metadata"),
        )

    nothing = F.array().cast("array<string>")
    content = F.struct(
        F.transform("formulas", one).alias("formulas"), nothing.alias("chemical_formulas"), nothing.alias("code_blocks"), nothing.alias("diagrams"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("statistics").alias("statistics"),
    )
    return F.to_json(F.struct(content.alias("content"), "source_file", "processing_time", "errors", "warnings", "success"), {"ignoreNullFields": "false"})


def as_latex() -> Column:
    """An article with a subsection per formula."""
    head = "\\documentclass{article}\n\\usepackage{amsmath}\n\\usepackage{amssymb}\n\\begin{document}\n\n\\section{Extracted Mathematical Content}\n"
    body = F.transform("formulas", lambda f, i: F.concat(F.lit("\\subsection{Formula "), (i + 1).cast("string"), F.lit("}\nType: "), f["math_type"], F.lit("\n\n"), _shown(f), F.lit("\n")))
    return F.concat_ws("\n", F.lit(head), body, F.lit("\\end{document}"))


def as_markdown() -> Column:
    """A document with a section per formula and the statistics; an unknown time is n/a."""
    time = F.when(F.col("processing_time").isNull(), "n/a").otherwise(F.format_string("%.2fs", F.col("processing_time")))
    head = F.concat(F.lit("# Extracted STEM Content\n\nSource: "), F.coalesce("source_file", F.lit("Unknown")), F.lit("\nProcessing time: "), time, F.lit("\n\n## Mathematical Formulas\n"))
    body = F.transform("formulas", lambda f, i: F.concat(F.lit("### Formula "), (i + 1).cast("string"), F.lit("\n- Type: "), f["math_type"], F.lit("\n- Confidence: "), F.format_string("%.2f", f["confidence"]), F.lit("\n\n"), _shown(f), F.lit("\n")))
    types = F.concat(F.lit("{"), F.concat_ws(", ", F.transform(F.map_entries("statistics.formula_types"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string")))), F.lit("}"))
    tail = F.concat(F.lit("## Statistics\n\n- Total formulas: "), F.col("statistics.total_formulas").cast("string"), F.lit("\n- Formula types: "), types, F.lit("\n"))
    return F.concat_ws("\n", head, body, tail)


def exported(results: DataFrame, format: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and ``document``, the text of each result."""
    if format not in FORMATS:
        raise ValueError(f"Unsupported export format: {format}")
    column = {"json": as_json, "latex": as_latex, "markdown": as_markdown}[format]()
    return results.select(*keys, column.alias("document"))


def export(results: DataFrame, path: str, format: str = "json", keys: tuple[str, ...] = ("doc_id",)) -> bool:
    """Write each result's document to a folder of text; False for an unknown format."""
    if format not in FORMATS:
        return False
    exported(results, format, keys).select(F.col("document").alias("value")).write.mode("overwrite").text(path)
    return True
