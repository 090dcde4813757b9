"""From a few documents to formulas, parses, MathML and reports.  Run: python examples/quickstart.py"""

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))

from mathloom.operators import detect, mathml, parse, stats  # noqa: E402
from mathloom.plans import pipeline  # noqa: E402
from mathloom.runtime import ship  # noqa: E402
from mathloom.sources import export  # noqa: E402

spark = SparkSession.builder.master("local[2]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
ship(spark)
docs = spark.createDataFrame(
    [
        (1, r"Energy is $E = mc^2$, and \[ \int_0^1 x \, dx = \frac{1}{2} \] holds.", "notes.txt"),
        (2, r"\begin{align} a &= b \\ c &= d \end{align} and $\frac{a}{b$ is broken.", "draft.tex"),
    ],
    "doc_id int, text string, source string",
)

formulas = detect.detect(docs, semantics="intended")
formulas.select("doc_id", "start", "math_type", "latex", "confidence").show(truncate=False)
parse.parse(formulas.select("doc_id", "latex"), ("is_valid", "complexity_score", "tree_depth")).show(truncate=False)
mathml.to_mathml(formulas.select("latex"), "intended").where("latex LIKE 'E%'").show(truncate=False)
stats.stats_report(formulas).show(truncate=False)
results = pipeline.process(docs, pipeline.build_pipeline(semantics="intended"), source_file="source")
print(export.exported(results, "markdown").first().document)
spark.stop()
