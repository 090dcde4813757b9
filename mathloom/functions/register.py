"""The operators as SQL functions: scalar ones in Arrow batches, detection as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from mathloom.operators import grammar, mathml
from mathloom.operators.detect import find
from mathloom.runtime import memoised, ship


def _remembering(function: Callable) -> Callable:
    """A function of iterators of batches; one task has one bounded memory of the values it met."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = memoised(function)
        for values in batches:
            yield pd.Series([None if x is None else known(x) for x in values], dtype="object")

    return run


latex_complexity = pandas_udf(_remembering(lambda x: grammar.parse(x).complexity), T.DoubleType())
latex_is_valid = pandas_udf(_remembering(lambda x: not grammar.parse(x).errors), T.BooleanType())
mathml_is_valid = pandas_udf(_remembering(lambda x: not mathml.validate_mathml(x)), T.BooleanType())


@pandas_udf(T.StringType())
def latex_to_mathml(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = memoised(lambda x, display: mathml.convert(x, display))
    for latex, display in batches:
        yield pd.Series([None if x is None else known(x, bool(b)) for x, b in zip(latex, display, strict=True)], dtype="object")


@udtf(returnType=T.StructType([T.StructField(n, k) for n, k in (("ordinal", T.IntegerType()), ("start", T.IntegerType()), ("end_", T.IntegerType()), ("math_type", T.StringType()), ("latex", T.StringType()))]))
class DetectFormulas:
    """Formulas of a text, for LATERAL detect_formulas(text)."""

    def eval(self, text: str):
        for ordinal, start, end, kind, latex, _ in find(text or ""):
            yield ordinal, start, end, kind, latex


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    ship(spark)
    functions = {"latex_complexity": latex_complexity, "latex_is_valid": latex_is_valid, "latex_to_mathml": latex_to_mathml, "mathml_is_valid": mathml_is_valid}
    for name, function in functions.items():
        spark.udf.register(name, function)
    spark.udtf.register("detect_formulas", DetectFormulas)
