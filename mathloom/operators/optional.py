"""Conversions by libraries that need not be there; without them they give NULL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mathloom.functions.latex import normalize
from mathloom.runtime import memoised


def _sympy(latex: str) -> str | None:
    try:
        from sympy import sympify
        from sympy.parsing.latex import parse_latex
    except ImportError:
        return None
    for read in (parse_latex, sympify):
        try:
            return str(read(latex))
        except Exception:  # either reader may reject a formula in any way
            continue
    return None


def _latex2mathml(latex: str) -> str | None:
    try:
        from latex2mathml.converter import convert
    except ImportError:
        return None
    try:
        return convert(latex)
    except Exception:  # the library may reject a formula in any way
        return None


def _function(one):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = memoised(one)
        for batch in batches:
            yield pa.array([None if x is None else known(x) for x in batch.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def sympy_expression(latex: Column) -> Column:
    """The expression of a formula in its aggressive normal form, as text, or NULL."""
    return _function(_sympy)(normalize(latex, aggressive=True))


def library_mathml(latex: Column) -> Column:
    """MathML by the conversion library, of a formula with its spacing kept, or NULL."""
    return _function(_latex2mathml)(normalize(latex, preserve_spacing=True))
