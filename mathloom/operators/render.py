"""The rendering branch: keys, dispatch and data of plots as expressions, drawing by backends.

A renderer is any object with ``name``, ``is_available`` and ``render(latex, config) -> dict``
giving image, svg or pdf bytes, or an error.  Results stay beside their formulas, nothing is
shuffled; a task renders equal formulas once, as far as its memory of results goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.runtime import memoised, spread

#: Renderings that a task remembers.
MOST_REMEMBERED = 1000
PLOTS = ("function", "scatter", "vector_field")


@dataclass(frozen=True)
class RenderConfig:
    dpi: int = 300
    font_size: int = 12
    output_format: str = "png"
    background_color: str = "white"
    text_color: str = "black"
    font_family: str = "Computer Modern"
    timeout: int = 30
    padding: int = 10
    transparent_background: bool = False
    max_width: int | None = None
    max_height: int | None = None


class Renderer(Protocol):
    name: str

    def is_available(self) -> bool: ...

    def render(self, latex: str, config: RenderConfig) -> dict: ...


_FIELDS = ("image", "svg", "pdf", "error", "renderer")
_TYPES = (pa.binary(), pa.string(), pa.binary(), pa.string(), pa.string())
RESULT = "image binary, svg string, pdf binary, error string, renderer string"


def available(renderers: list[Renderer]) -> dict[str, bool]:
    return {r.name: r.is_available() for r in renderers}


def render(formulas: DataFrame, renderers: list[Renderer], config: RenderConfig = RenderConfig(), only: str | None = None, latex: str = "latex") -> DataFrame:
    """``formulas`` with image, svg, pdf, error and renderer; the first renderer that succeeds counts, or ``only`` that one."""
    chosen = [r for r in renderers if only is None or r.name.lower() == only.lower()]

    def one(text: str) -> dict:
        if only is not None and not chosen:
            return {"error": f"Unknown renderer: {only}"}
        result: dict = {"error": f"{only} not available" if only else "No LaTeX renderer available"}
        for r in chosen:
            if not r.is_available():
                continue
            try:
                attempt = r.render(text, config) | {"renderer": r.name}
            except Exception as e:  # a renderer may fail in any way; that is a row, not the end of the job
                attempt = {"error": str(e), "renderer": r.name}
            if valid(attempt):
                return attempt
            result = result if result.get("renderer") else attempt
        return result

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = memoised(one, MOST_REMEMBERED)
        for batch in batches:
            rows = [None if x is None else known(x) for x in batch.to_pylist()]
            yield pa.array([r and {f: r.get(f) for f in _FIELDS} for r in rows], pa.struct([*zip(_FIELDS, _TYPES, strict=True)]))

    done = F.arrow_udf(run, f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")(F.col(latex))
    rows = spread(formulas.drop(*_FIELDS)).withColumn("__done", done)
    return rows.select(*(c for c in rows.columns if c != "__done"), *(F.col("__done")[f].alias(f) for f in _FIELDS))


def valid(result: dict) -> bool:
    return bool(result.get("image") or result.get("svg") or result.get("pdf")) and not result.get("error")


def save(result: dict, path: str) -> None:
    """Write one result: its image, else its SVG, else its PDF."""
    if result.get("image"):
        Path(path).write_bytes(result["image"])
    elif result.get("svg"):
        Path(path).write_text(result["svg"], encoding="utf-8")
    elif result.get("pdf"):
        Path(path).write_bytes(result["pdf"])
    else:
        raise ValueError("No render result to save")


def diagram_route(kind: Column, smiles: Column | None = None) -> Column:
    """Which branch draws a diagram, and the error where none does."""
    has_smiles = F.lit(False) if smiles is None else smiles.isNotNull()
    route = F.when((kind == "chemical") & has_smiles, "chemical").when(kind.isin(*PLOTS), "plot")
    return F.struct(route.alias("route"), F.when(route.isNull(), F.concat(F.lit("Unknown diagram type: "), F.coalesce(kind, F.lit("None")))).alias("error"))


def linspace(low: Column, high: Column, n: int = 1000) -> Column:
    """``n`` evenly spaced values from ``low`` to ``high``."""
    step = (high - low) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, high).otherwise(low + i * step))


def polynomial_points(coefficient: Column, power: Column, constant: Column, low: Column, high: Column, n: int = 1000) -> Column:
    """Points of ``coefficient * x^power + constant``, the form of stored function plots."""
    return F.transform(linspace(low, high, n), lambda x: F.struct(x.alias("x"), (coefficient * F.pow(x, power) + constant).alias("y")))


def vector_grid(low: Column, high: Column, n: int = 20) -> Column:
    """The points of an ``n`` by ``n`` grid, row by row."""
    axis = linspace(low, high, n)
    return F.flatten(F.transform(axis, lambda y: F.transform(axis, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def _scaled(points: Column, width: int, height: int) -> Column:
    """Points inside the picture, y upwards; a single value lies in the middle."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])

    def along(v: Column, values: Column, size: int) -> Column:
        low, high = F.array_min(values), F.array_max(values)
        return F.when(high > low, (v - low) / (high - low) * size).otherwise(F.lit(size / 2))

    return F.transform(points, lambda p: F.struct(along(p["x"], xs, width).alias("x"), (F.lit(height) - along(p["y"], ys, height)).alias("y")))


def svg_plot(kind: Column, points: Column, title: Column, width: int = 800, height: int = 600) -> Column:
    """A function's curve or a scatter of points (x, y) as SVG, a JVM expression; NULL for another kind or no points."""
    at = _scaled(points, width, height)
    text = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "&", "&amp;"), "<", "&lt;")
    pair = F.array_join(F.transform(at, lambda p: F.concat(F.format_string("%.2f", p["x"]), F.lit(","), F.format_string("%.2f", p["y"]))), " ")
    dots = F.array_join(F.transform(at, lambda p: F.concat(F.lit('<circle r="3" cx="'), F.format_string("%.2f", p["x"]), F.lit('" cy="'), F.format_string("%.2f", p["y"]), F.lit('"/>'))), "")
    body = F.when(kind == "function", F.concat(F.lit('<polyline fill="none" stroke="black" points="'), pair, F.lit('"/>'))).when(kind == "scatter", dots)
    svg = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>'), text, F.lit("</title>"), body, F.lit("</svg>"))
    return F.when(F.size(points) > 0, svg)


def svg_vectors(arrows: Column, title: Column, width: int = 800, height: int = 600, density: int = 20) -> Column:
    """A vector field of arrows (x, y, u, v) as SVG, a JVM expression; NULL without arrows.

    Both axes have one scale, y goes upwards; the longest arrow is as long as a cell of a grid of ``density``.
    """

    def of(name: str) -> Column:
        return F.transform(arrows, lambda a: a[name])

    x, y = of("x"), of("y")
    longest = F.array_max(F.transform(arrows, lambda a: F.sqrt(a["u"] * a["u"] + a["v"] * a["v"])))
    across, along = F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y)
    span = F.greatest(across / width, along / height)
    scale = F.when(span > 0, F.lit(1.0) / span).otherwise(1.0)
    length = F.when(longest > 0, F.lit(min(width, height) / density) / longest).otherwise(0.0)

    def number(value: Column) -> Column:
        return F.format_string("%.2f", value)

    def line(a: Column) -> Column:
        left, top = (a["x"] - F.array_min(x)) * scale, F.lit(float(height)) - (a["y"] - F.array_min(y)) * scale
        ends = (("x1", left), ("y1", top), ("x2", left + a["u"] * length), ("y2", top - a["v"] * length))
        return F.concat(F.lit("<line"), *(F.concat(F.lit(f' {n}="'), number(v), F.lit('"')) for n, v in ends), F.lit(' marker-end="url(#a)"/>'))

    text = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "&", "&amp;"), "<", "&lt;")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" stroke="blue"><title>'
    tip = '</title><defs><marker id="a" orient="auto" markerWidth="6" markerHeight="6" refX="5" refY="3"><path d="M0,0L6,3L0,6z"/></marker></defs>'
    return F.when(F.size(arrows) > 0, F.concat(F.lit(head), text, F.lit(tip), F.array_join(F.transform(arrows, line), ""), F.lit("</svg>")))
