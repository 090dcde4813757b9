"""Detection of formulas in text: one row per formula, with place, type and confidence.

Two semantics.  ``reference``: each of nine patterns is looked for by itself, so the inside of
``$$x$$`` also gives an inline row and an escaped dollar opens a formula.  ``intended``: spans
already taken by an outer formula give no further row and ``\\$`` is a character.

Defined results: a NULL or empty text gives no row; a formula may span lines except between
single dollars; unclosed openers give nothing; repeated documents give their rows again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.functions.latex import confidence, position
from mathloom.runtime import spread

# Type and pattern of each kind of formula, tried in this order.
PATTERNS = (
    ("display", r"(?s)\$\$(.+?)\$\$"),
    ("display", r"(?s)\\\[(.+?)\\\]"),
    ("equation", r"(?s)\\begin\{equation\}(.+?)\\end\{equation\}"),
    ("equation", r"(?s)\\begin\{equation\*\}(.+?)\\end\{equation\*\}"),
    ("align", r"(?s)\\begin\{align\}(.+?)\\end\{align\}"),
    ("align", r"(?s)\\begin\{align\*\}(.+?)\\end\{align\*\}"),
    ("matrix", r"(?s)\\begin\{[pvbBV]?matrix\}(.+?)\\end\{[pvbBV]?matrix\}"),
    ("inline", r"\$([^\$\n]+)\$"),
    ("inline", r"(?s)\\\((.+?)\\\)"),
)
ENVIRONMENT = r"\\begin\{(\w+\*?)\}"
_FOUND = "ordinal int, start int, `end` int, math_type string, latex string, raw string"
#: Type, pattern and what ends a match; after its last occurrence in a text no opener need be tried.
_compiled = [(kind, re.compile(pattern), pattern.rsplit(")", 1)[1].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\")) for kind, pattern in PATTERNS]


def _last(text: str, closer: str) -> int:
    """Where the last possible end of a kind of formula begins, or -1."""
    return text.rfind("matrix}" if "matrix" in closer else closer)


#: The blocks, by opener: type and closer.  Nothing but another block holds them.
_BLOCKS = {"$$": ("display", "$$"), r"\[": ("display", r"\]")} | {
    rf"\begin{{{name}}}": (name.rstrip("*"), rf"\end{{{name}}}") for name in ("equation", "equation*", "align", "align*")
}
_OPENERS = re.compile(r"\$\$?|\\\[|\\\(|\\begin\{(?:equation\*?|align\*?|[pvbBV]?matrix)\}")
_MATRIX_END = re.compile(r"\\end\{[pvbBV]?matrix\}")
#: A row break with a space after it, as in a matrix, is no opener inside a formula.
_INNER = re.compile(r"(?<!\\)\\[\[(]|\$\$|\\begin\{(?:equation|align)\*?\}")


def _find_outermost(text: str) -> list[tuple[int, int, str, int, int]]:
    """Start, end, type, and start and end of the inside, of the outermost formulas, in one scan."""
    closers: dict[str, int] = {}  # where the next closer of each kind is; only looked for again once passed

    def closed(closer: str, at: int) -> tuple[int, int]:
        if closers.get(closer, -1) < at:
            if closer == "matrix":
                m = _MATRIX_END.search(text, at)
                closers[closer] = m.start() if m else len(text) + 1
            else:
                where = text.find(closer, at)
                closers[closer] = len(text) + 1 if where < 0 else where
        where = closers[closer]
        if where > len(text):
            return -1, -1
        return where, text.index("}", where) + 1 if closer == "matrix" else where + len(closer)

    inner: dict[str, list[int]] = {}
    last = {opener: text.rfind(closer) for opener, (_, closer) in _BLOCKS.items()}
    for m in _INNER.finditer(text):
        if last.get(m[0], len(text)) > m.end():
            inner.setdefault(m[0], []).append(m.start())

    def holds(openers: Iterable[str], a: int, b: int) -> bool:
        return any(at < len(inner[o]) and inner[o][at] < b for o in openers if o in inner for at in [bisect_left(inner[o], a)])

    strong = [o for o in _BLOCKS if o != "$$"]
    found, at = [], 0
    while m := _OPENERS.search(text, at):
        opener, a, inside = m[0], m.start(), m.end()
        at = inside
        if opener == "$$" and (end := closed("$$", inside + 1))[0] < 0:
            at = a + 1  # its second dollar may open an inline formula
            continue
        if opener == "$":
            b = text.find("$", inside)
            end = (b, b + 1)
            if b <= inside or text.find("\n", inside, b) >= 0 or holds(strong, inside, b):
                continue
            # On "$$": the end, unless those dollars open a display of their own.
            if text.startswith("$$", b) and (c := text.find("$", b + 2)) > b + 2 and text.startswith("$$", c):
                continue
            kind = "inline"
        elif opener in _BLOCKS:
            kind, closer = _BLOCKS[opener]
            end = closed(closer, inside + 1)
            if end[0] < 0 or opener != "$$" and holds([opener], inside, end[0]):
                continue
        else:
            kind, closer = ("inline", r"\)") if opener == r"\(" else ("matrix", "matrix")
            end = closed(closer, inside + 1)
            if end[0] < 0 or holds(_BLOCKS, inside, end[0]) or kind == "inline" and holds([opener], inside, end[0]):
                continue
        found.append((a, end[1], kind, inside, end[0]))
        at = end[1]
    return found


def find(text: str, semantics: str = "reference") -> list[tuple[int, int, int, str, str, str]]:
    """(ordinal, start, end, type, latex, raw) of the formulas in ``text``, by start."""
    if semantics == "intended":
        seen = re.sub(r"\\\$", "\\\\\0", text)
        return [(i, a, b, kind, text[c:d].strip(), text[c:d]) for i, (a, b, kind, c, d) in enumerate(_find_outermost(seen))]
    found = []
    for kind, pattern, closer in _compiled:
        # A lazy pattern tries every opener up to the end of the text; after the last closer none can match.
        end = _last(text, closer)
        if end >= 0:
            found += [(m.start(), m.end(), kind, m[1]) for m in pattern.finditer(text, 0, end + len(closer) + 16)]
    found.sort(key=lambda f: f[0])
    return [(i, a, b, kind, raw.strip(), raw) for i, (a, b, kind, raw) in enumerate(found)]


def detect(documents: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", semantics: str = "reference", page_number: int = 1, min_confidence: float | None = None) -> DataFrame:
    """The formulas of ``documents``: keys, ordinal, start, end, math_type, latex, raw, confidence, page_number, position.

    Only documents that hold a dollar or a backslash reach Python.
    """
    if semantics not in ("reference", "intended"):
        raise ValueError(f"unknown semantics: {semantics}")
    n = len(keys)
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["ordinal", "start", "end", "math_type", "latex", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, value in enumerate(batch.column(n).to_pylist()):
                here = find(value, semantics)
                index += [i] * len(here)
                rows += here
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            own = batch.take(pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(n)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*keys, *names])

    docs = documents.select(*keys, F.col(text).alias("__text")).where(F.col("__text").contains("$") | F.col("__text").contains("\\"))
    schema = ", ".join(f"`{k}` {t}" for k, t in documents.select(*keys).dtypes)
    found = spread(docs).mapInArrow(run, f"{schema}, {_FOUND}")
    found = found.withColumns({"confidence": confidence(F.col("raw")), "page_number": F.lit(page_number), "position": position(F.col("start"))})
    return found if min_confidence is None else found.where(F.col("confidence") >= min_confidence)


def environments(documents: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """How often each environment begins in each document: keys, environment, n."""
    names = F.explode(F.regexp_extract_all(F.col(text), F.lit(ENVIRONMENT), F.lit(1))).alias("environment")
    return documents.select(*keys, names).groupBy(*keys, "environment").agg(F.count("*").alias("n"))
