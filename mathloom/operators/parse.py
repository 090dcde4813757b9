"""Parsing of formulas as a DataFrame operator, and what follows from a parse.

``parse`` runs the grammar in Arrow batches where the rows are: nothing is shuffled or joined.
Each task remembers the formulas it met, so one that a third of all rows hold is parsed once a
task.  Only the formulas go to Python and only the parts that are asked for come back.

Defined results: NULL parses to NULLs; an empty formula is valid, of no tokens and depth 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathloom.functions import vocab
from mathloom.operators import grammar
from mathloom.runtime import memoised, spread

_FINDING = pa.struct([("type", pa.string()), ("message", pa.string()), ("position", pa.int32()), ("token_index", pa.int32())])
_TOKEN = pa.struct([("type", pa.string()), ("value", pa.string()), ("position", pa.int32()), ("length", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string()))])
_NODE = pa.struct(
    [("id", pa.int32()), ("parent", pa.int32()), ("role", pa.string()), ("ord", pa.int32()), ("depth", pa.int32())]
    + [("type", pa.string()), ("value", pa.string()), ("name", pa.string()), ("position", pa.int32()), ("nested", pa.bool_())]
)
#: The kinds of parts of a formula.
COMPONENTS = (
    "commands", "greek_letters", "operators", "variables", "numbers", "environments", "fractions", "matrices", "integrals",
    "sums_products", "delimiters", "accents", "macros", "optional_args",
)


def _components(p: grammar.Parsed) -> dict[str, list[str]]:
    """The distinct parts of a formula, taken in the parser, so that no token leaves it."""
    parts: dict[str, dict[str, None]] = {c: {} for c in COMPONENTS}
    kinds = {"symbol": "", "command": "commands", "operator": "operators", "variable": "variables", "number": "numbers", "delimiter": "delimiters", "macro": "macros", "optional": "optional_args"}
    special = {"\\frac": "fractions"} | dict.fromkeys(vocab.INTEGRALS, "integrals") | dict.fromkeys(vocab.SUMS_PRODUCTS, "sums_products")
    for t in p.tokens:
        subtype = t.metadata.get("subtype")
        if subtype == "greek":
            parts["greek_letters"][t.value] = None
        elif kind := kinds.get(t.type):
            parts[kind][t.value] = None
        if t.type == "command" and (kind := "accents" if subtype == "accent" else special.get(t.value)):
            parts[kind][t.value] = None
        if t.metadata.get("env_type") == "begin":
            name = t.metadata["env_name"]
            parts["environments"][name] = None
            if "matrix" in name:
                parts["matrices"][name] = None
    return {c: [*x] for c, x in parts.items()}


_COUNTS = [name for name, _ in vocab.COMPLEXITY]
_F = "ARRAY<STRUCT<type:STRING,message:STRING,position:INT,token_index:INT>>"
#: Parts of a parse: Arrow type, SQL type, value.
PARTS = {
    "is_valid": (pa.bool_(), "BOOLEAN", lambda p: not p.errors),
    "complexity_score": (pa.float64(), "DOUBLE", lambda p: p.complexity),
    "token_count": (pa.int32(), "INT", lambda p: len(p.tokens)),
    "tree_depth": (pa.int32(), "INT", lambda p: p.counts["depth"]),
    "original_length": (pa.int32(), "INT", lambda p: p.original_length),
    "comment_count": (pa.int32(), "INT", lambda p: p.comment_count),
    "has_macros": (pa.bool_(), "BOOLEAN", lambda p: bool(p.macros)),
    "counts": (pa.struct([(c, pa.int32()) for c in _COUNTS]), "STRUCT<" + ",".join(f"{c}:INT" for c in _COUNTS) + ">", lambda p: p.counts),
    "errors": (pa.list_(_FINDING), _F, lambda p: [f._asdict() for f in p.errors]),
    "warnings": (pa.list_(_FINDING), _F, lambda p: [f._asdict() for f in p.warnings]),
    "components": (
        pa.struct([(c, pa.list_(pa.string())) for c in COMPONENTS]),
        "STRUCT<" + ",".join(f"{c}:ARRAY<STRING>" for c in COMPONENTS) + ">",
        _components,
    ),
    "tokens": (
        pa.list_(_TOKEN),
        "ARRAY<STRUCT<type:STRING,value:STRING,position:INT,length:INT,metadata:MAP<STRING,STRING>>>",
        lambda p: [t._asdict() | {"metadata": list(t.metadata.items())} for t in p.tokens],
    ),
    "nodes": (
        pa.list_(_NODE),
        "ARRAY<STRUCT<id:INT,parent:INT,role:STRING,ord:INT,depth:INT,type:STRING,value:STRING,name:STRING,position:INT,nested:BOOLEAN>>",
        lambda p: [dict(zip(_NODE.names, r, strict=True)) for r in grammar.node_rows(p.tree)],
    ),
}
SUMMARY = ("is_valid", "complexity_score", "token_count", "tree_depth", "original_length", "comment_count", "has_macros")


def _parser(parts: tuple[str, ...], remove_comments: bool):
    """An Arrow function from formulas to structs of the asked parts."""
    kind = pa.struct([(p, PARTS[p][0]) for p in parts])
    sql = "STRUCT<" + ",".join(f"{p}:{PARTS[p][1]}" for p in parts) + ">"

    # By its hints it takes and gives an iterator of batches, so a task has one memory.
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(latex: str) -> dict:
            parsed = grammar.parse(latex, remove_comments)
            return {p: PARTS[p][2](parsed) for p in parts}

        known = memoised(one)
        for batch in batches:
            yield pa.array([None if x is None else known(x) for x in batch.to_pylist()], kind)

    return F.arrow_udf(run, sql)


def parse(formulas: DataFrame, parts: tuple[str, ...] = SUMMARY, latex: str = "latex", remove_comments: bool = True) -> DataFrame:
    """``formulas`` with the asked parts of their parse; columns of these names are replaced."""
    rows = spread(formulas.drop(*parts)).withColumn("__parsed", _parser(tuple(parts), remove_comments)(F.col(latex)))
    return rows.select(*(c for c in rows.columns if c != "__parsed"), *(F.col("__parsed")[p].alias(p) for p in parts))


def parse_distinct(formulas: DataFrame, parts: tuple[str, ...] = SUMMARY, latex: str = "latex", remove_comments: bool = True) -> DataFrame:
    """latex and the asked parts of its parse, for each distinct formula."""
    return parse(formulas.select(F.col(latex).alias("latex")).where("latex IS NOT NULL").distinct(), parts, "latex", remove_comments)


def is_simple(tokens: Column, depth: Column, complexity: Column) -> Column:
    """No environment, fraction or root, depth of 3 and complexity of 2 at most."""
    hard = F.exists(tokens, lambda t: (t["type"] == "environment") | t["value"].isin("\\frac", "\\sqrt"))
    return ~((depth > 3) | hard | (complexity > 2.0))


def _values(tokens: Column, wanted) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens, wanted), lambda t: t["value"]))


def components(tokens: Column) -> Column:
    """Fourteen lists of the distinct parts of a formula, each in order of first occurrence."""

    def of(kind: str, values=None, subtype: str | None = None) -> Column:
        def wanted(t: Column) -> Column:
            test = t["type"] == kind
            if values is not None:
                test &= t["value"].isin(*values)
            return test if subtype is None else test & (t["metadata"]["subtype"] == subtype)

        return _values(tokens, wanted)

    begun = F.filter(tokens, lambda t: (t["type"] == "environment") & (t["metadata"]["env_type"] == "begin"))
    names = F.array_distinct(F.transform(begun, lambda t: t["metadata"]["env_name"]))
    fractions_, integrals, sums = ("\\frac",), vocab.INTEGRALS, vocab.SUMS_PRODUCTS
    lists = {
        "commands": of("command"),
        "greek_letters": of("symbol", subtype="greek"),
        "operators": of("operator"),
        "variables": of("variable"),
        "numbers": of("number"),
        "environments": names,
        "fractions": of("command", fractions_),
        "matrices": F.filter(names, lambda n: n.contains("matrix")),
        "integrals": of("command", integrals),
        "sums_products": of("command", sums),
        "delimiters": of("delimiter"),
        "accents": of("command", subtype="accent"),
        "macros": of("macro"),
        "optional_args": of("optional"),
    }
    return F.struct(*(c.alias(name) for name, c in lists.items()))


def render_size(tokens: Column, depth: Column, font_size: float = 12.0, dpi: int = 96) -> Column:
    """Estimated width and height in pixels, rounded half to even.

    The factors are multiplied in one fixed order, so the doubles before rounding are equal to the bit.
    """
    parts = components(tokens)
    scale = dpi / 96
    shown = F.size(F.filter(tokens, lambda t: ~t["type"].isin("spacing", "comment")))
    width = shown * F.lit(font_size * 0.6 * scale) * F.lit(0.5)
    height = F.lit(font_size * 1.2 * scale)

    def times(base: Column, factor: float, n: Column) -> Column:
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), base, lambda acc, _: acc * F.lit(factor))).otherwise(base)

    n = F.size(parts["fractions"])
    height = F.when(n > 0, height * (F.lit(2.0) + n * F.lit(0.2))).otherwise(height)
    width = F.when(n > 0, width * F.lit(0.9)).otherwise(width)
    n = F.size(parts["matrices"])
    height = F.when(n > 0, height * (F.lit(2.5) + n * F.lit(0.5))).otherwise(height)
    width = F.when(n > 0, width * F.lit(1.5)).otherwise(width)
    big = (F.size(parts["integrals"]) > 0) | (F.size(parts["sums_products"]) > 0)
    height, width = F.when(big, height * F.lit(1.8)).otherwise(height), F.when(big, width * F.lit(1.2)).otherwise(width)
    height = times(height, 1.1, F.size(F.filter(tokens, lambda t: t["metadata"]["subtype"] == "delimiter_modifier")))
    scripts = F.size(F.filter(tokens, lambda t: t["type"].isin("subscript", "superscript")))
    height = F.when(scripts > 0, height * (F.lit(1) + F.least(scripts * F.lit(0.2), F.lit(0.6)))).otherwise(height)
    height = height * (F.lit(1) + depth * F.lit(0.1))
    height = times(height, 1.2, F.size(F.filter(parts["accents"], lambda a: a.isin(*vocab.WIDE_ACCENTS))))
    return F.struct(F.bround(width).cast("bigint").alias("width"), F.bround(height).cast("bigint").alias("height"))


def macro_definitions(formulas: DataFrame, keys: tuple[str, ...], latex: str = "latex") -> DataFrame:
    """Macros that formulas define: keys, macro, args, body; what stands in comments counts too."""
    new = F.transform(
        F.regexp_extract_all(F.col(latex), F.lit(r"\\newcommand\{\\[a-zA-Z]+\}(?:\[\d+\])?\{[^}]+\}"), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, r"\{\\([a-zA-Z]+)\}", 1).alias("macro"), F.coalesce(F.regexp_extract(m, r"\}\[(\d+)\]\{", 1).try_cast("int"), F.lit(0)).alias("args"), F.regexp_extract(m, r"(?s)\{([^}]+)\}$", 1).alias("body")),
    )
    old = F.transform(
        F.regexp_extract_all(F.col(latex), F.lit(r"\\def\\[a-zA-Z]+\{[^}]+\}"), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, r"\\def\\([a-zA-Z]+)\{", 1).alias("macro"), F.lit(0).alias("args"), F.regexp_extract(m, r"(?s)\{([^}]+)\}$", 1).alias("body")),
    )
    return formulas.where(F.col(latex).contains("\\")).select(*keys, F.inline(F.concat(new, old)))


def is_latex_code(code: Column, language: Column) -> Column:
    """Whether a block of code is LaTeX.

    Of the language the first word counts, as in ``LaTeX``, ``latex-0.10`` and ``{.latex 0_3}``.  Where there
    is none or it names no language (``lang``, ``text`` and the like), the code is LaTeX if it defines a macro, begins an environment, loads
    a class or package or has a command with an argument.
    """
    name = F.regexp_extract(F.lower(F.coalesce(language, F.lit(""))), r"^[^a-z]*([a-z]*)", 1)
    marks = code.rlike(r"\\(?:(?:re)?newcommand|providecommand|def\\|let\\|begin\{|documentclass|usepackage|[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{)")
    return name.isin("latex", "tex") | (name.isin("", "lang", "language", "text", "txt", "plain", "plaintext", "none", "unknown", "code") & F.coalesce(marks, F.lit(False)))


def _macros_before(formulas: DataFrame, chunk: int) -> DataFrame:
    """(document, place, macros) of the formulas that use macros defined before them; macros is a JSON object.

    An as-of join of uses to definitions by document and name, as a prefix scan: within chunks of
    places by a window, between chunks by a window over one row a chunk.  So a document with a
    third of all formulas, or a macro defined in each of them, is no task's whole work.
    """
    value = F.to_json(F.array(F.col("args").cast("string"), F.col("body")))
    defined = macro_definitions(formulas, ("document", "place")).select("document", "place", F.col("macro").alias("name"), value.alias("defined"))
    # Of several definitions in one formula the last counts; the parse of that formula knows its own.
    defined = defined.groupBy("document", "place", "name").agg(F.max("defined").alias("defined"))
    names = F.explode(F.array_distinct(F.regexp_extract_all("latex", F.lit(r"\\([a-zA-Z]+)"), F.lit(1)))).alias("name")
    used = formulas.where(F.col("latex").contains("\\")).select("document", "place", names)
    used = used.join(defined.select("document", "name").distinct(), ["document", "name"], "left_semi")
    both = used.withColumn("defined", F.lit(None).cast("string")).unionByName(defined).withColumn("chunk", F.floor(F.col("place") / chunk))
    chunks = both.groupBy("document", "name", "chunk").agg(F.max_by(F.when(F.col("defined").isNotNull(), F.col("defined")), F.when(F.col("defined").isNotNull(), F.col("place"))).alias("last"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = before.partitionBy("document", "name").orderBy("chunk")
    carried = chunks.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    # A definition sorts after the uses at its own place, where it doesn't count yet.
    inside = before.partitionBy("document", "name", "chunk").orderBy("place", F.col("defined").isNotNull())
    scanned = both.withColumn("here", F.last("defined", ignorenulls=True).over(inside)).where("defined IS NULL")
    known = scanned.join(carried, ["document", "name", "chunk"]).withColumn("known", F.coalesce("here", "carried")).where("known IS NOT NULL")
    return known.groupBy("document", "place").agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("name", "known")))).alias("macros"))


def parse_with_document_macros(formulas: DataFrame, document: str = "doc_id", order: str = "ordinal", latex: str = "latex", chunk: int = 20_000) -> DataFrame:
    """Validity and macro use where macros hold from their definition to the end of their document.

    Columns: document, order, latex, is_valid, macro_count.  Formulas without a document or an order have
    only their own macros; of formulas at the same place neither knows the other's.
    """
    own = formulas.select(F.col(document).alias("document"), F.col(order).alias("place"), F.col(latex).alias("latex")).where("latex IS NOT NULL")
    known = _macros_before(own.where("document IS NOT NULL AND place IS NOT NULL"), chunk)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def one(text: str, macros: str | None) -> dict:
            before = {n: (int(v[0]), v[1]) for n, v in ((n, json.loads(v)) for n, v in json.loads(macros or "{}").items())}
            parsed = grammar.parse(text, macros=before)
            return {"is_valid": not parsed.errors, "macro_count": parsed.counts["macros"]}

        known = memoised(one)
        for texts, macros in batches:
            yield pa.array([known(t, m) for t, m in zip(texts.to_pylist(), macros.to_pylist(), strict=True)], pa.struct([("is_valid", pa.bool_()), ("macro_count", pa.int32())]))

    rows = own.join(known, ["document", "place"], "left").withColumn("parsed", F.arrow_udf(run, "struct<is_valid:boolean,macro_count:int>")("latex", "macros"))
    return rows.select(F.col("document").alias(document), F.col("place").alias(order), F.col("latex").alias(latex), "parsed.is_valid", "parsed.macro_count")
