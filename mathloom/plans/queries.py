"""Named queries over the tables of a folder; each reads whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import latex as L
from mathloom.functions import vocab
from mathloom.operators import detect as D
from mathloom.operators import flatten, images, mathml, parse, pixels, render, stats
from mathloom.plans import cases, oracle, oracle_parse, pipeline
from mathloom.runtime import scratch, table
from mathloom.sources import export, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "quality_metrics"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    return D.detect(table(spark, sf, "documents"))


def _formulas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "formulas").select("formula_id", "latex").where("latex IS NOT NULL")


# Detection


@query
def detect_all(spark: SparkSession, sf: str) -> DataFrame:
    """All formulas of all documents, with place and confidence."""
    return _detected(spark, sf).select("doc_id", "start", "end", "math_type", "latex", "raw", "confidence")


def _of_kind(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _detected(spark, sf).where(F.col("math_type") == kind).select("doc_id", "start", "end", "latex", "confidence")

    run.__name__ = f"detect_{kind}"
    run.__doc__ = f"The formulas of type {kind}."
    return run


for _kind in ("display", "inline", "equation", "align", "matrix"):
    query(_of_kind(_kind))


@query
def detect_intended(spark: SparkSession, sf: str) -> DataFrame:
    """The formulas as meant: no second row for the inside of another, escaped dollars left alone."""
    return D.detect(table(spark, sf, "documents"), semantics="intended").select("doc_id", "ordinal", "start", "end", "math_type", "latex")


@query
def detect_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """The formulas of all documents, each with one more of the kinds that detection knows."""
    added = F.get(F.array(*(F.lit(t) for t in oracle.TEMPLATES)), (F.col("doc_id") % len(oracle.TEMPLATES)).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n"), F.replace(added, F.lit("#"), F.col("doc_id").cast("string"))).alias("text"))
    return D.detect(docs).select("doc_id", "start", "end", "math_type", "latex", "confidence")


@query
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas by confidence band."""
    return _detected(spark, sf).groupBy(L.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query
def confident_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """The formulas from a least confidence on."""
    return D.detect(table(spark, sf, "documents"), min_confidence=0.8).select("doc_id", "start", "math_type", "confidence")


@query
def environment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Environments begun in each document."""
    return D.environments(table(spark, sf, "documents"))


# Aggregations


@query
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.type_counts(_detected(spark, sf))


@query
def doc_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.type_counts(_detected(spark, sf), ("doc_id",))


@query
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, bands and quality counters over the whole collection."""
    return stats.quality(_detected(spark, sf))


@query
def extraction_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The same per document."""
    return stats.quality(_detected(spark, sf), ("doc_id",))


@query
def extraction_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the counts by type, in order of the types, and the number of potential errors."""
    pairs = F.array_sort(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    found = stats.extraction_validation(_detected(spark, sf), ("doc_id",))
    return found.withColumns({"by_type": F.array_join(pairs, ","), "potential_errors": F.size("potential_errors")})


@query
def content_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: totals of all kinds of content, kinds of formulas and diagrams, languages."""
    tables = (table(spark, sf, t) for t in ("formulas", "chemicals", "code_blocks", "diagrams"))
    s = stats.content_statistics(*tables)
    return s.select("doc_id", *(c for c in s.columns if c.startswith("total_")), F.size("formula_types").cast("bigint").alias("formula_kinds"), F.size("diagram_types").cast("bigint").alias("diagram_kinds"), F.concat_ws(",", "languages").alias("languages"))


@query
def stats_report(spark: SparkSession, sf: str) -> DataFrame:
    """The text report of each document."""
    return stats.stats_report(_detected(spark, sf))


# Normal forms


@query
def normalize_aggressive(spark: SparkSession, sf: str) -> DataFrame:
    return _formulas(spark, sf).select("formula_id", L.normalize(F.col("latex"), aggressive=True).alias("normal"))


@query
def normalize_default(spark: SparkSession, sf: str) -> DataFrame:
    return _formulas(spark, sf).select("formula_id", L.normalize(F.col("latex")).alias("normal"))


@query
def normalize_preserve(spark: SparkSession, sf: str) -> DataFrame:
    return _formulas(spark, sf).select("formula_id", L.normalize(F.col("latex"), preserve_spacing=True).alias("normal"))


@query
def formula_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _formulas(spark, sf).select("formula_id", L.formula_hash(F.col("latex")).alias("hash"))


@query
def dedup_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """One row per hash: the first formula and the number of copies."""
    return stats.duplicate_groups(_formulas(spark, sf), L.formula_hash(F.col("latex")), "formula_id").select("hash", "first_id", "copies")


# Tokens and parses


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.posexplode(L.lexical_tokens(F.col("latex"))).alias("ordinal", "token")
    return _formulas(spark, sf).select("formula_id", pairs)


@query
def lexical_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).withColumn("kind", L.token_kind(F.col("token")))


@query
def token_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).groupBy(L.token_kind(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))


@query
def greek_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Greek letters by occurrences and formulas; a formula's letters are counted before they are spread."""
    names = F.regexp_extract_all("latex", F.lit(r"(?s)\\([a-zA-Z]+|.)"), F.lit(1))
    greek = F.filter(names, lambda n: n.isin(*sorted(vocab.GREEK)))
    pairs = F.transform(F.array_distinct(greek), lambda g: F.struct(g.alias("letter"), F.size(F.filter(greek, lambda h: h == g)).alias("k")))
    rows = _formulas(spark, sf).select(F.inline(pairs))
    return rows.groupBy("letter").agg(F.sum("k").alias("n"), F.count("*").alias("formulas"))


@query
def unknown_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands outside the vocabulary, by the formulas that have them."""
    names = F.array_distinct(F.regexp_extract_all("latex", F.lit(r"(?s)\\([a-zA-Z]+|.)"), F.lit(1)))
    rows = _formulas(spark, sf).select(F.explode(names).alias("command"))
    known = F.col("command").isin(*sorted(vocab.KNOWN_COMMANDS)) | F.col("command").startswith("text")
    return rows.where(F.col("command").rlike("^[a-zA-Z]+$") & ~known).groupBy("command").agg(F.count("*").alias("formulas"))


@query
def brace_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Braces without a partner in each formula."""
    return _formulas(spark, sf).select("formula_id", L.brace_errors(F.col("latex")).alias("errors"))


@query
def parse_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Validity, complexity, size and depth of each formula."""
    return parse.parse(_formulas(spark, sf)).drop("latex")


@query
def parse_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and warnings of each formula, a row each."""
    parsed = parse.parse(_formulas(spark, sf), ("errors", "warnings"))

    def of(level: str) -> Column:
        # Of a second parameter the function would make the place in the list.
        return F.transform(f"{level}s", lambda f: F.struct(F.lit(level).alias("level"), f["type"].alias("type"), f["message"].alias("message"), f["position"].alias("position"), f["token_index"].alias("token_index")))

    return parsed.select("formula_id", F.inline(F.concat(of("error"), of("warning"))))


@query
def parse_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of each distinct formula as rows; every tree has a root, so the outer form loses and adds nothing."""
    return parse.parse_distinct(_formulas(spark, sf), ("nodes",)).select("latex", F.inline_outer("nodes"))


@query
def parse_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of each distinct formula, optional arguments included."""
    tokens = F.inline(F.transform("tokens", lambda t: F.struct(t["type"].alias("type"), t["value"].alias("value"), t["position"].alias("position"), t["length"].alias("length"), F.to_json(t["metadata"]).alias("metadata"))))
    return parse.parse_distinct(_formulas(spark, sf), ("tokens",)).select("latex", tokens)


@query
def complexity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counters behind each formula's complexity."""
    return parse.parse(_formulas(spark, sf), ("counts", "complexity_score")).select("formula_id", "counts.*", "complexity_score")


def _by_tokens(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    parsed = parse.parse(_formulas(spark, sf), ("tokens", "tree_depth", "complexity_score"))
    return parsed.select("formula_id", *(c.alias(n) for n, c in columns.items()))


@query
def simple_formulas(spark: SparkSession, sf: str) -> DataFrame:
    return _by_tokens(spark, sf, is_simple=parse.is_simple(F.col("tokens"), F.col("tree_depth"), F.col("complexity_score")))


@query
def render_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _by_tokens(spark, sf, size=parse.render_size(F.col("tokens"), F.col("tree_depth"))).select("formula_id", "size.width", "size.height")


@query
def components(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct parts of each formula, each kind in order of its first occurrence."""
    found = parse.parse(_formulas(spark, sf), ("components",)).select("formula_id", "components.*")
    return found.select("formula_id", *(F.array_join(c, " ").alias(c) for c in found.columns[1:]))


@query
def macro_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Macros that code blocks define."""
    return parse.macro_definitions(table(spark, sf, "code_blocks"), ("code_id",), "code").select("code_id", "macro", "args", "body")


@query
def document_macros(spark: SparkSession, sf: str) -> DataFrame:
    """LaTeX code parsed with the macros of its document.

    A block is LaTeX by its language, however spelled; where that is missing or names none, by its commands.
    """
    code = table(spark, sf, "code_blocks").where(parse.is_latex_code(F.col("code"), F.col("language")))
    return parse.parse_with_document_macros(code, "doc_id", "ordinal", "code").select("doc_id", "ordinal", "is_valid", "macro_count")


# MathML


@query
def mathml_reference(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "formulas").select("formula_id", "latex", "math_type")
    return mathml.to_mathml(rows, "reference", display=F.col("math_type") == "display").select("formula_id", "mathml")


@query
def mathml_intended(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "formulas").select("formula_id", "latex", "math_type")
    return mathml.to_mathml(rows, "intended", display=F.col("math_type") == "display").select("formula_id", "mathml")


@query
def mathml_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Validity and errors of the stored MathML."""
    found = mathml.validate(table(spark, sf, "formulas").select("formula_id", "mathml"))
    return found.select("formula_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query
def mathml_optimize(spark: SparkSession, sf: str) -> DataFrame:
    return mathml.optimise_documents(table(spark, sf, "formulas").select("formula_id", "mathml")).drop("mathml")


# Pipeline and export


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.process(table(spark, sf, "documents"), source_file="source")


@query
def process_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One result per document."""
    return _results(spark, sf).select("doc_id", "source_file", "success", "statistics.total_formulas")


@query
def parse_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """The warnings of all documents."""
    return _results(spark, sf).select("doc_id", F.inline("warnings")).select("doc_id", "type", "formula", F.size("errors").alias("errors"))


def _failing_find(text: str, semantics: str) -> list[tuple]:
    if "lemma" in text:
        raise ValueError("planted")
    return D.find(text, semantics)


def _failing_parse(latex: str) -> list[dict]:
    if "frac" in latex:
        raise ValueError("planted")
    return pipeline.errors_of(latex)


@query
def isolated_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Results where detection fails for some documents and the parse for some formulas: the others go on."""
    steps = pipeline.Steps(find=_failing_find, errors_of=_failing_parse)
    done = pipeline.process(table(spark, sf, "documents"), steps=steps)
    return done.select("doc_id", "success", F.get("errors.type", F.lit(0)).alias("error_type"), F.size("errors").alias("errors"), "statistics.total_formulas")


def _export(format: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return export.exported(_results(spark, sf), format)

    run.__name__ = f"export_{format}"
    run.__doc__ = "A document for each result, without a formula too."
    return run


for _format in export.FORMATS:
    query(_export(_format))


# Recognition and rendering


@query
def ocr_text_to_latex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chemicals").where("text IS NOT NULL").select("chem_id", L.text_to_latex(F.col("text")).alias("latex"))


@query
def ocr_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the values above 0, here of page numbers, as a share of 1."""
    return stats.ocr_confidence(table(spark, sf, "formulas").where("doc_id IS NOT NULL"), ("doc_id",), "page_number")


@query
def render_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _formulas(spark, sf).select("formula_id", L.render_cache_key(F.col("latex")).alias("general_key"), L.compile_cache_key(F.col("latex")).alias("compile_key"))


@query
def region_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of formulas that are neither too small nor too large, padded."""
    p = F.col("position")
    page = (F.lit(2000), F.lit(1_000_000))
    rows = table(spark, sf, "formulas").where(p.isNotNull() & images.keep_box(p["width"], p["height"], *page))
    return rows.select("formula_id", images.padded_box(p["x"], p["y"], p["width"], p["height"], *page).alias("b")).select("formula_id", "b.*")


@query
def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The sizes that drawings would be recognised at."""
    side = {s: F.regexp_extract("content", rf'{s}="(\d+)"', 1).try_cast("int").alias(s[0]) for s in ("width", "height")}
    rows = table(spark, sf, "diagrams").select("diagram_id", *side.values()).where("w > 0 AND h > 0")
    return rows.select("diagram_id", images.fitted_size(F.col("w"), F.col("h")).alias("s")).select("diagram_id", "s.*")


@query
def diagram_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Which branch would draw each diagram."""
    kind = F.regexp_replace(F.lower("diagram_type"), "_plot$", "")
    return table(spark, sf, "diagrams").select("diagram_id", render.diagram_route(kind).alias("r")).select("diagram_id", "r.*")


@query
def plot_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points of every function plot, summed up."""
    parts = [F.regexp_extract("content", r"^y = (\d+)\*x\^(\d+) ([+-] \d+)$", g) for g in (1, 2, 3)]
    rows = table(spark, sf, "diagrams").select("diagram_id", *(F.replace(x, F.lit(" "), F.lit("")).try_cast("double").alias(n) for x, n in zip(parts, "apc", strict=True))).where("a IS NOT NULL")
    points = render.polynomial_points(F.col("a"), F.col("p"), F.col("c"), F.lit(-10.0), F.lit(10.0))
    ys = F.transform(points, lambda q: q["y"])
    return rows.select("diagram_id", F.size(points).alias("points"), F.array_min(ys).alias("lowest"), F.array_max(ys).alias("highest"))


# Cases: rows of the formulas table take turns with inputs that it hardly holds


def _case_of(spark: SparkSession, sf: str, inputs: list[str]) -> DataFrame:
    chosen = F.get(F.array(*map(F.lit, inputs)), (F.col("formula_id") % len(inputs)).cast("int"))
    return table(spark, sf, "formulas").select("formula_id", chosen.alias("latex"))


@query
def parse_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Findings, tree and tokens of formulas with macros, comments, options, and openers and closers in disorder."""
    parsed = parse.parse(_case_of(spark, sf, [c[0] for c in cases.PARSES]), ("errors", "warnings", "nodes", "tokens"))

    def shown(level: str, found: str) -> Column:
        return F.transform(found, lambda f: F.concat_ws(" ", F.lit(level), f["type"], f["position"], f["token_index"], f["message"]))

    tree = F.transform("nodes", lambda n: F.rtrim(F.concat(n["id"].cast("string"), F.lit("<"), F.coalesce(n["parent"].cast("string"), F.lit("")), F.lit(" "), n["role"], n["ord"].cast("string"), F.lit(" "), n["type"], F.lit(" "), F.coalesce(n["value"], n["name"], F.lit("")), F.when(n["nested"], "*").otherwise(""))))
    tokens = F.transform("tokens", lambda t: F.concat(t["type"], F.lit(":"), t["position"].cast("string"), F.lit(":"), L.strip(t["value"])))
    found = F.concat(shown("E", "errors"), shown("W", "warnings"))
    return parsed.select("formula_id", F.array_join(found, "; ").alias("findings"), F.array_join(tree, "; ").alias("tree"), F.array_join(tokens, " ").alias("tokens"))


@query
def mathml_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Conversions as meant, every other one set apart."""
    rows = _case_of(spark, sf, [c[0] for c in cases.CONVERSIONS])
    return mathml.to_mathml(rows, "intended", display=F.col("formula_id") % 2 == 0).select("formula_id", F.regexp_replace("mathml", r"\n\s*", "").alias("mathml"))


@query
def detect_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Detection as meant, a row a formula."""
    rows = _case_of(spark, sf, [c[0] for c in cases.DETECTIONS])
    found = D.detect(rows, ("formula_id",), "latex", "intended")
    return found.select("formula_id", F.concat_ws(" ", F.concat("start", F.lit("-"), "end"), "math_type", "latex").alias("formula"))


@query
def mathml_validate_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = _case_of(spark, sf, [c[0] for c in cases.VALIDATIONS])
    return mathml.validate(rows, "latex").select("formula_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query
def mathml_optimize_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = _case_of(spark, sf, [c[0] for c in cases.OPTIMISATIONS])
    return mathml.optimise_documents(rows, "latex").select("formula_id", F.regexp_replace("optimised", r"\n\s*", "").alias("optimised"))


@query
def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The telling part of a compiler's output."""
    return _case_of(spark, sf, [c[0] for c in cases.LOGS]).select("formula_id", L.latex_error_message(F.col("latex")).alias("message"))


@query
def scan_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all kinds, read in the order of a list: texts and error rows."""
    folder = scratch(spark, "files")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content, *_ in cases.FILES:
        if content is not None:
            target = hadoop.Path(f"{folder}/{name}")
            out = target.getFileSystem(conf).create(target)
            out.write(bytearray(content))
            out.close()
    rows = files.scan_files(spark, [f"{folder}/{f[0]}" for f in cases.FILES])
    return rows.select("ordinal", "text", "error_type", F.replace("error", F.lit(folder + "/"), F.lit("")).alias("error"))


def _page(boxes: tuple) -> bytearray:
    image = np.full((160, 240), 255, np.uint8)
    for x, y, w, h in boxes:
        image[y : y + h, x : x + w] = 0
    return bytearray(pixels.encode(image))


@query
def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions of pages that may be formulas, in reading order, with the size of their cut-outs."""
    pages = spark.createDataFrame([(i, _page(boxes)) for i, (boxes, _) in enumerate(cases.PAGES)], "page int, content binary")
    found = pixels.math_regions(pages, ("page",))
    return found.select("page", "x", "y", "width", "height", F.regexp_extract(F.decode(F.substring("content", 1, 12), "ISO-8859-1"), r"^P5 (\d+ \d+)", 1).alias("size"))


class _Broken:
    name = "first"

    def is_available(self) -> bool:
        return True

    def recognize(self, content: bytes) -> dict:
        raise OSError("no connection")


class _Absent(_Broken):
    name = "absent"

    def is_available(self) -> bool:
        return False


class _Planted(_Broken):
    name = "second"

    def recognize(self, content: bytes) -> dict:
        return json.loads(content)


@query
def recognition_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Results of the first backend that gives a valid one; a failing or absent one gives way to the next."""
    images_ = spark.createDataFrame([(i, bytearray(json.dumps(r[0]).encode())) for i, r in enumerate(cases.REPLIES)], "image int, content binary")
    done = images.recognize(images_, [_Absent(), _Broken(), _Planted()])
    return done.select("image", "latex", "confidence", "error", "backend", images.valid_result(F.col("latex"), F.col("confidence"), F.col("error")).alias("is_valid"))


class _Regions(_Broken):
    name = "sizes"

    def recognize(self, content: bytes) -> dict:
        return {"latex": " ".join(x.decode() for x in content.split(None, 3)[:3]), "confidence": 1.0}


@query
def region_recognition(spark: SparkSession, sf: str) -> DataFrame:
    """Each region of each page recognised; the backend tells the size of what it is given."""
    pages = spark.createDataFrame([(i, _page(boxes)) for i, (boxes, _) in enumerate(cases.PAGES)], "page int, content binary")
    return images.recognize_regions(pages, ("page",), [_Regions()]).select("page", "x", "y", "width", "height", "latex", "confidence", "backend")


@query
def service_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a service takes them: PNG, smaller where they have too many bytes."""
    sizes = [(240, 160, 10_000_000), (4096, 64, 1), (100, 3000, 1)]
    rows = []
    for i, (width, height, most) in enumerate(sizes):
        png = pixels.prepared_png(pixels.encode(np.zeros((height, width), np.uint8)), images.OCRConfig(max_image_bytes=most))
        rows.append((i, bytearray(png)))
    done = spark.createDataFrame(rows, "image int, png binary")
    return done.select("image", F.hex(F.substring("png", 1, 8)).alias("signature"), F.conv(F.hex(F.substring("png", 17, 4)), 16, 10).cast("int").alias("width"), F.conv(F.hex(F.substring("png", 21, 4)), 16, 10).cast("int").alias("height"))


class _Drawing:
    name = "drawing"

    def is_available(self) -> bool:
        return True

    def render(self, latex: str, config: render.RenderConfig) -> dict:
        if "{" in latex:
            raise ValueError("no groups")
        return {"svg": f"<svg>{len(latex)}</svg>"}


class _Failing(_Drawing):
    name = "failing"

    def render(self, latex: str, config: render.RenderConfig) -> dict:
        return {"error": "out of ink"}


@query
def render_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Every formula drawn by the first renderer that can; where none can, the first one's error stays."""
    return render.render(_formulas(spark, sf), [_Failing(), _Drawing()]).select("formula_id", "svg", "error", "renderer")


@query
def vector_field(spark: SparkSession, sf: str) -> DataFrame:
    """The field (-y, x) on a grid of 3 by 3 as SVG."""
    grid = F.transform(render.vector_grid(F.lit(-1.0), F.lit(1.0), 3), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (-p["y"]).alias("u"), p["x"].alias("v")))
    svg = render.svg_vectors(grid, F.lit("a < b"), 100, 100, 10)
    return spark.range(1).select(F.explode(F.regexp_extract_all(svg, F.lit("<line ([^/]*) marker"), F.lit(1))).alias("line"))


# Compositions


@query
def formulas_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas by language and type; the language travels with the document, so nothing is joined."""
    found = D.detect(table(spark, sf, "documents"), ("doc_id", "lang"))
    return found.groupBy("lang", "math_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


@query
def formulas_of_rated(spark: SparkSession, sf: str) -> DataFrame:
    """Rated documents with their numbers of formulas; both sides are reduced before they meet."""
    rated = table(spark, sf, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = table(spark, sf, "formulas").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("formulas"))
    return rated.join(n, "doc_id", "left").fillna(0, ["formulas"])


@query
def first_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """The first three formulas of each document; their ordinal says which, no sort is needed."""
    return _detected(spark, sf).where("ordinal < 3").select("doc_id", "start", "latex", (F.col("ordinal") + 1).alias("n"))


@query
def failed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of processing runs by type."""
    errors = table(spark, sf, "results").select("doc_id", F.explode("errors").alias("e"))
    return errors.groupBy(F.col("e.type").alias("error_type")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


# Nested records


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each list item of every payload with the path of its parent."""
    return flatten.object_links(table(spark, sf, "stem_content"))


@query
def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each flat table, those without a parent and the records they come from."""
    folder = flatten.write_tables(table(spark, sf, "stem_content"))
    rows = [flatten.read_table(spark, folder, tag).select(F.lit(tag).alias("tag"), "content_id", "parent_path") for tag in flatten.TABLE_SCHEMAS]
    rows.append(flatten.read_others(spark, folder).select(F.lit("others").alias("tag"), "content_id", "parent_path"))
    return reduce(DataFrame.unionByName, rows).groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("parent_path") == "").alias("roots"), F.count_distinct("content_id").alias("records"))


@query
def p3_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of formulas, fields of the objects in them included."""
    folder = flatten.write_tables(table(spark, sf, "stem_content"))
    return flatten.read_table(spark, folder, "formulas").select("content_id", "object_path", "parent_path", "latex", "type", "confidence", "page_number", "mathml", "engine", "section")


@query
def p3_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of alternatives, which lie below formulas."""
    folder = flatten.write_tables(table(spark, sf, "stem_content"))
    return flatten.read_table(spark, folder, "alternatives").select("content_id", "object_path", "parent_path", "latex", "score")


@query
def p3_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables written by tag and read with their schemas: rows, parents and filled columns of each, ``rest`` being one; and those of items without a schema, if any."""
    folder = flatten.write_tables(table(spark, sf, "stem_content"))
    parts = []
    for tag in sorted(flatten.TABLE_SCHEMAS):
        rows = flatten.read_table(spark, folder, tag)
        filled = sum((F.col(c).isNotNull().cast("int") for c in rows.columns[3:]), F.lit(0))
        parts.append(rows.agg(F.lit(tag).alias("tag"), F.count("*").alias("n"), F.count_if(F.col("parent_path") == "").alias("roots"), F.sum(filled).alias("filled")))
    parts.append(flatten.read_others(spark, folder).agg(F.lit("others").alias("tag"), F.count("*").alias("n"), F.count_if(F.col("parent_path") == "").alias("roots"), F.count_if(F.col("body") != "{}").alias("filled")).where("n > 0"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


SQL: dict[str, str] = {name: sql for name, sql in (oracle.SQL | oracle_parse.SQL).items() if name in QUERIES}
