"""The whole way from text to results: detect, parse, convert, collect, export.

A document's formulas come from its own row, so they stay nested in it: nothing is shuffled
and no group is gathered.

Failures are rows, too.  A formula whose parse fails is left out and gives its document an error of the kind
``formula_extraction``, one whose conversion fails stays and gives a warning of the kind ``mathml_conversion``; where
detection itself fails, the document has no formula and an error of the kind ``general``.  The
other formulas and documents go on; ``success`` says that there is no error.

Defined results: a NULL text is an empty result without errors; ``processing_time`` is NULL
unless the configuration asks for it, as it differs from run to run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions.latex import confidence, position
from mathloom.operators import grammar
from mathloom.operators.detect import find
from mathloom.operators.mathml import convert, reference_mathml
from mathloom.runtime import memoised, spread

_FINDING = pa.struct([("type", pa.string()), ("message", pa.string()), ("position", pa.int32()), ("token_index", pa.int32())])
_FORMULA = pa.struct([("ordinal", pa.int32()), ("start", pa.int32()), ("math_type", pa.string()), ("latex", pa.string()), ("raw", pa.string()), ("mathml", pa.string()), ("failed", pa.bool_())])
_WARNING = pa.struct([("type", pa.string()), ("formula", pa.string()), ("errors", pa.list_(_FINDING))])
_ERROR = pa.struct([("type", pa.string()), ("error", pa.string())])
_NESTED = (
    "formulas array<struct<ordinal:int,start:int,math_type:string,latex:string,raw:string,mathml:string,failed:boolean>>, "
    "warnings array<struct<type:string,formula:string,errors:array<struct<type:string,message:string,position:int,token_index:int>>>>, "
    "errors array<struct<type:string,error:string>>, processing_time double"
)


@dataclass(frozen=True)
class ProcessConfig:
    """What a run does.  ``semantics`` chooses between observed and intended behaviour of detection and MathML."""

    extract_formulas: bool = True
    convert_to_mathml: bool = True
    semantics: str = "reference"
    min_confidence: float | None = None
    #: Seconds that a document takes in its task.
    timed: bool = False


def errors_of(latex: str) -> list[dict]:
    """The errors of a formula's parse."""
    return [e._asdict() for e in grammar.parse(latex).errors]


@dataclass(frozen=True)
class Steps:
    """What is done to texts and formulas; each may fail for one without ending the others."""

    find: Callable = find
    errors_of: Callable = errors_of
    convert: Callable = convert


def build_pipeline(**options) -> ProcessConfig:
    """A configuration from named options."""
    return ProcessConfig(**options)


def process(documents: DataFrame, config: ProcessConfig = ProcessConfig(), keys: tuple[str, ...] = ("doc_id",), text: str = "text", source_file: str | None = None, steps: Steps = Steps()) -> DataFrame:
    """One result per document: keys, source_file, formulas, warnings, errors, statistics, processing_time, success."""
    n = len(keys)
    intended = config.convert_to_mathml and config.semantics == "intended"

    def tried(function: Callable) -> Callable:
        """The result and None, or None and what is said of the failure."""

        def run(value):
            try:
                return function(value), None
            except Exception as e:  # whatever fails is an entry of its document
                return None, str(e)

        return memoised(run)

    def one(value: str, parsed: Callable, converted: Callable) -> tuple[list[dict], list[dict], list[dict]]:
        formulas, warnings, errors = [], [], []
        try:
            found = steps.find(value, config.semantics)
        except Exception as e:
            return [], [], [{"type": "general", "error": str(e)}]
        for ordinal, start, _, kind, latex, raw in found:
            wrong, failure = parsed(latex)
            if failure is not None:
                errors.append({"type": "formula_extraction", "error": failure})
                continue
            if wrong:
                warnings.append({"type": "parse_warning", "formula": latex, "errors": wrong})
            mathml, failure = converted(latex) if intended else (None, None)
            if failure is not None:
                warnings.append({"type": "mathml_conversion", "formula": latex, "errors": [{"type": "mathml_conversion", "message": failure, "position": None, "token_index": None}]})
            formulas.append({"ordinal": ordinal, "start": start, "math_type": kind, "latex": latex, "raw": raw, "mathml": mathml, "failed": failure is not None})
        return formulas, warnings, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, converted = tried(steps.errors_of), tried(steps.convert)
        for batch in batches:
            rows, times = [], []
            for value in batch.column(n).to_pylist():
                began = time.perf_counter()
                rows.append(one(value, parsed, converted) if value and config.extract_formulas else ([], [], []))
                times.append(time.perf_counter() - began if config.timed else None)
            formulas, warnings, errors = (pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate((_FORMULA, _WARNING, _ERROR)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *batch.columns[n + 1 :], formulas, warnings, errors, pa.array(times, pa.float64())], names=[*keys, "source_file", "formulas", "warnings", "errors", "processing_time"])

    source = F.lit(None).cast("string") if source_file is None else F.col(source_file)
    rows = documents.select(*keys, F.col(text).alias("__text"), source.alias("source_file"))
    schema = ", ".join(f"`{k}` {t}" for k, t in documents.select(*keys).dtypes)
    nested = spread(rows).mapInArrow(run, f"{schema}, source_file string, {_NESTED}")

    def full(f: Column) -> Column:
        mathml = f["mathml"] if intended or not config.convert_to_mathml else reference_mathml(f["latex"])
        return F.struct(
            f["latex"].alias("latex"), f["math_type"].alias("math_type"), position(f["start"]).alias("position"), F.lit(1).alias("page_number"),
            confidence(f["raw"]).alias("confidence"), mathml.alias("mathml"),
        )

    # Those whose conversion gives nothing without failing, as they are too long or hold what XML can't.
    silent = F.filter("formulas", lambda f: ~f["failed"])
    formulas = F.transform("formulas", full)
    if config.min_confidence is not None:
        formulas = F.filter(formulas, lambda f: f["confidence"] >= config.min_confidence)
    rows = nested
    if config.convert_to_mathml:
        nothing = F.array().cast("array<struct<type:string,message:string,position:int,token_index:int>>")
        lost = F.filter(F.transform(silent, full), lambda f: f["mathml"].isNull())
        lost = F.transform(lost, lambda f: F.struct(F.lit("mathml_conversion").alias("type"), f["latex"].alias("formula"), nothing.alias("errors")))
        rows = rows.withColumn("warnings", F.concat("warnings", lost))
    rows = rows.withColumn("formulas", formulas)
    types = F.transform("formulas", lambda f: f["math_type"])
    counts = F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("k"), F.size(F.filter(types, lambda u: u == t)).alias("v"))))
    statistics = F.struct(F.size("formulas").alias("total_formulas"), *(F.lit(0).alias(f"total_{x}") for x in ("chemical_formulas", "code_blocks", "diagrams")), counts.alias("formula_types"))
    return rows.withColumns({"statistics": statistics, "success": F.size("errors") == 0})


def process_files(spark: SparkSession, paths: list[str], config: ProcessConfig = ProcessConfig()) -> DataFrame:
    """Results of a list of files in its order (``ordinal``); files that can't be read have their error."""
    from mathloom.sources.files import scan_files

    files = scan_files(spark, paths)
    done = process(files.where("error IS NULL"), config, ("ordinal",), source_file="source_file")
    failed = process(files.where("error IS NOT NULL").withColumn("text", F.lit(None).cast("string")), config, ("ordinal", "error_type", "error"), source_file="source_file")
    failed = failed.withColumns({"errors": F.array(F.struct(F.col("error_type").alias("type"), F.col("error").alias("error"))), "success": F.lit(False)}).drop("error_type", "error")
    return done.unionByName(failed)
