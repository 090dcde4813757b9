"""Duplicates hidden by formatting differences (problem 4).

Values are canonicalised - characters, case, whitespace, punctuation and field order -, hashed
to 128 bits and counted with partial aggregates before the shuffle.  A second, independent
64-bit hash of the canonical text goes with each digest as the collision check: records are
copies only if both agree, and digests with several checks are reported.

ASCII values are canonicalised by JVM expressions; Python sees only values with other characters,
which in LaTeX take the form of problem 1 first, and code that may be one JSON object.

Defined results: NULL values belong to no group; values that are empty once formatting is gone
form one group; equal stored strings are copies that differ in nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.llm.visual import _PLAIN, BASE, Forms, forms_for
from mathloom.runtime import cut, spread

# What formatting is, as patterns for both Java and Python.
_SPACING = r"(?i)(\\\\)|\\(?:left|right|qquad|quad)(?![A-Za-z])|\\[,;:!]"
#: The white space of ASCII, all that the JVM expressions meet.
_BLANK = r"[\x09-\x0D\x1C-\x20"
_LATEX_MARKS, _CODE_MARKS = ".,;:", ".,;:'\""
_spacing = re.compile(_SPACING)


def latex_text(latex: Column) -> Column:
    """Canonical text of ASCII LaTeX, as a JVM expression."""
    spaced = F.when(latex.contains("\\"), F.regexp_replace(latex, _SPACING, "$1")).otherwise(latex)
    return F.lower(F.regexp_replace(spaced, _BLANK + _LATEX_MARKS + "]", ""))


def code_text(code: Column) -> Column:
    """Canonical text of ASCII code that isn't a JSON object, as a JVM expression."""
    return F.lower(F.regexp_replace(code, _BLANK + _CODE_MARKS + "]", ""))


def _bare(text: str, marks: str) -> str:
    """``text`` in lower case without white space and marks."""
    return "".join(c for c in text if not c.isspace() and c not in marks).lower()


def odd_latex_text(latex: str, forms: Forms = BASE) -> str:
    """Canonical text of LaTeX whose characters may need the form of problem 1."""
    return _bare(_spacing.sub(lambda m: m[1] or "", forms.one_form(latex)), _LATEX_MARKS)


_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([{}\[\],:]))', re.I)


def json_text(code: str) -> str | None:
    """Canonical text of a JSON object with its members in order of their text, or None if ``code`` isn't one.

    Words and escapes count in any letter case.  Scalars keep their spelling: 1.0 and 1.00 differ.  One
    scan without recursion or conversion: nesting and numbers have no bound.
    """
    # Innermost first: each open container gathers the texts of its members.
    stack: list[tuple[str, list[str]]] = [("", [""])]
    at, expect = 0, "value"  # or "first": a value or an end; "name"; "colon"; "next"
    while m := _TOKEN.match(code, at):
        at, (string, scalar, sign) = m.end(), m.groups()
        kind, parts = stack[-1]
        if sign == ":" and expect == "colon":
            expect = "value"
        elif sign == "," and expect == "next" and kind:
            parts.append("")
            expect = "name" if kind == "{" else "value"
        elif sign and sign in "}]" and expect in ("next", "first") and kind == {"}": "{", "]": "["}[sign]:
            stack.pop()
            stack[-1][1][-1] += kind + "".join(sorted(parts) if kind == "{" else parts) + sign
            expect = "next"
        elif string and (expect == "name" or expect == "first" and kind == "{"):
            parts[-1] += _bare(string, _CODE_MARKS)
            expect = "colon"
        elif sign and sign in "{[" and (expect == "value" or expect == "first" and kind == "["):
            stack.append((sign, [""]))
            expect = "first"
        elif (string or scalar) and (expect == "value" or expect == "first" and kind == "["):
            parts[-1] += _bare(string or scalar, _CODE_MARKS)
            expect = "next"
        else:
            return None
        if len(stack) == 1 and expect == "next":
            # A whole value: nothing but white space may follow, and it must be an object.
            return stack[0][1][0] if sign == "}" and not code[at:].strip(" \t\n\r") else None
    return None


def odd_code_text(code: str, forms: Forms = BASE) -> str:
    """Canonical text of code that looks like a JSON object."""
    text = json_text(code)
    return _bare(code, _CODE_MARKS) if text is None else text


#: Of each kind of field: the JVM expression for ASCII values, the test for values that need Python, the Python function.
KINDS = {
    "latex": (latex_text, lambda c: c.rlike(_PLAIN), odd_latex_text),
    "code": (code_text, lambda c: c.rlike(r"^\s*\{|[^\x00-\x7F]"), odd_code_text),
}


def canonical(records: DataFrame, kind: str) -> DataFrame:
    """(id, value, canonical) of records (id, value) that aren't NULL."""
    plain, odd, text = KINDS[kind]
    forms = forms_for(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.array([text(x, forms) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), done], names=["id", "value", "canonical"])

    records = records.select(F.col("id").cast("bigint").alias("id"), "value").where("value IS NOT NULL")
    is_odd = odd(F.col("value"))
    by_python = spread(records.where(is_odd)).mapInArrow(run, "id bigint, value string, canonical string")
    return records.where(~is_odd).withColumn("canonical", plain(F.col("value"))).unionByName(by_python)


def hashed(records: DataFrame, kind: str) -> DataFrame:
    """(id, digest, check, stored): 128-bit digest and 64-bit check of the canonical text, 64-bit hash of the stored one."""
    text = F.col("canonical")
    return canonical(records, kind).select("id", F.unhex(F.md5(text)).alias("digest"), F.xxhash64(F.lit(kind), text).alias("check"), F.xxhash64("value").alias("stored"))


def copy_groups(rows: DataFrame) -> DataFrame:
    """One row per group of ``hashed`` records: digest, check, first_id, copies, and whether stored texts differ."""
    return rows.groupBy("digest", "check").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), (F.min("stored") != F.max("stored")).alias("differ"))


def collisions(groups: DataFrame) -> DataFrame:
    """Digests that different canonical texts share, with the number of texts; ``copy_groups`` keeps them apart."""
    return groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")


def copy_members(rows: DataFrame, hot: int = 1024, least: int = 10_000) -> DataFrame:
    """(first_id, copy_id) of every member but the first of the groups whose stored texts differ.

    A group can hold a third of all rows.  Groups of more than ``least`` rows and more than one of
    ``hot`` parts of all rows in such groups are joined where the rows are: there are fewer than ``hot`` of them, 32
    bytes each.  Only the rows of other groups are shuffled.  The hashed rows are written once.
    """
    rows = cut(rows)
    groups = cut(copy_groups(rows).where("differ").select("digest", "check", "first_id", "copies"))
    limit = max(least, (groups.agg(F.sum("copies")).first()[0] or 0) / hot)
    key = ["digest", "check"]
    large = groups.where(F.col("copies") > limit).drop("copies")
    small = groups.where(F.col("copies") <= limit).drop("copies")
    found = rows.join(F.broadcast(large), key, "left_anti").join(small, key).select("first_id", "id")
    if not large.isEmpty():
        found = found.unionByName(rows.join(F.broadcast(large), key).select("first_id", "id"))
    return found.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
