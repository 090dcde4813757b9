"""Nested JSON records to related flat tables, in one pass.

A depth-first visitor walks each payload once and emits, for every object that is an item
of a list, a row with a table tag, its own path, the path of the nearest enclosing item and
its scalar fields as JSON, those of plain objects in it included; of two fields of one name the
inner one is named by its path within the item.  The rows are written partitioned by tag; each table is read back
with its schema.

Defined results: a NULL, empty or invalid payload gives no row; a bare object where a list
is expected is item 0; a NULL in a list keeps its position and gives no row; an object
``metadata`` stored as a string of JSON counts as the object it holds; repeated deliveries
of the same record give each row once; an empty input gives empty tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.runtime import scratch, spread

#: Fields whose value is a list, though a single object may stand bare in its place.
LIST_FIELDS = frozenset(
    "formulas chemical_formulas code_blocks diagrams alternatives boxes refs series points outputs frames revisions".split()
)

#: Schemas of the flat tables, by tag; every table also has its keys.
TABLE_SCHEMAS = {
    "formulas": "latex STRING, type STRING, confidence DOUBLE, page_number INT, position ARRAY<INT>, mathml STRING, engine STRING, tags ARRAY<STRING>, section STRING",
    "chemical_formulas": "text STRING, smiles STRING, phase STRING",
    "code_blocks": "code STRING, language STRING, cell INT",
    "diagrams": "type STRING, content STRING, caption STRING, page_number INT",
    "alternatives": "latex STRING, score DOUBLE",
    "boxes": "glyph STRING, x INT, y INT",
    "refs": "label STRING, page INT",
    "series": "label STRING, style STRING",
    "points": "x INT, y INT",
    "outputs": "kind STRING, size INT",
    "frames": "fn STRING, line INT",
    "revisions": "rev INT, `by` STRING",
}

#: Partition of the list items under any other field.
_OTHERS = "others"
EMITTED = "content_id BIGINT, tag STRING, object_path STRING, parent_path STRING, body STRING, rest STRING"


def _no_constant(name: str) -> float:
    raise ValueError(name)


def _whole(text: str) -> int | float:
    return int(text) if len(text) < 4000 else float(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole)


def load_json(text: str | None):
    """The value of a strict JSON text, nested to any depth; raises ValueError where there is none."""
    if not text:
        raise ValueError("empty")
    try:
        return _DECODER.decode(text)
    except RecursionError:  # the C decoder's bound, which no setting moves
        return _decode(text)


_SPACE = re.compile(r"[ \t\n\r]*")


def _decode(text: str):
    """The same by a stack of open containers, which is slower."""
    scalar, space = _DECODER.raw_decode, _SPACE.match
    top: list = []
    stack: list[tuple[list | dict, str | None]] = [(top, None)]  # containers with the name that the next value gets
    at, expect = space(text).end(), "value"  # or "first": a value or an end
    while True:
        into, name = stack[-1]
        c = text[at : at + 1]
        if isinstance(into, dict) and expect != "next" and name is None:
            if c == "}" and expect == "first":
                stack.pop()
                at, expect = space(text, at + 1).end(), "next"
                continue
            if c != '"':
                raise ValueError("name expected")
            name, at = scalar(text, at)
            at = space(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("colon expected")
            stack[-1] = (into, name)
            at, expect = space(text, at + 1).end(), "value"
            continue
        if expect == "next":
            if into is top:
                if at != len(text):
                    raise ValueError("more than one value")
                return top[0]
            if c == ",":
                at, expect = space(text, at + 1).end(), "value"
            elif c == ("}" if isinstance(into, dict) else "]"):
                stack.pop()
                at = space(text, at + 1).end()
            else:
                raise ValueError("comma or end expected")
            continue
        if c == "]" and expect == "first":
            stack.pop()
            at, expect = space(text, at + 1).end(), "next"
            continue
        opened = {"{": {}, "[": []}.get(c)
        if opened is None:
            value, at = scalar(text, at)
        else:
            value, at = opened, at + 1
        if isinstance(into, dict):
            into[name] = value
            stack[-1] = (into, None)
        else:
            into.append(value)
        if opened is not None:
            stack.append((opened, None))
        at, expect = space(text, at).end(), "next" if opened is None else "first"


def _dumped(value) -> str:
    """JSON of a value nested to any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    parts: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # whether it is text already
    while todo:
        done, x = todo.pop()
        if done:
            parts.append(x)
        elif isinstance(x, dict):
            todo.append((True, "}"))
            for i, (k, y) in reversed([*enumerate(x.items())]):
                todo += [(False, y), (True, (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ")]
            todo.append((True, "{"))
        elif isinstance(x, list):
            todo.append((True, "]"))
            for i, y in reversed([*enumerate(x)]):
                todo += [(False, y), (True, ", " if i else "")]
            todo.append((True, "["))
        else:
            parts.append(json.dumps(x, ensure_ascii=False))
    return "".join(parts)


#: Of each tag the fields its schema names, and their types.
_FIELDS = {tag: {name.strip("`"): kind for name, kind in (f.split(" ") for f in schema.split(", "))} for tag, schema in TABLE_SCHEMAS.items()}
_FITS = {
    "STRING": lambda x: isinstance(x, str),
    "INT": lambda x: type(x) is int and -(2**31) <= x < 2**31,
    "DOUBLE": lambda x: type(x) is float or type(x) is int and abs(x) <= 2**53,
    "ARRAY<STRING>": lambda x: isinstance(x, list) and all(y is None or _FITS["STRING"](y) for y in x),
    "ARRAY<INT>": lambda x: isinstance(x, list) and all(y is None or _FITS["INT"](y) for y in x),
}


def _rest(tag: str, body: dict) -> dict:
    """The fields that the tag's schema doesn't name or whose values its types can't hold."""
    if (fields := _FIELDS.get(tag)) is None:
        return {}  # all of it is read
    return {k: x for k, x in body.items() if x is not None and not (k in fields and _FITS[fields[k]](x))}


def _without_objects(values: list) -> list | None:
    """A list with NULL for each object, which has its own row; None where nothing else is left."""
    top: list = []
    todo, kept = [(values, top)], False
    while todo:
        source, target = todo.pop()
        for x in source:
            if isinstance(x, list):
                target.append([])
                todo.append((x, target[-1]))
            else:
                target.append(None if isinstance(x, dict) else x)
                kept = kept or target[-1] is not None
    return top if kept else None


def _put(body: dict, name: str, path: str, x) -> None:
    """Give ``x`` its name or, where another field has it, its path within the item."""
    if name in body:
        name = path
        while name in body:
            name = "/" + name
    body[name] = x


def visit(payload: str | None) -> Iterator[tuple[str, str, str, str]]:
    """Tag, path, parent path and body of each list item in a payload, depth first."""
    for tag, path, parent, body in _items(payload):
        yield tag, path, parent, _dumped(body)


def _items(payload: str | None) -> Iterator[tuple[str, str, str, dict]]:
    try:
        root = load_json(payload)
    except ValueError:
        return
    # A stack instead of recursion: nesting has no bound.
    stack = [(root, "", "", "", False)]
    while stack:
        value, path, parent, tag, item = stack.pop()
        if isinstance(value, list):
            at = path + "/" if path else ""
            stack.extend((x, f"{at}{i}", parent, tag, True) for i, x in reversed([*enumerate(value)]) if isinstance(x, (dict, list)))
        elif isinstance(value, dict):
            body, below = {}, []
            skip = len(path) + 1 if path else 0
            owner = path if item else parent
            todo = [(value, path)]
            while todo:  # the object and the plain objects in it form one row
                part, at = todo.pop()
                for key, x in part.items():
                    if key == "metadata" and isinstance(x, str):
                        try:
                            held = load_json(x)
                            x = held if isinstance(held, dict) else x
                        except ValueError:
                            pass
                    to = f"{at}/{key}" if at else key
                    if isinstance(x, dict) and key in LIST_FIELDS:
                        below.append((x, to + "/0", owner, key, True))
                    elif isinstance(x, list) and any(isinstance(y, (dict, list)) for y in x):
                        below.append((x, to, owner, key, False))
                        if item and (scalars := _without_objects(x)) is not None:
                            _put(body, key, to[skip:], scalars)
                    elif isinstance(x, dict):
                        todo.append((x, to))
                    elif key not in LIST_FIELDS or x not in (None, []):
                        _put(body, key, to[skip:], x)
            if item:
                yield tag, path, parent, body
            stack.extend(reversed(below))


_SCHEMA = pa.schema([("content_id", pa.int64()), *((c, pa.string()) for c in ("tag", "object_path", "parent_path", "body", "rest"))])
#: Characters after which a batch is given on.
_BATCH = 8_000_000


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SCHEMA, strict=True)], schema=_SCHEMA)

    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        size = 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for tag, path, parent, body in _items(text.as_py()):
                if rest := _rest(tag, body):
                    body = {k: x for k, x in body.items() if k not in rest}
                row = (tag, path, parent, _dumped(body), _dumped(rest) if rest else None)
                for column, x in zip(rows, (key, *row), strict=True):
                    column.append(x)
                # Of deep payloads the paths are most.
                size += sum(len(x) for x in row if x)
                if size > _BATCH:
                    yield batch_of(rows)
                    rows, size = ([], [], [], [], [], []), 0
        yield batch_of(rows)


def emit_tagged(records: DataFrame, key: str = "content_id", payload: str = "payload") -> DataFrame:
    """All list items of all payloads as tagged rows (schema ``EMITTED``), repeated deliveries included."""
    df = records.select(F.col(key).cast("bigint").alias("content_id"), F.col(payload).alias("payload")).where("payload IS NOT NULL")
    return spread(df).mapInArrow(_emit, EMITTED)


def _read(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    schema = "content_id BIGINT, object_path STRING, parent_path STRING, body STRING, rest STRING, field STRING, tag STRING"
    return spark.read.schema(schema).parquet(folder).where(F.col("tag") == tag)


def write_tables(records: DataFrame, folder: str | None = None, key: str = "content_id", payload: str = "payload") -> str:
    """Write the tagged rows once, partitioned by tag, and give the folder.

    Without ``folder`` a new one in the shared checkpoint folder is used, which goes with the application.
    """
    if folder is None:
        folder = scratch(records.sparkSession, "flat")
    rows = emit_tagged(records, key, payload).withColumn("field", F.col("tag"))
    # Any name may be a field's, so those without a schema share a partition.
    rows = rows.withColumn("tag", F.when(F.col("tag").isin(*TABLE_SCHEMAS), F.col("tag")).otherwise(_OTHERS))
    rows.write.mode("overwrite").partitionBy("tag").parquet(folder)
    return folder


def _typed(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    rows = _read(spark, folder, tag).select("content_id", "object_path", "parent_path", F.from_json("body", TABLE_SCHEMAS[tag]).alias("b"), "rest")
    return rows.select("content_id", "object_path", "parent_path", "b.*", "rest")


def read_table(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    """The flat table of one tag, read by partition and with its schema.

    Columns: content_id, object_path, parent_path, those of ``TABLE_SCHEMAS`` and ``rest``, the
    fields beyond the schema as a JSON object, or NULL; of repeated deliveries each row comes once.
    """
    return _typed(spark, folder, tag).distinct()


def read_others(spark: SparkSession, folder: str) -> DataFrame:
    """The list items under fields without a schema: content_id, object_path, parent_path, field and body."""
    return _read(spark, folder, _OTHERS).select("content_id", "object_path", "parent_path", "field", "body").distinct()


def object_links(records: DataFrame, key: str = "content_id", payload: str = "payload") -> DataFrame:
    """One row per list item: record, its path and its parent's path, each once; read from the tables, which are written first."""
    spark, folder = records.sparkSession, write_tables(records, None, key, payload)
    # Repeated rows go once, in the end, when only the links are left of them.
    tables = [_typed(spark, folder, tag) for tag in sorted(TABLE_SCHEMAS)] + [_read(spark, folder, _OTHERS)]
    return reduce(DataFrame.unionByName, (t.select("content_id", "object_path", "parent_path") for t in tables)).distinct()
