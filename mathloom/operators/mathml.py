"""LaTeX to MathML, validation and optimisation of MathML.

Two semantics.  ``reference`` is what the converter is observed to give: an error document for
every formula that isn't blank, a JVM expression here.  ``intended`` is a full conversion in Arrow
batches; each task remembers the formulas it met.

Defined results: NULL and formulas over 10,000 characters give NULL; a blank formula gives an
empty ``math`` element; text that XML can't hold gives NULL under ``reference`` and loses those
characters under ``intended``; nesting too deep for the converter gives the error document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions import vocab
from mathloom.functions.latex import strip
from mathloom.operators.grammar import Token, macros_of, tokenize
from mathloom.runtime import memoised, spread

_ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"
_illegal = re.compile(_ILLEGAL)


class Element(NamedTuple):
    tag: str
    content: str | list[Element] = ""
    attributes: dict[str, str] = {}


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def serialise(element: Element) -> str:
    """XML indented by two spaces, text beside its tags, empty elements closed in one tag."""
    lines: list[str] = []
    stack: list[tuple[Element | str, int]] = [(element, 0)]
    while stack:
        item, depth = stack.pop()
        pad = "  " * depth
        if isinstance(item, str):
            lines.append(f"{pad}</{item}>")
            continue
        head = item.tag + "".join(f' {k}="{escape(v).replace(chr(34), "&quot;")}"' for k, v in item.attributes.items())
        if not item.content:
            lines.append(f"{pad}<{head}/>")
        elif isinstance(item.content, str):
            lines.append(f"{pad}<{head}>{escape(item.content)}</{item.tag}>")
        else:
            lines.append(f"{pad}<{head}>")
            stack.append((item.tag, depth))
            stack.extend((c, depth + 1) for c in reversed(item.content))
    return "\n".join(lines) + "\n"


def optimise(element: Element, root: bool = True, counted: bool = False) -> list[Element]:
    """Without rows of one element, empty rows and styles that set nothing; bottom-up.

    An empty row stays where its parent needs a certain number of children (``counted``).
    """
    if isinstance(element.content, str):
        below: str | list[Element] = element.content
    else:
        below = [x for c in element.content for x in optimise(c, False, element.tag in vocab.MATHML_ARITY)]
    if not root:
        if element.tag == "mrow" and not below and not counted:
            return []
        if element.tag == "mrow" and isinstance(below, list) and len(below) == 1:
            return below
        if element.tag == "mstyle" and not element.attributes and not counted:
            return [] if isinstance(below, str) else below
    return [element._replace(content=below)]


def symbol(name: str, category: str | None = None, symbols: dict[str, dict[str, str]] | None = None) -> str | None:
    """The character of a command, in one category or the first that has it."""
    table = vocab.SYMBOLS if symbols is None else symbols
    if category in table:
        return table[category].get(name)
    return next((m[name] for m in table.values() if isinstance(m, dict) and name in m), None)


def _fence(char: str) -> Element:
    return Element("mo", char, {"fence": "true", "stretchy": "true"})


class _Converter:
    """Reads tokens from left to right; each method leaves the cursor after what it used."""

    def __init__(self, tokens: list[Token], symbols: dict | None = None):
        self.tokens = [t for t in tokens if t.type != "comment" and not (t.type == "spacing" and not t.value.strip())]
        self.raw = tokens
        self.symbols, self.at = symbols, 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def row(self, closing: str | None = None) -> list[Element]:
        """Elements up to the end, or to the brace or environment end that ``closing`` names."""
        out: list[Element] = []
        while (t := self.peek()) is not None:
            if closing == "}" and t.type == "group" and t.value == "}":
                self.at += 1
                break
            if t.type in ("subscript", "superscript"):
                base = out.pop() if out else Element("mi")
                out.append(self.script(base))
                continue
            out += self.element()
        return out

    def script(self, base: Element) -> Element:
        parts: dict[str, Element] = {}
        while (t := self.peek()) is not None and t.type in ("subscript", "superscript") and t.type not in parts:
            self.at += 1
            parts[t.type] = self.argument()
        if len(parts) == 2:
            return Element("msubsup", [base, parts["subscript"], parts["superscript"]])
        kind, content = next(iter(parts.items()))
        return Element("msub" if kind == "subscript" else "msup", [base, content])

    def argument(self) -> Element:
        """The next group as a row, else the next element; an empty identifier where nothing is left."""
        t = self.peek()
        if t is None or t.type == "group" and t.value == "}":
            return Element("mi")
        if t.type == "group":
            self.at += 1
            return Element("mrow", self.row("}"))
        found = self.element()
        return found[0] if len(found) == 1 else Element("mrow", found)

    def text(self) -> str:
        """The characters of the next group as they stand, white space included."""
        t = self.peek()
        if t is None:
            return ""
        self.at += 1
        if not (t.type == "group" and t.value == "{"):
            return t.value
        start = next(i for i, r in enumerate(self.raw) if r is t) + 1
        depth, words = 1, []
        for r in self.raw[start:]:
            depth += {"{": 1, "}": -1}.get(r.value, 0) if r.type == "group" else 0
            if depth == 0:
                break
            words.append(r.value)
        depth = 1
        while depth and (t := self.peek()) is not None:
            depth += {"{": 1, "}": -1}.get(t.value, 0) if t.type == "group" else 0
            self.at += 1
        return "".join(words)

    def element(self) -> list[Element]:
        """What the next token begins; some tokens show nothing."""
        t = self.tokens[self.at]
        self.at += 1
        kind, value, subtype = t.type, t.value, t.metadata.get("subtype")
        name = value.lstrip("\\")
        if kind == "variable":
            return [Element("mi", value)]
        if kind == "number":
            return [Element("mn", value)]
        if kind == "operator":
            if subtype == "function":
                return [Element("mi", symbol(name, "functions", self.symbols) or name)]
            return [Element("mo", symbol(value, "operators", self.symbols) or value)]
        if kind == "symbol":
            return [Element("mi", symbol(name, "greek_letters", self.symbols) or name if subtype == "greek" else value)]
        if kind == "delimiter":
            return [Element("mo", symbol(value, "delimiters", self.symbols) or value)]
        if kind == "optional":
            return [Element("mo", "["), *_Converter(tokenize(t.metadata["content"]), self.symbols).row(), Element("mo", "]")]
        if kind == "group":
            return [Element("mrow", self.row("}"))] if value == "{" else [Element("mtext", value)]
        if kind == "macro":
            return [Element("mi", value)]
        if kind == "spacing":
            return [Element("mspace", "", {"width": "0.5em"})]
        if kind == "environment":
            return [self.environment(t)]
        return self.command(value, name, subtype)

    def command(self, value: str, name: str, subtype: str | None) -> list[Element]:
        if name == "frac":
            return [Element("mfrac", [self.argument(), self.argument()])]
        if name == "binom":
            return [Element("mrow", [Element("mo", "("), Element("mfrac", [self.argument(), self.argument()], {"linethickness": "0"}), Element("mo", ")")])]
        if name == "sqrt":
            t = self.peek()
            if t is not None and t.type == "optional":
                self.at += 1
                index = _Converter(tokenize(t.metadata["content"]), self.symbols).row()
                return [Element("mroot", [self.argument(), index[0] if len(index) == 1 else Element("mrow", index)])]
            return [Element("msqrt", [self.argument()])]
        if subtype == "accent":
            accent = Element("mo", symbol(name, "accents", self.symbols) or "^", {"accent": "true"})
            return [Element("mover", [self.argument(), accent])]
        if subtype == "font":
            if name not in vocab.MATH_VARIANTS:
                return [Element("mtext", self.text())]
            return [Element("mstyle", [self.argument()], {"mathvariant": vocab.MATH_VARIANTS[name]})]
        if value in vocab.LARGE_OPERATORS:
            limits = {"movablelimits": "true"} if value in vocab.SUMS_PRODUCTS else {}
            return [Element("mo", vocab.LARGE_OPERATORS[value], {"largeop": "true"} | limits)]
        if subtype == "delimiter_modifier":
            t = self.peek()
            if t is None:
                return []
            if t.type == "optional":  # a bracket after \left is no argument
                rest = tokenize(t.value[1:])
                self.tokens[self.at : self.at + 1] = [x for x in rest if x.type != "spacing" or x.value.strip()]
                return [_fence("[")]
            self.at += 1
            return [Element("mrow")] if t.value == "." else [_fence(symbol(t.value, "delimiters", self.symbols) or t.value)]
        if name in ("limits", "nolimits"):
            return []
        found = symbol(value, None, self.symbols)
        return [Element("mo", found)] if found else [Element("mi", value)]

    def environment(self, begin: Token) -> Element:
        """A table for the environments that are one, else a row; an environment left open ends with its formula."""
        if begin.metadata.get("env_type") != "begin":
            return Element("mtext", begin.value)
        name = begin.metadata["env_name"]
        plain = name.rstrip("*")
        columns = ""
        if plain == "array" and (t := self.peek()) is not None and t.type == "group" and t.value == "{":
            columns = "".join(c for c in self.text() if c in "lcr")
        rows: list[list[list[Element]]] = [[[]]]
        while (t := self.peek()) is not None:
            if t.type == "environment" and t.metadata.get("env_type") == "end" and t.metadata["env_name"] == name:
                self.at += 1
                break
            if t.type == "command" and t.value == "\\\\":
                self.at += 1
                rows.append([[]])
            elif t.type == "symbol" and t.value == "&":
                self.at += 1
                rows[-1].append([])
            elif t.type in ("subscript", "superscript"):
                cell = rows[-1][-1]
                cell.append(self.script(cell.pop() if cell else Element("mi")))
            else:
                rows[-1][-1] += self.element()
        if rows[-1] == [[]] and len(rows) > 1:
            rows.pop()
        if "matrix" in plain:
            table = Element("mtable", [Element("mtr", [Element("mtd", cell) for cell in row]) for row in rows])
            fences = vocab.FENCES.get(plain)
            return Element("mrow", [_fence(fences[0]), table, _fence(fences[1])]) if fences else table
        if plain == "cases":
            filled = [[Element("mtd", [Element("mtext", " if "), *cell] if k == 1 else cell) for k, cell in enumerate(row)] for row in rows]
            return Element("mrow", [_fence("{"), Element("mtable", [Element("mtr", row) for row in filled], {"columnalign": "left left"})])
        if plain in ("align", "aligned", "alignat", "alignedat", "eqnarray", "split"):
            return _aligned(rows, ["right", "left"])
        if plain == "array":
            return _aligned(rows, [{"l": "left", "r": "right", "c": "center"}[c] for c in columns] or ["center"])
        if plain in ("gather", "gathered"):
            return Element("mtable", [Element("mtr", [Element("mtd", sum(row, []))]) for row in rows], {"columnalign": "center"})
        if plain == "multline":
            sides = ["left", *["center"] * (len(rows) - 2), "right"] if len(rows) > 1 else ["left"]
            return Element("mtable", [Element("mtr", [Element("mtd", sum(row, []), {"columnalign": side})]) for row, side in zip(rows, sides, strict=True)])
        flat: list[Element] = []
        for i, row in enumerate(rows):
            flat += ([Element("mspace", "", {"linebreak": "newline"})] if i else []) + sum(row, [])
        return Element("mrow", flat)


def _aligned(rows: list[list[list[Element]]], sides: list[str]) -> Element:
    body = [Element("mtr", [Element("mtd", cell, {"columnalign": sides[k % len(sides)]}) for k, cell in enumerate(row)]) for row in rows]
    return Element("mtable", body, {"columnalign": " ".join(sides)})


def _math(content: str | list[Element], display: bool) -> Element:
    return Element("math", content, {"xmlns": vocab.MATHML_NAMESPACE, "display": "block" if display else "inline"})


def error_document(latex: str, display: bool = False) -> str:
    return serialise(_math([Element("merror", [Element("mtext", f"Failed to convert: {_illegal.sub('', latex[:100])}...")])], display))


def convert(latex: str, display: bool = False, optimize: bool = True, symbols: dict | None = None, limit: int | None = vocab.MATHML_INPUT_LIMIT) -> str | None:
    """MathML of ``latex``, or None beyond ``limit`` characters, if there is a limit; ``symbols`` replaces the built-in table."""
    if limit is not None and len(latex) > limit:
        return None
    try:
        clean = _illegal.sub("", latex)
        content = _Converter(tokenize(clean, macros_of(clean)), symbols).row()
        if len(content) == 1 and content[0].tag == "mrow" and not content[0].attributes:
            content = list(content[0].content)
        document = _math(content, display)
        return serialise(optimise(document)[0] if optimize else document)
    except RecursionError:
        return error_document(latex, display)


def load_symbols(path: str) -> dict:
    """A symbol table from a YAML or JSON file, the built-in one where the file can't be read."""
    import json

    try:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return yaml.safe_load(f)
            return json.load(f)
    except Exception:  # any unreadable file falls back, as does a missing library
        return vocab.SYMBOLS


def read(mathml: str) -> Element:
    """The elements of a MathML document, white space between them dropped."""
    root = ET.fromstring(mathml)

    def name(tag: str) -> tuple[str, str | None]:
        return (tag[1:].split("}", 1)[1], tag[1:].split("}", 1)[0]) if tag[0] == "{" else (tag, None)

    def one(node: ET.Element, inherited: str | None) -> Element:
        tag, space = name(node.tag)
        attributes = ({"xmlns": space} if space and space != inherited else {}) | dict(node.attrib)
        return Element(tag, [one(c, space) for c in node] if len(node) else (node.text or ""), attributes)

    return one(root, None)


def optimise_mathml(mathml: str) -> str:
    """An optimised document; what can't be read comes back as it is."""
    try:
        return serialise(optimise(read(mathml))[0])
    except (ET.ParseError, RecursionError):
        return mathml


def validate_mathml(mathml: str, semantics: str = "intended") -> list[str]:
    """Errors of a document.  Under ``reference`` the namespace is looked for among the attributes, where it never is."""
    try:
        root = read(mathml)
    except ET.ParseError as e:
        return [f"XML syntax error: {e}"]
    except RecursionError:
        return ["Validation error: nested too deeply"]
    errors = []
    if not root.tag.endswith("math"):
        errors.append("Root element must be <math>")
    if semantics == "reference" or root.attributes.get("xmlns") != vocab.MATHML_NAMESPACE:
        errors.append("Missing or incorrect MathML namespace")
    stack = [root]
    while stack:
        e = stack.pop()
        below = [] if isinstance(e.content, str) else e.content
        if e.tag not in vocab.MATHML_TAGS:
            errors.append(f"Invalid MathML element: <{e.tag}>")
        if e.tag in vocab.MATHML_TOKENS and below:
            errors.append(f"Element <{e.tag}> should not have child elements")
        expected = vocab.MATHML_ARITY.get(e.tag, len(below))
        if expected != len(below):
            errors.append(f"Element <{e.tag}> requires {expected} children, found {len(below)}")
        stack.extend(reversed(below))
    return errors


def reference_mathml(latex: Column, display: Column | bool = False) -> Column:
    """The observed result of a conversion, as a JVM expression."""
    mode = F.when(F.lit(display) if isinstance(display, bool) else display, "block").otherwise("inline")
    head = F.concat(F.lit(f'<math xmlns="{vocab.MATHML_NAMESPACE}" display="'), mode, F.lit('"'))
    shown = F.substring(latex, 1, 100)
    safe = shown
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(old), F.lit(new))
    failed = F.concat(head, F.lit(">\n  <merror>\n    <mtext>Failed to convert: "), safe, F.lit("...</mtext>\n  </merror>\n</math>\n"))
    return F.when((F.length(latex) > vocab.MATHML_INPUT_LIMIT) | shown.rlike(_ILLEGAL), None).when(strip(latex) == "", F.concat(head, F.lit("/>\n"))).otherwise(failed)


def _function(function, result: pa.DataType, sql: str):
    """An Arrow function that applies ``function`` to the values that aren't NULL, each once a task as far as memory goes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = memoised(function)
        for batch in batches:
            yield pa.array([None if x is None else known(x) for x in batch.to_pylist()], result)

    return F.arrow_udf(run, sql)


def to_mathml(formulas: DataFrame, semantics: str = "reference", latex: str = "latex", display: Column | None = None, optimize: bool = True, symbols: dict | None = None, limit: int | None = vocab.MATHML_INPUT_LIMIT) -> DataFrame:
    """``formulas`` with a column ``mathml``; ``display`` says which are set apart, by default none.

    Formulas of more than ``limit`` characters give NULL; as meant, the limit may be None.
    """
    block = F.lit(False) if display is None else F.coalesce(display, F.lit(False))
    if semantics == "reference":
        return formulas.withColumn("mathml", reference_mathml(F.col(latex), block))
    if semantics != "intended":
        raise ValueError(f"unknown semantics: {semantics}")
    done = _function(lambda x: convert(x, False, optimize, symbols, limit), pa.string(), "string")(F.col(latex))
    rows = spread(formulas.drop("mathml")).withColumn("mathml", done)
    # Only the root element tells the modes apart.
    return rows.withColumn("mathml", F.when(block, F.regexp_replace("mathml", '^(<math [^>]*display=")inline"', '$1block"')).otherwise(F.col("mathml")))


def validate(documents: DataFrame, mathml: str = "mathml", semantics: str = "intended") -> DataFrame:
    """``documents`` with is_valid and errors of their MathML; NULL where there is none."""
    errors = _function(lambda x: validate_mathml(x, semantics), pa.list_(pa.string()), "array<string>")
    rows = spread(documents.drop("is_valid", "errors")).withColumn("errors", errors(F.col(mathml)))
    return rows.withColumn("is_valid", F.when(F.col("errors").isNotNull(), F.size("errors") == 0))


def optimise_documents(documents: DataFrame, mathml: str = "mathml") -> DataFrame:
    """``documents`` with a column ``optimised``."""
    return spread(documents.drop("optimised")).withColumn("optimised", _function(optimise_mathml, pa.string(), "string")(F.col(mathml)))
