"""The LaTeX grammar: tokens, tree and findings of one formula.

This is the only stateful part of the engine, so it is plain Python called once for each
distinct formula from an Arrow batch.  Nothing here recurses: formulas may nest without bound.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from mathloom.functions import vocab


class Token(NamedTuple):
    type: str
    value: str
    position: int
    length: int
    #: subtype, env_name, env_type, content, options, macro_args, macro_body, removed - as far as they apply
    metadata: dict[str, str] = {}


@dataclass(slots=True)
class Node:
    """A node of the tree; ``base`` and ``delimiter`` lie beside the children."""

    type: str
    value: str | None = None
    position: int | None = None
    name: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    base: Node | None = None
    delimiter: Node | None = None
    nested: bool = False


class Finding(NamedTuple):
    type: str
    message: str
    position: int
    token_index: int


# The patterns of comments, macro definitions and environments, and of single tokens.
_COMMENT = re.compile(r"(?:^|(?<=\s))(?<!\\)%.*$", re.MULTILINE)
_NEWCOMMAND = re.compile(r"\\newcommand\{\\([a-zA-Z]+)\}(?:\[(\d+)\])?\{([^}]+)\}")
_DEF = re.compile(r"\\def\\([a-zA-Z]+)\{([^}]+)\}")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{(\w+\*?)\}")
_SCAN = re.compile(
    r"""(?P<command>\\(?:[a-zA-Z]+|[^a-zA-Z])?)
    |(?P<group>[{}])|(?P<bracket>\[)|(?P<subscript>_)|(?P<superscript>\^)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<operator>[+\-*/=<>])|(?P<delimiter>[()\]])
    |(?P<spacing>\s+)|(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)

_CLASSES: dict[str, tuple[str, dict[str, str]]] = {}
# Where a name stands in several lists, the first list decides.
for _words, _kind, _subtype in (
    (vocab.GREEK, "symbol", "greek"),
    (vocab.FUNCTIONS, "operator", "function"),
    (vocab.FONTS, "command", "font"),
    (vocab.ACCENTS, "command", "accent"),
    (vocab.SPACING, "spacing", "spacing"),
    (("left", "right"), "command", "delimiter_modifier"),
):
    for _word in _words:
        _CLASSES.setdefault(_word, (_kind, {"subtype": _subtype}))


def comments_of(latex: str) -> list[tuple[int, str]]:
    """Place and text of each comment."""
    return [(m.start(), m[0]) for m in _COMMENT.finditer(latex)] if "%" in latex else []


def macros_of(latex: str) -> dict[str, tuple[int, str]]:
    """Number of arguments and body of each macro that ``latex`` defines; a body ends at its first brace."""
    found: dict[str, tuple[int, str]] = {}
    if "\\newcommand" in latex:
        found |= {m[1]: (int(m[2] or 0), m[3]) for m in _NEWCOMMAND.finditer(latex)}
    if "\\def" in latex:
        found |= {m[1]: (0, m[2]) for m in _DEF.finditer(latex)}
    return found


def _bracket_end(latex: str, start: int) -> int:
    """Where the bracket opened at ``start`` is closed, or -1; a character after a backslash doesn't count."""
    depth = 0
    for m in re.compile(r"[\[\]]").finditer(latex, start):
        at = m.start()
        if at > start and latex[at - 1] == "\\":
            continue
        depth += 1 if m[0] == "[" else -1
        if depth == 0:
            return at
    return -1


def _optional(latex: str, start: int, end: int) -> Token:
    content = latex[start + 1 : end]
    metadata = {"content": content}
    if "=" in content:
        pairs = (part.split("=", 1) for part in content.split(",") if "=" in part)
        metadata["options"] = json.dumps({k.strip(): v.strip() for k, v in pairs}, ensure_ascii=False)
    return Token("optional", latex[start : end + 1], start, end + 1 - start, metadata)


def tokenize(latex: str, macros: dict[str, tuple[int, str]] | None = None) -> list[Token]:
    """Tokens from left to right; a bracket right after a command opens an optional argument."""
    macros = macros or {}
    tokens: list[Token] = []
    at, size, scan = 0, len(latex), _SCAN.match
    while at < size:
        m = scan(latex, at)
        kind, value = m.lastgroup, m[0]
        token = None
        if kind == "command":
            name = value[1:]
            if not name:
                token = Token("symbol", "\\", at, 1)
            elif known := _CLASSES.get(name):
                token = Token(known[0], value, at, len(value), known[1])
            elif name in macros:
                arguments, body = macros[name]
                token = Token("macro", value, at, len(value), {"macro_args": str(arguments), "macro_body": body})
            elif name in ("begin", "end"):
                if e := _ENVIRONMENT.match(latex, at):
                    token = Token("environment", e[0], at, len(e[0]), {"env_name": e[2], "env_type": e[1]})
                else:
                    token = Token("environment", value, at, len(value))
            else:
                token = Token("command", value, at, len(value))
        elif kind == "bracket":
            token = Token("delimiter", "[", at, 1)
            if tokens and tokens[-1].type == "command" and (end := _bracket_end(latex, at)) >= 0:
                token = _optional(latex, at, end)
        elif kind == "other":
            if value.isdigit() or value == "." and latex[at + 1 : at + 2].isdigit():
                at += 1  # neither a decimal digit nor part of a number: dropped
                continue
            token = Token("variable" if value.isalpha() else "symbol", value, at, 1)
        else:
            token = Token(kind, value, at, len(value))
        tokens.append(token)
        at += token.length
    return tokens


#: Types of tokens that are nothing but leaves, wherever they stand.
_LEAVES = frozenset(("variable", "number", "operator", "symbol", "delimiter", "macro", "optional", "comment"))


class _Builder:
    """Takes tokens one by one; ``state`` is the method that the next one goes to."""

    def __init__(self):
        self.root = Node("root")
        self.open = [self.root]
        self.state = self._sibling
        self.script: Node | None = None
        self.sizing: Token | None = None
        self.level = 0

    def tree(self, tokens: list[Token]) -> Node:
        for token in tokens:
            self.state(token)
        if self.state == self._delimiter:  # nothing follows the sizing command
            self._append(self.sizing)
        return self.root

    def _append(self, token: Token, to: Node | None = None) -> None:
        (to or self.open[-1]).children.append(Node(token.type, token.value, token.position, metadata=token.metadata))

    def _enter(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)

    def _sibling(self, token: Token) -> None:
        """A token among the children of what is open."""
        if token.type in _LEAVES:
            self._append(token)
            return
        match token:
            case Token("spacing", value) if not value.strip():
                pass
            case Token("group", "{"):
                self._enter(Node("group", position=token.position))
            case Token("group") if len(self.open) > 1:
                self.open.pop()
            case Token("environment", metadata={"env_type": "begin", "env_name": name}):
                self._enter(Node("environment", position=token.position, name=name))
            case Token("environment", metadata={"env_type": "end", "env_name": name}) if (self.open[-1].type, self.open[-1].name) == ("environment", name):
                self.open.pop()
            case Token("environment", metadata={}) if not token.metadata:
                pass
            case Token("subscript" | "superscript" as kind):
                before = self.open[-1].children
                base = before.pop() if before else Node("empty", position=token.position)
                self.script = Node(kind, position=token.position, base=base, nested=base.type in ("subscript", "superscript"))
                before.append(self.script)
                self.state = self._argument
            case Token("command", metadata={"subtype": "delimiter_modifier"}):
                self.sizing, self.state = token, self._delimiter
            case _:
                self._append(token)

    def _argument(self, token: Token) -> None:
        """What comes right after a script."""
        if token.type == "group" and token.value == "{":
            self.level, self.state = 1, self._flat
        else:
            self._append(token, self.script)
            self.state = self._sibling

    def _flat(self, token: Token) -> None:
        """A token in the group of a script, whose tokens are taken over as they are, white space included."""
        if token.type == "group":
            self.level += 1 if token.value == "{" else -1
        if self.level:
            self._append(token, self.script)
        else:
            self.state = self._sibling

    def _delimiter(self, token: Token) -> None:
        """What comes right after a sizing command."""
        other = Node("null_delimiter", ".") if token.value == "." else Node(token.type, token.value, token.position, metadata=token.metadata)
        self.open[-1].children.append(Node("delimiter_pair", self.sizing.value, self.sizing.position, delimiter=other))
        self.state = self._sibling


def build_tree(tokens: list[Token]) -> Node:
    """The tree of some tokens: groups and environments nest, scripts take the node before them as their base."""
    return _Builder().tree(tokens)


def node_rows(root: Node) -> list[tuple]:
    """The tree as rows in pre-order: id, parent, role, ord, depth, type, value, name, position, nested.

    ``depth`` counts children only; what lies under a base or a delimiter has none.
    """
    rows: list[tuple] = []
    stack: list[tuple[Node, int | None, str, int, int | None]] = [(root, None, "root", 0, 0)]
    while stack:
        node, parent, role, order, depth = stack.pop()
        own = len(rows)
        rows.append((own, parent, role, order, depth, node.type, node.value, node.name, node.position, node.nested))
        below = [(node.base, own, "base", 0, None)] if node.base is not None else []
        below += [(c, own, "child", k, None if depth is None else depth + 1) for k, c in enumerate(node.children)]
        if node.delimiter is not None:
            below.append((node.delimiter, own, "delimiter", 0, None))
        stack.extend(reversed(below))
    return rows


def depth_and_nesting(root: Node) -> tuple[int, int]:
    """Depth over children, and how many nested scripts lie among them."""
    deepest = nested = 0
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        deepest = max(deepest, depth)
        nested += node.nested
        stack.extend((c, depth + 1) for c in node.children)
    return deepest, nested


class _Family(NamedTuple):
    """Things that open and close each other, and what is said of those without a partner."""

    #: Type and message for a closer and for an opener; a closer without a type is passed over.
    stray: tuple[str, str] | None
    unclosed: tuple[str, str]


# Types, messages and, by their order, the order of findings; from "bracket" on they are warnings.
_FAMILIES = {
    "brace": _Family(("unmatched_brace", "Unmatched closing brace"), ("unmatched_brace", "Unmatched opening brace")),
    "sizing": _Family(("unmatched_delimiter", "Unmatched \\right"), ("unmatched_delimiter", "Unmatched \\left")),
    "environment": _Family(("mismatched_environment", "Mismatched environment: \\end{%s}"), ("unclosed_environment", "Unclosed environment: %s")),
    "bracket": _Family(None, ("unmatched_delimiter", "Possibly unmatched delimiter: %s")),
}
_OPTION = ("empty_option_value", "Empty value for option: %s")
_UNKNOWN = ("unknown_command", "Unknown command: \\%s")
_RANKS = [(family, side) for family in _FAMILIES for side in ("stray", "unclosed")] + ["option", "unknown"]
_WARNING = _RANKS.index(("bracket", "stray"))
#: Family, whether it opens, and what has to be equal in a pair, by type and value of a token.
_PAIRED = {
    ("group", "{"): ("brace", True, ""),
    ("group", "}"): ("brace", False, ""),
    ("command", "\\left"): ("sizing", True, ""),
    ("command", "\\right"): ("sizing", False, ""),
    **{("delimiter", c): ("bracket", True, c) for c in vocab.CLOSERS},
    **{("delimiter", d): ("bracket", False, c) for c, d in vocab.CLOSERS.items()},
}


def validate(tokens: list[Token], macros: dict[str, tuple[int, str]] | None = None) -> tuple[list[Finding], list[Finding]]:
    """Errors and warnings: braces, \\left and \\right, brackets, environments, options, unknown commands."""
    found: list[tuple[int, Finding]] = []

    def add(rank, said: tuple[str, str], name: str, position: int, index: int) -> None:
        kind, message = said
        found.append((_RANKS.index(rank), Finding(kind, message % name if "%" in message else message, position, index)))

    waiting: dict[str, list[tuple[str, int, int]]] = {family: [] for family in _FAMILIES}
    named, commands = set(), 0
    for index, token in enumerate(tokens):
        family, opens, name = _PAIRED.get((token.type, token.value), (None, False, ""))
        if token.type == "environment" and token.metadata:
            family, opens, name = "environment", token.metadata["env_type"] == "begin", token.metadata["env_name"]
        if family:
            line, stray = waiting[family], _FAMILIES[family].stray
            if opens:
                line.append((name, token.position, index))
            elif line and line[-1][0] == name:
                line.pop()
            elif stray:
                add((family, "stray"), stray, name, token.position, index)
        for option, value in json.loads(token.metadata.get("options", "{}")).items() if token.type == "optional" else ():
            if not value:
                add("option", _OPTION, option, token.position, index)
        if token.type == "command":
            command = token.value.lstrip("\\")
            if command not in vocab.KNOWN_COMMANDS and not command.startswith("text") and command not in (macros or ()) and command not in named:
                named.add(command)
                # This index counts commands only.
                add("unknown", _UNKNOWN, command, token.position, commands)
            commands += 1
    for family, line in waiting.items():
        for name, position, index in line:
            add((family, "unclosed"), _FAMILIES[family].unclosed, name, position, index)
    found.sort(key=lambda x: x[0])
    return [f for rank, f in found if rank < _WARNING], [f for rank, f in found if rank >= _WARNING]


def counts_of(tokens: list[Token], root: Node) -> dict[str, int]:
    """The counters of a formula's complexity; a token feeds one of them, a matrix environment two."""
    counts = dict.fromkeys((name for name, _ in vocab.COMPLEXITY), 0)
    counts["tokens"] = len(tokens)
    counts["depth"], counts["nested_scripts"] = depth_and_nesting(root)
    by_value = {"\\frac": "fractions", "\\sqrt": "roots"} | dict.fromkeys(vocab.INTEGRALS, "integrals") | dict.fromkeys(vocab.SUMS_PRODUCTS, "sums_products")
    by_type = {"subscript": "scripts", "superscript": "scripts", "delimiter": "delimiters", "macro": "macros", "optional": "optionals"}
    for t in tokens:
        if t.type == "environment" and t.metadata.get("env_type") == "begin":
            counts["environments"] += 1
            counts["matrices"] += "matrix" in t.metadata["env_name"]
        elif counter := by_value.get(t.value) or by_type.get(t.type):
            counts[counter] += 1
    return counts


def complexity_of(counts: dict[str, int]) -> float:
    """The weighted sum of the counters, 10 at most; added in a fixed order, so equal to the bit."""
    total = 0.0
    for name, weight in vocab.COMPLEXITY:
        total += counts[name] * weight
    return min(10.0, total)


@dataclass(slots=True)
class Parsed:
    tokens: list[Token]
    tree: Node
    errors: list[Finding]
    warnings: list[Finding]
    counts: dict[str, int]
    complexity: float
    original_length: int
    comment_count: int
    macros: dict[str, tuple[int, str]]


def parse(latex: str, remove_comments: bool = True, macros: dict[str, tuple[int, str]] | None = None) -> Parsed:
    """Everything the grammar knows about ``latex``; ``macros`` are those defined before it, if any count."""
    comments = comments_of(latex) if remove_comments else []
    text = _COMMENT.sub("", latex) if comments else latex
    known = (macros or {}) | macros_of(text)
    tokens = tokenize(text, known)
    if comments:
        # Comments keep their offsets in the original, all others have those of the text without them.
        tokens += [Token("comment", c, at, len(c), {"removed": "true"}) for at, c in comments]
        tokens.sort(key=lambda t: t.position)
    tree = build_tree(tokens)
    errors, warnings = validate(tokens, known)
    counts = counts_of(tokens, tree)
    return Parsed(tokens, tree, errors, warnings, counts, complexity_of(counts), len(latex), len(comments), known)
