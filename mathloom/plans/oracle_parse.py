"""SQL for DuckDB over the grammar of formulas: tokens, findings, counters, tree depth, components and sizes.

It states its word lists for itself.  Each formula's tokens are rows; the stacks of the grammar are states of a recursive query
that goes from token to token.
"""

from __future__ import annotations

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Words of LaTeX by what they are.
GREEK = "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega ell hbar imath jmath aleph beth gimel daleth"
FUNCTIONS = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp lim limsup liminf sup inf max min det dim ker rank span trace deg gcd lcm Pr arg mod bmod pmod hom ext tor im Re Im"
FONTS = "mathrm mathbf mathit mathsf mathtt mathcal mathscr mathbb mathfrak boldsymbol text textbf textit textrm textsf texttt emph textsc textsl textup textnormal"
ACCENTS = "hat check breve acute grave tilde bar vec dot ddot dddot overline underline widehat widetilde overrightarrow overleftarrow overbrace underbrace overarc wideparen"
SPACES = ", : ; ! quad qquad hspace vspace hfill vfill smallskip medskip bigskip thinspace medspace thickspace negthinspace negmedspace negthickspace phantom hphantom vphantom"
OTHERS = "frac sqrt left right begin end limits nolimits text mbox hbox vbox not binom choose over atop above below stackrel overset underset newcommand def let renewcommand providecommand"


def words(text: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in text.split()) + ")"


_LEXER = r"\\(?:begin|end)\{\w+\*?\}|\\[a-zA-Z]+|(?s:\\[^a-zA-Z])|[{}_^]|\p{Nd}+(?:\.\p{Nd}+)?(?:[eE][+-]?\p{Nd}+)?|[+\-*/=<>]|[()\[\]]|" + _SPACE + r"+|(?s:.)"
#: tokens (latex, k, value, position, type, subtype, side, env) of each distinct formula; k counts from 1.
TOKENS = rf"""WITH RECURSIVE lexed AS MATERIALIZED (SELECT latex, regexp_extract_all(latex, '{_LEXER}') AS t FROM (SELECT DISTINCT latex FROM formulas WHERE latex IS NOT NULL) x),
placed AS (SELECT latex, unnest(t) AS value, unnest(range(1, len(t) + 1)) AS k, unnest(list_transform(range(0, len(t)), lambda i: length(array_to_string(t[1:i], '')))) AS position FROM lexed),
kept AS (
  SELECT latex, value, position, row_number() OVER (PARTITION BY latex ORDER BY k) AS k, substring(value, 2) AS name, value[1] = '\' AND length(value) > 1 AS named
  FROM (SELECT *, lead(value) OVER (PARTITION BY latex ORDER BY k) AS next FROM placed) x
  WHERE NOT (value = '.' AND regexp_matches(coalesce(next, ''), '^\p{{Nd}}')) AND NOT regexp_matches(value, '^[²³¹⁰⁴-⁹₀-₉]$')),
tokens AS MATERIALIZED (
  SELECT latex, k, value, position, CASE
      WHEN named THEN CASE WHEN name IN {words(GREEK)} THEN 'symbol' WHEN name IN {words(FUNCTIONS)} THEN 'operator' WHEN name IN {words(FONTS)} OR name IN {words(ACCENTS)} THEN 'command'
        WHEN name IN {words(SPACES)} THEN 'spacing' WHEN regexp_matches(name, '^(begin|end)(\{{|$)') THEN 'environment' ELSE 'command' END
      WHEN value IN ('{{', '}}') THEN 'group' WHEN value = '_' THEN 'subscript' WHEN value = '^' THEN 'superscript' WHEN regexp_matches(value, '^\p{{Nd}}') THEN 'number'
      WHEN regexp_matches(value, '^\p{{L}}$') THEN 'variable' WHEN value IN ('+', '-', '*', '/', '=', '<', '>') THEN 'operator' WHEN value IN ('(', ')', '[', ']') THEN 'delimiter'
      WHEN regexp_matches(value, '^{_SPACE}+$') THEN 'spacing' ELSE 'symbol' END AS type,
    CASE WHEN named THEN CASE WHEN name IN {words(GREEK)} THEN 'greek' WHEN name IN {words(FUNCTIONS)} THEN 'function' WHEN name IN {words(FONTS)} THEN 'font'
      WHEN name IN {words(ACCENTS)} THEN 'accent' WHEN name IN {words(SPACES)} THEN 'spacing' WHEN name IN ('left', 'right') THEN 'delimiter_modifier' END END AS subtype,
    nullif(regexp_extract(value, '^\\(begin|end)\{{', 1), '') AS side, nullif(regexp_extract(value, '^\\(?:begin|end)\{{(\w+\*?)\}}$', 1), '') AS env
  FROM kept)
"""
# One state a token: what is open, what was found.  A place on the stack: its name, place and index.
_OPEN = "STRUCT(name VARCHAR, position BIGINT, k BIGINT)[]"
_top = "{s}[len({s})].name"


def _stack(s: str, opens: str, closes: str, name: str) -> str:
    return f"CASE WHEN {opens} THEN list_append({s}, {{'name': {name}, 'position': t.position, 'k': t.k}}) WHEN {closes} AND len({s}) > 0 AND {_top.format(s=s)} = {name} THEN {s}[1:len({s}) - 1] ELSE {s} END"


def _stray(s: str, closes: str, name: str) -> str:
    return f"({closes}) AND NOT (len({s}) > 0 AND {_top.format(s=s)} = {name})"


_PAIRS = (
    ("braces", "t.type = 'group' AND t.value = '{'", "t.type = 'group' AND t.value = '}'", "''"),
    ("sizes", "t.type = 'command' AND t.value = '\\left'", "t.type = 'command' AND t.value = '\\right'", "''"),
    ("brackets", "t.type = 'delimiter' AND t.value IN ('(', '[')", "t.type = 'delimiter' AND t.value IN (')', ']')", "CASE WHEN t.value IN ('(', ')') THEN '(' ELSE '[' END"),
    ("envs", "t.type = 'environment' AND coalesce(t.side = 'begin', FALSE)", "t.type = 'environment' AND coalesce(t.side = 'end', FALSE)", "t.env"),
)
#: findings (latex, level, type, message, position, token_index).
FINDINGS = TOKENS + f""", states AS (
  SELECT latex, 0::BIGINT AS k, 0::BIGINT AS position, {", ".join(f"[]::{_OPEN} AS {s}, FALSE AS stray_{s}" for s, *_ in _PAIRS)}, NULL::VARCHAR AS env FROM lexed
  UNION ALL
  SELECT t.latex, t.k, t.position, {", ".join(f"{_stack('s.' + s, o, c, n)}, {_stray('s.' + s, c, n)}" for s, o, c, n in _PAIRS)}, t.env
  FROM states s JOIN tokens t ON t.latex = s.latex AND t.k = s.k + 1),
ends AS (SELECT s.* FROM states s JOIN (SELECT latex, max(k) AS k FROM states GROUP BY latex) m ON s.latex = m.latex AND s.k = m.k),
unknown AS (
  SELECT latex, name, min(position) AS position, min(i) AS i FROM (
    SELECT latex, ltrim(value, '\\') AS name, position, row_number() OVER (PARTITION BY latex ORDER BY k) - 1 AS i FROM tokens WHERE type = 'command') x
  WHERE name NOT IN {words(" ".join((GREEK, FUNCTIONS, FONTS, ACCENTS, SPACES, OTHERS)))} AND substring(name, 1, 4) <> 'text' GROUP BY latex, name),
findings AS (
  SELECT latex, 'error' AS level, 'unmatched_brace' AS type, 'Unmatched closing brace' AS message, position, k - 1 AS token_index FROM states WHERE stray_braces
  UNION ALL SELECT latex, 'error', 'unmatched_brace', 'Unmatched opening brace', o.position, o.k - 1 FROM (SELECT latex, unnest(braces) AS o FROM ends) x
  UNION ALL SELECT latex, 'error', 'unmatched_delimiter', 'Unmatched \\right', position, k - 1 FROM states WHERE stray_sizes
  UNION ALL SELECT latex, 'error', 'unmatched_delimiter', 'Unmatched \\left', o.position, o.k - 1 FROM (SELECT latex, unnest(sizes) AS o FROM ends) x
  UNION ALL SELECT latex, 'error', 'mismatched_environment', 'Mismatched environment: \\end{{' || env || '}}', position, k - 1 FROM states WHERE stray_envs
  UNION ALL SELECT latex, 'error', 'unclosed_environment', 'Unclosed environment: ' || o.name, o.position, o.k - 1 FROM (SELECT latex, unnest(envs) AS o FROM ends) x
  UNION ALL SELECT latex, 'warning', 'unmatched_delimiter', 'Possibly unmatched delimiter: ' || o.name, o.position, o.k - 1 FROM (SELECT latex, unnest(brackets) AS o FROM ends) x
  UNION ALL SELECT latex, 'warning', 'unknown_command', 'Unknown command: \\' || name, position, i FROM unknown)
"""
# Of each open node: the greatest depth and the nested scripts of its children but the last, the same of the last child, whether that is a script.
_TOP = "s.st[len(s.st)]"
_REST = "s.st[1:len(s.st) - 1]"


def _with(last: str, nested: str, script: str, keep: bool = False) -> str:
    """The stack with another last child at its top; ``keep`` if it takes the place of the last one."""
    before = f"'d': {_TOP}.d, 'n': {_TOP}.n" if keep else f"'d': greatest({_TOP}.d, {_TOP}.last), 'n': {_TOP}.n + {_TOP}.nest"
    return f"list_append({_REST}, {{{before}, 'last': {last}, 'nest': {nested}, 'script': {script}, 'has': TRUE, 'env': {_TOP}.env}})"


_DEPTH = "len(s.st)::BIGINT"
_LEAF = _with(_DEPTH, "0::BIGINT", "FALSE")
_ENTER = f"list_append({_LEAF}, {{'d': 0::BIGINT, 'n': 0::BIGINT, 'last': 0::BIGINT, 'nest': 0::BIGINT, 'script': FALSE, 'has': FALSE, 'env': CASE WHEN t.type = 'environment' THEN t.env ELSE '' END}})"
_SCRIPT = f"CASE WHEN {_TOP}.has THEN {_with(_DEPTH, f'{_TOP}.script::BIGINT', 'TRUE', True)} ELSE {_with(_DEPTH, '0::BIGINT', 'TRUE', True)} END"
_GROWN = _with("len(s.st)::BIGINT + 1", f"{_TOP}.nest", "TRUE", True)
# The closed node was the last child of what is open below it.
_BELOW = "s.st[len(s.st) - 1]"
_LEAVE = f"list_append(s.st[1:len(s.st) - 2], {{'d': {_BELOW}.d, 'n': {_BELOW}.n, 'last': greatest({_BELOW}.last, {_TOP}.d, {_TOP}.last), 'nest': {_TOP}.n + {_TOP}.nest, 'script': FALSE, 'has': TRUE, 'env': {_BELOW}.env}})"
_SHAPE = "STRUCT(d BIGINT, n BIGINT, last BIGINT, nest BIGINT, script BOOLEAN, has BOOLEAN, env VARCHAR)[]"
#: trees (latex, depth, nested): depth over children, and how many nested scripts are among them.
TREES = FINDINGS + f""", walk AS (
  SELECT latex, 0::BIGINT AS k, 'sibling' AS mode, 0::BIGINT AS level, [{{'d': 0, 'n': 0, 'last': 0, 'nest': 0, 'script': FALSE, 'has': FALSE, 'env': ''}}]::{_SHAPE} AS st FROM lexed
  UNION ALL
  SELECT t.latex, t.k,
    CASE s.mode WHEN 'sibling' THEN CASE WHEN t.type IN ('subscript', 'superscript') THEN 'argument' WHEN t.subtype = 'delimiter_modifier' THEN 'delimiter' ELSE 'sibling' END
      WHEN 'argument' THEN CASE WHEN t.value = '{{' THEN 'flat' ELSE 'sibling' END
      WHEN 'flat' THEN CASE WHEN t.value = '}}' AND s.level = 1 THEN 'sibling' ELSE 'flat' END ELSE 'sibling' END,
    CASE WHEN s.mode = 'argument' AND t.value = '{{' THEN 1 WHEN s.mode = 'flat' AND t.value = '{{' THEN s.level + 1 WHEN s.mode = 'flat' AND t.value = '}}' THEN s.level - 1 ELSE s.level END,
    CASE s.mode
      WHEN 'argument' THEN CASE WHEN t.value = '{{' THEN s.st ELSE {_GROWN} END
      WHEN 'flat' THEN CASE WHEN t.value = '}}' AND s.level = 1 THEN s.st ELSE {_GROWN} END
      WHEN 'delimiter' THEN s.st
      ELSE CASE
        WHEN t.type = 'spacing' AND regexp_matches(t.value, '^{_SPACE}*$') THEN s.st
        WHEN t.value = '{{' THEN {_ENTER}
        WHEN t.value = '}}' THEN CASE WHEN len(s.st) > 1 THEN {_LEAVE} ELSE {_LEAF} END
        WHEN t.type = 'environment' AND t.side IS NULL THEN s.st
        WHEN t.side = 'begin' THEN {_ENTER}
        WHEN t.side = 'end' THEN CASE WHEN len(s.st) > 1 AND {_TOP}.env = t.env THEN {_LEAVE} ELSE {_LEAF} END
        WHEN t.type IN ('subscript', 'superscript') THEN {_SCRIPT}
        ELSE {_LEAF} END END
  FROM walk s JOIN tokens t ON t.latex = s.latex AND t.k = s.k + 1),
trees AS (
  SELECT w.latex, list_max(list_transform(w.st, lambda x: greatest(x.d, x.last))) AS depth, list_sum(list_transform(w.st, lambda x: x.n + x.nest)) AS nested
  FROM walk w JOIN (SELECT latex, max(k) AS k FROM walk GROUP BY latex) m ON w.latex = m.latex AND w.k = m.k)
"""
_COUNTERS = {
    "tokens": "TRUE",
    "environments": "t.side = 'begin'",
    "fractions": "t.value = '\\frac'",
    "integrals": "t.value IN ('\\int', '\\iint', '\\iiint', '\\oint')",
    "sums_products": "t.value IN ('\\sum', '\\prod')",
    "matrices": "t.side = 'begin' AND contains(t.env, 'matrix')",
    "scripts": "t.type IN ('subscript', 'superscript')",
    "roots": "t.value = '\\sqrt'",
    "delimiters": "t.type = 'delimiter'",
    "macros": "FALSE",
    "optionals": "FALSE",
}
# The sum is built in this order, so that it is equal to the bit.
_WEIGHTS = (("tokens", 0.05), ("depth", 0.4), ("environments", 0.8), ("fractions", 0.6), ("integrals", 1.0), ("sums_products", 0.8), ("matrices", 1.2), ("scripts", 0.2), ("roots", 0.4), ("delimiters", 0.1), ("nested_scripts", 0.5), ("macros", 0.3), ("optionals", 0.15))
#: counted (latex, counters, depth, nested_scripts, complexity_score), for each distinct formula.
COUNTED = TREES + f""", counters AS (SELECT l.latex, r.depth, r.nested AS nested_scripts, {", ".join(f"count(t.k) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTERS.items())}
  FROM lexed l JOIN trees r ON l.latex = r.latex LEFT JOIN tokens t ON l.latex = t.latex GROUP BY l.latex, r.depth, r.nested),
counted AS (SELECT *, least(10.0::DOUBLE, {" + ".join(f"{n} * {w}::DOUBLE" for n, w in _WEIGHTS)}) AS complexity_score FROM counters)
"""
_PARTS = {
    "commands": "type = 'command'",
    "greek_letters": "type = 'symbol' AND subtype = 'greek'",
    "operators": "type = 'operator'",
    "variables": "type = 'variable'",
    "numbers": "type = 'number'",
    "environments": "side = 'begin'",
    "fractions": "type = 'command' AND value = '\\frac'",
    "matrices": "side = 'begin' AND contains(env, 'matrix')",
    "integrals": "type = 'command' AND value IN ('\\int', '\\iint', '\\iiint', '\\oint')",
    "sums_products": "type = 'command' AND value IN ('\\sum', '\\prod')",
    "delimiters": "type = 'delimiter'",
    "accents": "type = 'command' AND subtype = 'accent'",
    "macros": "FALSE",
    "optional_args": "FALSE",
}
#: parts (latex, part, shown, k), each once, k its first place.
_FIRST = " UNION ALL ".join(f"SELECT latex, '{p}' AS part, CASE WHEN side = 'begin' THEN env ELSE value END AS shown, min(k) AS k FROM tokens WHERE {c} GROUP BY 1, 2, 3" for p, c in _PARTS.items())
_SIZES = COUNTED + f""", parts AS ({_FIRST}),
sized AS (SELECT c.latex, c.depth, (SELECT count(*) FROM tokens t WHERE t.latex = c.latex AND t.type <> 'spacing') AS shown,
    (SELECT count(*) FROM parts p WHERE p.latex = c.latex AND part = 'fractions') AS fr, (SELECT count(*) FROM parts p WHERE p.latex = c.latex AND part = 'matrices') AS ma,
    (SELECT count(*) FROM parts p WHERE p.latex = c.latex AND part IN ('integrals', 'sums_products')) AS big, c.scripts,
    (SELECT count(*) FROM tokens t WHERE t.latex = c.latex AND t.subtype = 'delimiter_modifier') AS sizing,
    (SELECT count(*) FROM parts p WHERE p.latex = c.latex AND part = 'accents' AND shown IN ('\\widehat', '\\widetilde', '\\overrightarrow', '\\overleftarrow')) AS wide FROM counted c),
sizes AS (SELECT latex,
    round_even(shown * 7.2::DOUBLE * 0.5 * CASE WHEN fr > 0 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN ma > 0 THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN big > 0 THEN 1.2::DOUBLE ELSE 1 END, 0)::BIGINT AS width,
    round_even(14.4::DOUBLE * CASE WHEN fr > 0 THEN 2 + fr * 0.2::DOUBLE ELSE 1 END * CASE WHEN ma > 0 THEN 2.5 + ma * 0.5::DOUBLE ELSE 1 END * CASE WHEN big > 0 THEN 1.8::DOUBLE ELSE 1 END * pow(1.1::DOUBLE, sizing)
      * CASE WHEN scripts > 0 THEN 1 + least(scripts * 0.2::DOUBLE, 0.6::DOUBLE) ELSE 1 END * (1 + depth * 0.1::DOUBLE) * pow(1.2::DOUBLE, wide), 0)::BIGINT AS height FROM sized)
"""
_OF_FORMULAS = "FROM formulas f JOIN {table} x ON f.latex = x.latex"

SQL = {
    "parse_tokens": TOKENS + """SELECT latex, type, value, position::INT AS position, length(value)::INT AS length,
      CASE WHEN subtype IS NOT NULL THEN '{"subtype":"' || subtype || '"}' WHEN side IS NOT NULL THEN '{"env_name":"' || env || '","env_type":"' || side || '"}' ELSE '{}' END AS metadata FROM tokens""",
    "parse_findings": FINDINGS + "SELECT f.formula_id, x.level, x.type, x.message, x.position::INT AS position, x.token_index::INT AS token_index " + _OF_FORMULAS.format(table="findings"),
    "parse_structure": COUNTED + """SELECT f.formula_id, NOT EXISTS (SELECT 1 FROM findings e WHERE e.latex = f.latex AND e.level = 'error') AS is_valid, x.complexity_score, x.tokens::INT AS token_count,
      x.depth::INT AS tree_depth, length(f.latex)::INT AS original_length, 0 AS comment_count, FALSE AS has_macros """ + _OF_FORMULAS.format(table="counted"),
    "complexity_counts": COUNTED + f"SELECT f.formula_id, {', '.join(f'x.{n}::INT AS {n}' for n, _ in _WEIGHTS)}, x.complexity_score " + _OF_FORMULAS.format(table="counted"),
    "simple_formulas": COUNTED + "SELECT f.formula_id, NOT (x.depth > 3 OR x.fractions > 0 OR x.roots > 0 OR x.complexity_score > 2.0 OR EXISTS (SELECT 1 FROM tokens t WHERE t.latex = f.latex AND t.type = 'environment')) AS is_simple " + _OF_FORMULAS.format(table="counted"),
    "render_sizes": _SIZES + "SELECT f.formula_id, x.width, x.height " + _OF_FORMULAS.format(table="sizes"),
    "components": TOKENS + f", parts AS ({_FIRST}), shown AS (SELECT latex, " + ", ".join(f"coalesce(string_agg(shown, ' ' ORDER BY k) FILTER (WHERE part = '{p}'), '') AS {p}" for p in _PARTS)
    + " FROM parts GROUP BY latex) SELECT f.formula_id, " + ", ".join(f"coalesce(x.{p}, '') AS {p}" for p in _PARTS) + " FROM formulas f LEFT JOIN shown x ON f.latex = x.latex WHERE f.latex IS NOT NULL",
}

# The tree in pre-order: each node with its level; a script goes in before its base, which with all below it goes down a level.
_NODE = "STRUCT(lvl BIGINT, role VARCHAR, type VARCHAR, value VARCHAR, name VARCHAR, position BIGINT, nested BOOLEAN)"
_LAST = "s.st[len(s.st)]"
_ROOF = "s.st[1:len(s.st) - 1]"


def _node(level: str, role: str, kind: str, value: str = "NULL", name: str = "NULL", position: str = "t.position", nested: str = "FALSE") -> str:
    return f"{{'lvl': {level}, 'role': '{role}', 'type': {kind}, 'value': {value}, 'name': {name}, 'position': {position}, 'nested': {nested}}}"


def _added(*nodes: str) -> str:
    return f"list_concat(s.nodes, [{', '.join(nodes)}]::{_NODE}[])"


_CHILD = _added(_node("len(s.st)", "child", "t.type", "t.value"))
_BELOW_SCRIPT = _added(_node("len(s.st) + 1", "child", "t.type", "t.value"))
_OPENED = _added(_node("len(s.st)", "child", "t.type", name="CASE WHEN t.type = 'environment' THEN t.env END"))
_WRAPPED = f"""CASE WHEN {_LAST}.has THEN list_concat(list_concat(s.nodes[1:{_LAST}.first - 1], [{_node("len(s.st)", "child", "t.type", nested=f"{_LAST}.script")}]::{_NODE}[]),
  list_transform(s.nodes[{_LAST}.first:], lambda x, i: {{'lvl': x.lvl + 1, 'role': CASE WHEN i = 1 THEN 'base' ELSE x.role END, 'type': x.type, 'value': x.value, 'name': x.name, 'position': x.position, 'nested': x.nested}}))
  ELSE {_added(_node("len(s.st)", "child", "t.type"), _node("len(s.st) + 1", "base", "'empty'"))} END"""
_PAIRED = f"""list_concat(list_concat(s.nodes[1:len(s.nodes) - 1], [{{'lvl': s.nodes[len(s.nodes)].lvl, 'role': 'child', 'type': 'delimiter_pair', 'value': s.nodes[len(s.nodes)].value, 'name': NULL, 'position': s.nodes[len(s.nodes)].position, 'nested': FALSE}}]::{_NODE}[]),
  [{_node("len(s.st) + 1", "delimiter", "CASE WHEN t.value = '.' THEN 'null_delimiter' ELSE t.type END", "t.value", position="CASE WHEN t.value <> '.' THEN t.position END")}]::{_NODE}[])"""


def _place(at: str, script: str) -> str:
    return f"list_append({_ROOF}, {{'first': {at}, 'has': TRUE, 'script': {script}, 'env': {_LAST}.env}})"


_NEXT = "len(s.nodes)::BIGINT + 1"
_PLACED = _place(_NEXT, "FALSE")
_PUSHED = f"list_append({_PLACED}, {{'first': 0::BIGINT, 'has': FALSE, 'script': FALSE, 'env': CASE WHEN t.type = 'environment' THEN t.env ELSE '' END}})"
_UNDER = "s.st[len(s.st) - 1]"
_POPPED = f"list_append(s.st[1:len(s.st) - 2], {{'first': {_UNDER}.first, 'has': TRUE, 'script': FALSE, 'env': {_UNDER}.env}})"


def _step(leaf: str, enter: str, leave: str, script: str, grown: str, pair: str, same: str) -> str:
    """What a token does, by the mode: five things among siblings, then what goes below a script or after a sizing command."""
    return f"""CASE s.mode
      WHEN 'argument' THEN CASE WHEN t.value = '{{' THEN {same} ELSE {grown} END
      WHEN 'flat' THEN CASE WHEN t.value = '}}' AND s.level = 1 THEN {same} ELSE {grown} END
      WHEN 'delimiter' THEN {pair}
      ELSE CASE
        WHEN t.type = 'spacing' AND regexp_matches(t.value, '^{_SPACE}*$') THEN {same}
        WHEN t.value = '{{' THEN {enter}
        WHEN t.value = '}}' THEN CASE WHEN len(s.st) > 1 THEN {leave} ELSE {leaf} END
        WHEN t.type = 'environment' AND t.side IS NULL THEN {same}
        WHEN t.side = 'begin' THEN {enter}
        WHEN t.side = 'end' THEN CASE WHEN len(s.st) > 1 AND {_LAST}.env = t.env THEN {leave} ELSE {leaf} END
        WHEN t.type IN ('subscript', 'superscript') THEN {script}
        ELSE {leaf} END END"""


SQL["parse_nodes"] = TOKENS + f""", built AS (
  SELECT latex, 0::BIGINT AS k, 'sibling' AS mode, 0::BIGINT AS level, [{{'first': 0, 'has': FALSE, 'script': FALSE, 'env': ''}}]::STRUCT(first BIGINT, has BOOLEAN, script BOOLEAN, env VARCHAR)[] AS st,
    [{{'lvl': 0, 'role': 'root', 'type': 'root', 'value': NULL, 'name': NULL, 'position': NULL, 'nested': FALSE}}]::{_NODE}[] AS nodes FROM lexed
  UNION ALL
  SELECT t.latex, t.k,
    CASE s.mode WHEN 'sibling' THEN CASE WHEN t.type IN ('subscript', 'superscript') THEN 'argument' WHEN t.subtype = 'delimiter_modifier' THEN 'delimiter' ELSE 'sibling' END
      WHEN 'argument' THEN CASE WHEN t.value = '{{' THEN 'flat' ELSE 'sibling' END
      WHEN 'flat' THEN CASE WHEN t.value = '}}' AND s.level = 1 THEN 'sibling' ELSE 'flat' END ELSE 'sibling' END,
    CASE WHEN s.mode = 'argument' AND t.value = '{{' THEN 1 WHEN s.mode = 'flat' AND t.value = '{{' THEN s.level + 1 WHEN s.mode = 'flat' AND t.value = '}}' THEN s.level - 1 ELSE s.level END,
    {_step(_PLACED, _PUSHED, _POPPED, _place(f"CASE WHEN {_LAST}.has THEN {_LAST}.first ELSE {_NEXT} END", "TRUE"), "s.st", "s.st", "s.st")},
    {_step(_CHILD, _OPENED, "s.nodes", _WRAPPED, _BELOW_SCRIPT, _PAIRED, "s.nodes")}
  FROM built s JOIN tokens t ON t.latex = s.latex AND t.k = s.k + 1),
whole AS (SELECT b.latex, b.nodes FROM built b JOIN (SELECT latex, max(k) AS k FROM built GROUP BY latex) m ON b.latex = m.latex AND b.k = m.k),
listed AS MATERIALIZED (SELECT latex, unnest(range(0, len(nodes))) AS id, unnest(nodes) AS n FROM whole),
linked AS MATERIALIZED (SELECT a.latex, a.id, a.n, (SELECT max(b.id) FROM listed b WHERE b.latex = a.latex AND b.id < a.id AND b.n.lvl = a.n.lvl - 1) AS parent FROM listed a),
deep AS (
  SELECT latex, id, 0::BIGINT AS depth FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT c.latex, c.id, CASE WHEN c.n.role = 'child' THEN d.depth + 1 END FROM deep d JOIN linked c ON c.latex = d.latex AND c.parent = d.id)
SELECT l.latex, l.id::INT AS id, l.parent::INT AS parent, l.n.role AS role, CASE WHEN l.n.role = 'child' THEN row_number() OVER (PARTITION BY l.latex, l.parent, l.n.role ORDER BY l.id) - 1 ELSE 0 END::INT AS ord,
  d.depth::INT AS depth, l.n.type AS type, l.n.value AS value, l.n.name AS name, l.n.position::INT AS position, l.n.nested AS nested
FROM linked l JOIN deep d ON l.latex = d.latex AND l.id = d.id"""
