"""SQL for DuckDB that must give the rows of the named queries; written for itself, not from the plans."""

from __future__ import annotations

from mathloom.plans import cases
from mathloom.plans import oracle_parse as P

# What detection looks for, and the marks of a likely formula.
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
MARKS = ("+", "-", "=", "<", ">", "\\", "{", "}", "^", "_", "frac", "sqrt", "sum", "int", "prod", "alpha", "beta")
RECOGNISED = (
    ("sqrt", r"\sqrt"), ("sum", r"\sum"), ("int", r"\int"), ("alpha", r"\alpha"), ("beta", r"\beta"), ("gamma", r"\gamma"), ("pi", r"\pi"),
    ("+-", r"\pm"), (">=", r"\geq"), ("<=", r"\leq"), ("!=", r"\neq"), ("infinity", r"\infty"),
)
# White space as Unicode knows it, in the syntax of RE2.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _marks(x: str) -> str:
    return " + ".join(f"contains({x}, {_quoted(m)})::INT" for m in MARKS)


def _confidence(x: str) -> str:
    base = f"(0.5::DOUBLE + least(0.4::DOUBLE, ({_marks(x)}) * 0.05::DOUBLE))"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN length({x}) BETWEEN 2 AND 1000 THEN {base} + 0.1::DOUBLE ELSE {base} END))"


def _matches(n: int, table: str = "documents") -> str:
    kind, pattern = PATTERNS[n]
    p = _quoted(pattern)
    # Where a match begins: the pieces of text up to it and the matches before it.
    return f"""
    SELECT doc_id, '{kind}' AS math_type, g[k] AS raw, f[k] AS whole,
           length(array_to_string(list_slice(s, 1, k), '')) + length(array_to_string(list_slice(f, 1, k - 1), '')) AS start
    FROM (SELECT doc_id, f, g, s, unnest(range(1, len(f) + 1)) AS k
          FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS f, regexp_extract_all(text, {p}, 1) AS g, string_split_regex(text, {p}) AS s
                FROM {table} WHERE text IS NOT NULL) a
          WHERE len(f) > 0) b"""


def _detected(table: str = "documents", before: str = "") -> str:
    found = " UNION ALL ".join(_matches(n, table) for n in range(len(PATTERNS)))
    return f"""WITH {before} found AS ({found}),
detected AS (
  SELECT doc_id, start::INT AS start, (start + length(whole))::INT AS "end", math_type, {_strip("raw")} AS latex, raw, {_confidence("raw")} AS confidence FROM found)
"""


DETECTED = _detected()
# Formulas of every kind, put after the documents' texts; # stands for the document's number.
TEMPLATES = (
    "$x_{#} + y^{2} = z$",
    "$$E = mc^2 + #$$",
    r"\[ \frac{a_#}{b} \]",
    r"\( \sqrt{x^2 + y^2} \)",
    r"\begin{pmatrix} a & b \\ c & # \end{pmatrix}",
    r"\begin{align} x &= # \\ y &= 2 \end{align}",
    r"\begin{equation} \int_0^{\infty} e^{-x^2} \, dx = \frac{\sqrt{\pi}}{#} \end{equation}",
    r"\begin{equation*} \sum_{i=1}^n i = \prod\limits_{j=1}^m \left( j \right) \end{equation*}",
    r"\begin{align*} \alpha + \beta &= \gamma \quad # \end{align*}",
    r"$\text{Hello } x + y$",
    "$x^{y^z} < #$",
    r"Price: \$100 and $\hat{x}$",
)
_AUGMENTED = "augmented AS (SELECT doc_id, text || chr(10) || CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN replace({_quoted(t)}, '#', doc_id::VARCHAR)" for i, t in enumerate(TEMPLATES)) + " END AS text FROM documents),"
_BAND = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END"
_SYMBOLS = " OR ".join(f"contains(latex, {_quoted(s)})" for s in ("+", "-", "=", "\\", "^", "_"))
_QUALITY = f"""count(*) AS total, count(*) FILTER (WHERE {_BAND} = 'high') AS high, count(*) FILTER (WHERE {_BAND} = 'medium') AS medium,
  count(*) FILTER (WHERE {_BAND} = 'low') AS low, count(*) FILTER (WHERE {_SYMBOLS}) AS has_math_symbols,
  count(*) FILTER (WHERE length(latex) BETWEEN 2 AND 1000) AS proper_length, 0::BIGINT AS balanced_delimiters"""


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_quoted(pattern.replace(chr(92) + 's', _SPACE))}, {_quoted(to)}, 'g')"


def _normal(x: str, aggressive: bool, preserve: bool = False) -> str:
    """The normal form; RE2 has no look-around, so a thin space is replaced with what follows it, some times over."""
    out = _sub(_strip(x), r"\s+", " ")
    for name in ("limits", "nolimits", *(("left", "right") if aggressive else ())):
        out = _sub(out, rf"\\{name}\s*", "")
    if aggressive:
        out = _sub(_sub(out, r"\\[,;:!]\s*", " "), r"\\(?:quad|qquad)\s*", " ")
    elif not preserve:
        for _ in range(6):
            out = _sub(out, r"\\,([^a-zA-Z]|$)", r" \1")
        out = _sub(out, r"\\,\s*(d[a-z])", r"\\,\1")
    out = _sub(_sub(out, r"\s*([_^])\s*", r"\1"), r"\s*([+\-*/=<>])\s*", r" \1 ")
    return _strip(_sub(out, r"\s+", " "))


_LEXER = r"\\(?:begin|end)\{\w+\*?\}|\\[a-zA-Z]+|(?s:\\[^a-zA-Z])|[{}_^]|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\p{L}|[+\-*/=<>]|[()\[\]]|\s+|(?s:.)"


_KIND = f"""CASE
  WHEN length(token) > 1 AND token[1] = '\\' THEN CASE
    WHEN substring(token, 2) IN {P.words(P.GREEK)} THEN 'symbol'
    WHEN substring(token, 2) IN {P.words(P.FUNCTIONS)} THEN 'operator'
    WHEN substring(token, 2) IN {P.words(P.SPACES)} THEN 'spacing'
    WHEN regexp_matches(substring(token, 2), '^(begin|end)(\\{{|$)') THEN 'environment' ELSE 'command' END
  WHEN token IN ('{{', '}}') THEN 'group' WHEN token = '_' THEN 'subscript' WHEN token = '^' THEN 'superscript'
  WHEN regexp_matches(token, '^\\d') THEN 'number' WHEN regexp_matches(token, '^\\p{{L}}$') THEN 'variable'
  WHEN token IN ('+', '-', '*', '/', '=', '<', '>') THEN 'operator' WHEN token IN ('(', ')', '[', ']') THEN 'delimiter'
  WHEN regexp_matches(token, '^\\s+$') THEN 'spacing' ELSE 'symbol' END"""
_TOKENS = f"""WITH lexed AS (SELECT formula_id, regexp_extract_all(latex, {_quoted(_LEXER)}) AS tokens FROM formulas WHERE latex IS NOT NULL),
tokens AS (SELECT formula_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS ordinal FROM lexed)
"""


def _mathml(x: str, display: str) -> str:
    head = f"'<math xmlns=\"http://www.w3.org/1998/Math/MathML\" display=\"' || CASE WHEN {display} THEN 'block' ELSE 'inline' END || '\"'"
    safe = f"replace(replace(replace(substring({x}, 1, 100), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""CASE WHEN length({x}) > 10000 OR regexp_matches(substring({x}, 1, 100), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN NULL
      WHEN {_strip(x)} = '' THEN {head} || '/>' || chr(10)
      ELSE {head} || '>' || chr(10) || '  <merror>' || chr(10) || '    <mtext>Failed to convert: ' || {safe} || '...</mtext>' || chr(10) || '  </merror>' || chr(10) || '</math>' || chr(10) END"""


_SHOWN = "CASE WHEN math_type = 'inline' THEN '$' || latex || '$' ELSE '$$' || latex || '$$' END"
_NUMBERED = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM detected),
first_seen AS (SELECT doc_id, math_type, count(*) AS n, min(start) AS first FROM detected GROUP BY doc_id, math_type)
"""

SQL = {
    "detect_all": DETECTED + 'SELECT doc_id, start, "end", math_type, latex, raw, confidence FROM detected',
    **{f"detect_{kind}": DETECTED + f'SELECT doc_id, start, "end", latex, confidence FROM detected WHERE math_type = \'{kind}\'' for kind in ("display", "inline", "equation", "align", "matrix")},
    "detect_augmented": _detected("augmented", _AUGMENTED) + 'SELECT doc_id, start, "end", math_type, latex, confidence FROM detected',
    "confidence_bands": DETECTED + f"SELECT {_BAND} AS band, count(*) AS n FROM detected GROUP BY 1",
    "confident_formulas": DETECTED + "SELECT doc_id, start, math_type, confidence FROM detected WHERE confidence >= 0.8",
    "type_counts": DETECTED + "SELECT math_type, count(*) AS n FROM detected GROUP BY math_type",
    "doc_type_counts": DETECTED + "SELECT doc_id, math_type, count(*) AS n FROM detected GROUP BY doc_id, math_type",
    "quality_metrics": DETECTED + f"SELECT {_QUALITY} FROM detected",
    "extraction_quality": DETECTED + f"SELECT doc_id, {_QUALITY} FROM detected GROUP BY doc_id",
    "extraction_validation": DETECTED + f""", types AS (SELECT doc_id, string_agg(math_type || ':' || n, ',' ORDER BY math_type) AS by_type FROM (SELECT doc_id, math_type, count(*) AS n FROM detected GROUP BY doc_id, math_type) x GROUP BY doc_id),
      q AS (SELECT doc_id, {_QUALITY} FROM detected GROUP BY doc_id)
      SELECT q.doc_id, total, high, medium, low, has_math_symbols, proper_length, balanced_delimiters, by_type, 0 AS potential_errors FROM q JOIN types t ON q.doc_id = t.doc_id""",
    "environment_counts": r"""SELECT doc_id, environment, count(*) AS n FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '\\begin\{(\w+\*?)\}', 1)) AS environment FROM documents WHERE text IS NOT NULL) x GROUP BY doc_id, environment""",
    "content_statistics": """WITH ids AS (
        SELECT doc_id FROM formulas UNION SELECT doc_id FROM chemicals UNION SELECT doc_id FROM code_blocks UNION SELECT doc_id FROM diagrams),
      f AS (SELECT doc_id, count(*) AS n, count(DISTINCT math_type) AS kinds FROM formulas GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM chemicals GROUP BY doc_id),
      b AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT CASE WHEN language <> '' THEN language END, ',' ORDER BY CASE WHEN language <> '' THEN language END) AS languages FROM code_blocks GROUP BY doc_id),
      d AS (SELECT doc_id, count(*) AS n, count(DISTINCT diagram_type) AS kinds FROM diagrams GROUP BY doc_id)
      SELECT ids.doc_id, coalesce(f.n, 0) AS total_formulas, coalesce(c.n, 0) AS total_chemical_formulas, coalesce(b.n, 0) AS total_code_blocks, coalesce(d.n, 0) AS total_diagrams,
        coalesce(f.kinds, 0) AS formula_kinds, coalesce(d.kinds, 0) AS diagram_kinds, coalesce(b.languages, '') AS languages
      FROM ids LEFT JOIN f ON ids.doc_id = f.doc_id LEFT JOIN c ON ids.doc_id = c.doc_id LEFT JOIN b ON ids.doc_id = b.doc_id LEFT JOIN d ON ids.doc_id = d.doc_id
      WHERE ids.doc_id IS NOT NULL""",
    "normalize_aggressive": f"SELECT formula_id, {_normal('latex', True)} AS normal FROM formulas WHERE latex IS NOT NULL",
    "normalize_default": f"SELECT formula_id, {_normal('latex', False)} AS normal FROM formulas WHERE latex IS NOT NULL",
    "normalize_preserve": f"SELECT formula_id, {_normal('latex', False, True)} AS normal FROM formulas WHERE latex IS NOT NULL",
    "formula_hash": f"SELECT formula_id, substring(md5({_normal('latex', True)}), 1, 16) AS hash FROM formulas WHERE latex IS NOT NULL",
    "dedup_formulas": f"SELECT hash, min(formula_id) AS first_id, count(*) AS copies FROM (SELECT formula_id, substring(md5({_normal('latex', True)}), 1, 16) AS hash FROM formulas WHERE latex IS NOT NULL) x GROUP BY hash",
    "lexical_tokens": _TOKENS + f"SELECT formula_id, ordinal::INT AS ordinal, token, {_KIND} AS kind FROM tokens",
    "token_type_counts": _TOKENS + f"SELECT {_KIND} AS kind, count(*) AS n FROM tokens GROUP BY 1",
    "greek_usage": _TOKENS + f"SELECT substring(token, 2) AS letter, count(*) AS n, count(DISTINCT formula_id) AS formulas FROM tokens WHERE token[1] = '\\' AND substring(token, 2) IN {P.words(P.GREEK)} GROUP BY 1",
    "unknown_commands": _TOKENS + f"""SELECT substring(token, 2) AS command, count(DISTINCT formula_id) AS formulas FROM tokens
      WHERE regexp_matches(token, '^\\\\[a-zA-Z]+$') AND substring(token, 2) NOT IN {P.words(" ".join((P.GREEK, P.FUNCTIONS, P.FONTS, P.ACCENTS, P.SPACES, P.OTHERS)))} AND substring(token, 2, 4) <> 'text' GROUP BY 1""",
    "brace_balance": r"""WITH braces AS (SELECT formula_id, regexp_extract_all(regexp_replace(latex, '(?s)\\.', '', 'g'), '[{}]') AS b FROM formulas WHERE latex IS NOT NULL),
      steps AS (SELECT formula_id, unnest(b) AS brace, unnest(range(1, len(b) + 1)) AS k FROM braces),
      sums AS (SELECT formula_id, sum(CASE WHEN brace = '{' THEN 1 ELSE -1 END) OVER (PARTITION BY formula_id ORDER BY k) AS level FROM steps),
      lows AS (SELECT formula_id, greatest(0, -min(level)) AS stray FROM sums GROUP BY formula_id),
      ends AS (SELECT formula_id, sum(CASE WHEN brace = '{' THEN 1 ELSE -1 END) AS final FROM steps GROUP BY formula_id)
      SELECT b.formula_id, (coalesce(l.stray, 0) + coalesce(e.final + l.stray, 0))::INT AS errors
      FROM braces b LEFT JOIN lows l ON b.formula_id = l.formula_id LEFT JOIN ends e ON b.formula_id = e.formula_id""",
    "macro_definitions": r"""SELECT code_id, regexp_extract(m, '\{\\([a-zA-Z]+)\}', 1) AS macro, coalesce(TRY_CAST(regexp_extract(m, '\}\[(\d+)\]\{', 1) AS INT), 0) AS args, regexp_extract(m, '(?s)\{([^}]+)\}$', 1) AS body
      FROM (SELECT code_id, unnest(regexp_extract_all(code, '\\newcommand\{\\[a-zA-Z]+\}(?:\[\d+\])?\{[^}]+\}')) AS m FROM code_blocks WHERE code IS NOT NULL) x""",
    "mathml_reference": f"SELECT formula_id, {_mathml('latex', 'coalesce(math_type = ' + _quoted('display') + ', FALSE)')} AS mathml FROM formulas",
    "export_latex": DETECTED + _NUMBERED + f""", body AS (
        SELECT doc_id, string_agg('\\subsection{{Formula ' || i || '}}' || chr(10) || 'Type: ' || math_type || chr(10) || chr(10) || {_SHOWN} || chr(10) || chr(10), '' ORDER BY i) AS body FROM numbered GROUP BY doc_id)
      SELECT d.doc_id, '\\documentclass{{article}}' || chr(10) || '\\usepackage{{amsmath}}' || chr(10) || '\\usepackage{{amssymb}}' || chr(10) || '\\begin{{document}}' || chr(10) || chr(10)
      || '\\section{{Extracted Mathematical Content}}' || chr(10) || chr(10) || coalesce(b.body, '') || '\\end{{document}}' AS document
      FROM documents d LEFT JOIN body b ON d.doc_id = b.doc_id""",
    "export_markdown": DETECTED + _NUMBERED + f""", types AS (SELECT doc_id, '{{' || string_agg('''' || math_type || ''': ' || n, ', ' ORDER BY first, math_type) || '}}' AS types FROM first_seen GROUP BY doc_id),
      body AS (SELECT doc_id, count(*) AS total, string_agg('### Formula ' || i || chr(10) || '- Type: ' || math_type || chr(10) || '- Confidence: ' || printf('%.2f', confidence) || chr(10) || chr(10) || {_SHOWN} || chr(10) || chr(10), '' ORDER BY i) AS body FROM numbered GROUP BY doc_id)
      SELECT d.doc_id, '# Extracted STEM Content' || chr(10) || chr(10) || 'Source: ' || coalesce(d.source, 'Unknown') || chr(10) || 'Processing time: n/a' || chr(10) || chr(10) || '## Mathematical Formulas' || chr(10) || chr(10)
        || coalesce(b.body, '') || '## Statistics' || chr(10) || chr(10) || '- Total formulas: ' || coalesce(b.total, 0) || chr(10) || '- Formula types: ' || coalesce(t.types, '{{}}') || chr(10) AS document
      FROM documents d LEFT JOIN body b ON d.doc_id = b.doc_id LEFT JOIN types t ON d.doc_id = t.doc_id""",
    "stats_report": DETECTED + _NUMBERED + f""", q AS (SELECT doc_id, {_QUALITY} FROM detected GROUP BY doc_id),
      t AS (SELECT doc_id, string_agg('  - ' || math_type || ': ' || n, chr(10) ORDER BY first, math_type) AS types FROM first_seen GROUP BY doc_id)
      SELECT q.doc_id, 'Total formulas detected: ' || total || chr(10) || chr(10) || 'By type:' || chr(10) || types || chr(10) || chr(10) || 'Confidence levels:' || chr(10) || '  - High (≥0.8): ' || high
        || chr(10) || '  - Medium (0.5-0.8): ' || medium || chr(10) || '  - Low (<0.5): ' || low AS report FROM q JOIN t ON q.doc_id = t.doc_id""",
    "ocr_text_to_latex": None,
    # The stored documents are all well-formed conversions.
    "mathml_validate": "SELECT formula_id, CASE WHEN mathml IS NOT NULL THEN TRUE END AS is_valid, CASE WHEN mathml IS NOT NULL THEN '' END AS errors FROM formulas",
    "ocr_confidence": "SELECT doc_id, coalesce(avg(CASE WHEN page_number > 0 THEN page_number END), 0.0) / 100.0 AS confidence FROM formulas WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "render_cache_keys": "SELECT formula_id, md5(latex || '_300_png_12') AS general_key, md5(latex || '|300|12|Computer Modern|black|white|10') AS compile_key FROM formulas WHERE latex IS NOT NULL",
    "region_boxes": """SELECT formula_id, greatest(0, position.x - 5) AS x, greatest(0, position.y - 5) AS y, least(2000 - greatest(0, position.x - 5), position.width + 10) AS width,
      least(1000000 - greatest(0, position.y - 5), position.height + 10) AS height FROM formulas
      WHERE position IS NOT NULL AND position.width >= 20 AND position.height >= 10 AND position.width <= 2000 * 0.9::DOUBLE AND position.height <= 1000000 * 0.9::DOUBLE""",
    "image_sizes": """SELECT diagram_id, CASE WHEN w < 100 OR h < 100 THEN floor(w * (100.0::DOUBLE / least(w, h)))::INT WHEN w > 4096 OR h > 4096 THEN floor(w * (4096.0::DOUBLE / greatest(w, h)))::INT ELSE w END AS width,
        CASE WHEN w < 100 OR h < 100 THEN floor(h * (100.0::DOUBLE / least(w, h)))::INT WHEN w > 4096 OR h > 4096 THEN floor(h * (4096.0::DOUBLE / greatest(w, h)))::INT ELSE h END AS height
      FROM (SELECT diagram_id, TRY_CAST(regexp_extract(content, 'width="(\\d+)"', 1) AS INT) AS w, TRY_CAST(regexp_extract(content, 'height="(\\d+)"', 1) AS INT) AS h FROM diagrams) x WHERE w IS NOT NULL AND h IS NOT NULL AND w > 0 AND h > 0""".replace("\\\\", "\\"),
    "diagram_routes": """SELECT diagram_id, CASE WHEN kind IN ('function', 'scatter', 'vector_field') THEN 'plot' END AS route,
        CASE WHEN kind IN ('function', 'scatter', 'vector_field') THEN NULL ELSE 'Unknown diagram type: ' || coalesce(kind, 'None') END AS error
      FROM (SELECT diagram_id, regexp_replace(lower(diagram_type), '_plot$', '') AS kind FROM diagrams) x""",
    "formulas_by_language": DETECTED + "SELECT d.lang, f.math_type, count(*) AS n, avg(f.confidence) AS mean_confidence FROM detected f JOIN documents d ON f.doc_id = d.doc_id GROUP BY d.lang, f.math_type",
    "formulas_of_rated": """WITH rated AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS formulas FROM formulas WHERE doc_id IS NOT NULL GROUP BY doc_id)
      SELECT r.doc_id, r.quality, coalesce(n.formulas, 0) AS formulas FROM rated r LEFT JOIN n ON r.doc_id = n.doc_id""",
    "first_formulas": DETECTED + "SELECT doc_id, start, latex, n::INT AS n FROM (SELECT doc_id, start, latex, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM detected) x WHERE n <= 3",
    "process_documents": DETECTED + """SELECT d.doc_id, d.source AS source_file, TRUE AS success, coalesce(n.n, 0)::INT AS total_formulas FROM documents d
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM detected GROUP BY doc_id) n ON d.doc_id = n.doc_id""",
    "failed_runs": "SELECT e.type AS error_type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(errors) AS e FROM results WHERE errors IS NOT NULL) x GROUP BY 1",
}


def _ocr(x: str) -> str:
    out = _strip(x)
    for old, new in RECOGNISED:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


SQL["ocr_text_to_latex"] = f"""WITH replaced AS (SELECT chem_id, {_ocr("text")} AS t FROM chemicals WHERE text IS NOT NULL),
  parts AS (SELECT chem_id, t, string_split(t, '/') AS p FROM replaced)
  SELECT chem_id, CASE WHEN len(p) = 2 AND NOT contains(t, '\\') AND {_strip("p[1]")} <> '' AND {_strip("p[2]")} <> '' THEN '\\frac{{' || {_strip("p[1]")} || '}}{{' || {_strip("p[2]")} || '}}' ELSE t END AS latex FROM parts"""

# Each step goes one level down; a bare object in a list field and a string of JSON under metadata are taken for what they hold.
_LIST_FIELDS = "('formulas', 'chemical_formulas', 'code_blocks', 'diagrams', 'alternatives', 'boxes', 'refs', 'series', 'points', 'outputs', 'frames', 'revisions')"
SQL["p3_found"] = f"""WITH RECURSIVE walk AS (
  SELECT content_id, '' AS path, '' AS parent, payload::JSON AS v, FALSE AS is_item FROM (SELECT DISTINCT content_id, payload FROM stem_content WHERE json_valid(payload)) p
  UNION ALL
  SELECT content_id,
         CASE WHEN bare THEN path || '/0' ELSE path END, parent,
         v, (from_list OR bare) AND json_type(v) = 'OBJECT'
  FROM (
    SELECT content_id, path, parent, from_list, list_field AND json_type(v) = 'OBJECT' AS bare, v
    FROM (
      SELECT w.content_id, CASE WHEN w.path = '' THEN k.key ELSE w.path || '/' || k.key END AS path,
             CASE WHEN w.is_item THEN w.path ELSE w.parent END AS parent, k.from_list,
             NOT k.from_list AND k.key IN {_LIST_FIELDS} AS list_field,
             CASE WHEN NOT k.from_list AND k.key = 'metadata' AND json_type(k.child) = 'VARCHAR' AND json_valid(json_extract_string(k.child, '$')) AND json_type(json_extract_string(k.child, '$')) = 'OBJECT'
                  THEN json_extract_string(k.child, '$')::JSON ELSE k.child END AS v
      FROM walk w, LATERAL (
        SELECT key, json_extract(w.v, '$."' || key || '"') AS child, FALSE AS from_list FROM (SELECT unnest(json_keys(w.v)) AS key) a WHERE json_type(w.v) = 'OBJECT'
        UNION ALL
        SELECT i::VARCHAR, json_extract(w.v, '$[' || i || ']'), TRUE FROM (SELECT unnest(range(0, json_array_length(w.v)::BIGINT)) AS i) b WHERE json_type(w.v) = 'ARRAY') k
    ) c
  ) d WHERE json_type(v) IN ('OBJECT', 'ARRAY')
)
SELECT DISTINCT content_id, path AS object_path, parent AS parent_path FROM walk WHERE is_item"""
_WALK = SQL["p3_found"].rpartition("SELECT DISTINCT")[0] + """, items AS (SELECT DISTINCT content_id, path AS object_path, parent AS parent_path, regexp_extract(path, '([^/]*)/[0-9]+$', 1) AS tag, v FROM walk WHERE is_item)
"""
SQL["p3_counts"] = _WALK + """SELECT CASE WHEN tag IN ('formulas', 'chemical_formulas', 'code_blocks', 'diagrams', 'alternatives', 'boxes', 'refs', 'series', 'points', 'outputs', 'frames', 'revisions') THEN tag ELSE 'others' END AS tag,
  count(*) AS n, count(*) FILTER (WHERE parent_path = '') AS roots, count(DISTINCT content_id) AS records FROM items GROUP BY 1"""
_HELD = "CASE WHEN json_type(v->'metadata') = 'VARCHAR' AND json_valid(v->>'metadata') THEN (v->>'metadata')::JSON ELSE v->'metadata' END"
SQL["p3_formulas"] = _WALK + f"""SELECT content_id, object_path, parent_path, v->>'latex' AS latex, v->>'type' AS type, TRY_CAST(v->>'confidence' AS DOUBLE) AS confidence, TRY_CAST(v->>'page_number' AS INT) AS page_number,
  v->>'mathml' AS mathml, m->>'engine' AS engine, m->'context'->>'section' AS section FROM (SELECT *, {_HELD} AS m FROM items WHERE tag = 'formulas') x"""
SQL["p3_alternatives"] = _WALK + "SELECT content_id, object_path, parent_path, v->>'latex' AS latex, TRY_CAST(v->>'score' AS DOUBLE) AS score FROM items WHERE tag = 'alternatives'"
SQL["plot_points"] = """SELECT diagram_id, count(*)::INT AS points, min(y) AS lowest, max(y) AS highest FROM (
  SELECT diagram_id, a * pow(CASE WHEN i = 999 THEN 10.0::DOUBLE ELSE -10.0::DOUBLE + i * (20.0::DOUBLE / 999.0::DOUBLE) END, p) + c AS y FROM (
    SELECT diagram_id, regexp_extract(content, '^y = (\\d+)\\*x', 1)::DOUBLE AS a, regexp_extract(content, 'x\\^(\\d+) ', 1)::DOUBLE AS p, replace(regexp_extract(content, '([+-] \\d+)$', 1), ' ', '')::DOUBLE AS c
    FROM diagrams WHERE regexp_matches(content, '^y = \\d+\\*x\\^\\d+ [+-] \\d+$')) f, range(0, 1000) r(i)) y GROUP BY diagram_id"""
#: The grammar over the formulas of documents instead of the table.
_FOUND = DETECTED.replace("WITH", "WITH RECURSIVE", 1).rstrip() + ", " + P.FINDINGS.partition("WITH RECURSIVE")[2].replace("FROM formulas WHERE latex IS NOT NULL", "FROM detected")
_WRONG = ", wrong AS (SELECT latex, list({'type': type, 'message': message, 'position': position::INT, 'token_index': token_index::INT} ORDER BY CASE WHEN type = 'unmatched_brace' THEN 0 WHEN type = 'unmatched_delimiter' THEN 2 ELSE 4 END + CASE WHEN message LIKE 'Unmatched opening%' OR message LIKE '%left' OR type = 'unclosed_environment' THEN 1 ELSE 0 END, token_index) AS errors FROM findings WHERE level = 'error' GROUP BY latex)"
SQL["parse_warnings"] = _FOUND + _WRONG + "SELECT d.doc_id, 'parse_warning' AS type, d.latex AS formula, len(w.errors)::INT AS errors FROM detected d JOIN wrong w ON d.latex = w.latex UNION ALL SELECT doc_id, 'mathml_conversion', latex, 0 FROM detected WHERE length(latex) > 10000"
SQL["export_json"] = _FOUND + _WRONG + f""", warned AS (SELECT d.doc_id, list({{'type': 'parse_warning', 'formula': d.latex, 'errors': w.errors}} ORDER BY d.start, d.k) AS warnings FROM (SELECT *, row_number() OVER () AS k FROM detected) d JOIN wrong w ON d.latex = w.latex GROUP BY d.doc_id),
  listed AS (SELECT doc_id, count(*) AS n, list({{'latex': latex, 'type': math_type, 'position': [0, start * 10, 100, 20], 'page_number': 1, 'confidence': confidence, 'mathml': {_mathml("latex", "FALSE")}, 'rendered_image': NULL::VARCHAR, 'metadata': MAP {{}}::MAP(VARCHAR, VARCHAR)}} ORDER BY start) AS formulas FROM detected GROUP BY doc_id),
  kinds AS (SELECT doc_id, map(list(math_type ORDER BY first, math_type), list(n ORDER BY first, math_type)) AS kinds FROM (SELECT doc_id, math_type, count(*) AS n, min(start) AS first FROM detected GROUP BY doc_id, math_type) x GROUP BY doc_id)
  SELECT d.doc_id, to_json({{'content': {{'formulas': coalesce(l.formulas, []), 'chemical_formulas': []::VARCHAR[], 'code_blocks': []::VARCHAR[], 'diagrams': []::VARCHAR[], 'metadata': MAP {{}}::MAP(VARCHAR, VARCHAR),
    'statistics': {{'total_formulas': coalesce(l.n, 0), 'total_chemical_formulas': 0, 'total_code_blocks': 0, 'total_diagrams': 0, 'formula_types': coalesce(k.kinds, MAP {{}}::MAP(VARCHAR, BIGINT))}}}},
    'source_file': d.source, 'processing_time': NULL::DOUBLE, 'errors': []::VARCHAR[], 'warnings': coalesce(w.warnings, []), 'success': TRUE}})::VARCHAR AS document
  FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN kinds k ON d.doc_id = k.doc_id LEFT JOIN warned w ON d.doc_id = w.doc_id"""
SQL["isolated_failures"] = DETECTED + """SELECT d.doc_id, coalesce(f.bad, 0) = 0 AND NOT coalesce(contains(d.text, 'lemma'), FALSE) AS success,
    CASE WHEN coalesce(contains(d.text, 'lemma'), FALSE) THEN 'general' WHEN coalesce(f.bad, 0) > 0 THEN 'formula_extraction' END AS error_type,
    CASE WHEN coalesce(contains(d.text, 'lemma'), FALSE) THEN 1 ELSE coalesce(f.bad, 0) END::INT AS errors, CASE WHEN coalesce(contains(d.text, 'lemma'), FALSE) THEN 0 ELSE coalesce(f.good, 0) END::INT AS total_formulas
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE contains(latex, 'frac')) AS bad, count(*) FILTER (WHERE NOT contains(latex, 'frac')) AS good FROM detected GROUP BY doc_id) f ON d.doc_id = f.doc_id"""


def _values(rows) -> str:
    """Rows as a table c(case, a, b, ...)."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else _quoted(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, (i, *r))) + ")" for i, r in enumerate(rows)) + ")"


def _taking_turns(rows, columns: str, select: str) -> str:
    return f"SELECT f.formula_id, {select} FROM formulas f JOIN {_values(rows)} c(n, {columns}) ON f.formula_id % {len(rows)} = c.n"


_MATH = "'<math xmlns=\"http://www.w3.org/1998/Math/MathML\" display=\"' || CASE WHEN f.formula_id % 2 = 0 THEN 'block' ELSE 'inline' END || CASE WHEN inside = '' THEN '\"/>' ELSE '\">' || inside || '</math>' END AS mathml"
SQL |= {
    "parse_cases": _taking_turns([c[1:] for c in cases.PARSES], "findings, tree, tokens", "findings, tree, tokens"),
    "mathml_cases": _taking_turns([c[1:] for c in cases.CONVERSIONS], "inside", _MATH),
    "detect_cases": "SELECT formula_id, unnest(string_split(found, '; ')) AS formula FROM (" + _taking_turns([c[1:] for c in cases.DETECTIONS], "found", "found") + ") x WHERE found <> ''",
    "mathml_validate_cases": _taking_turns([c[1:] for c in cases.VALIDATIONS], "errors", "errors = '' AS is_valid, errors"),
    "mathml_optimize_cases": _taking_turns([c[1:] for c in cases.OPTIMISATIONS], "optimised", "optimised"),
    "error_messages": _taking_turns([c[1:] for c in cases.LOGS], "message", "message"),
    "scan_cases": f"SELECT n AS ordinal, text, error_type, error FROM {_values([(text, kind, error and error.replace('%s', name)) for name, _, text, kind, error in cases.FILES])} c(n, text, error_type, error)",
    "recognition_cases": f"SELECT n AS image, latex, confidence::DOUBLE AS confidence, error::VARCHAR AS error, backend, latex <> '' AS is_valid FROM {_values([r[1:] for r in cases.REPLIES])} c(n, latex, confidence, error, backend)",
    # The least side is 1, and 2,048 the largest where there are too many bytes.
    "service_images": "SELECT image, '89504E470D0A1A0A' AS signature, width, height FROM (VALUES (0, 240, 160), (1, 2048, 32), (2, 68, 2048)) c(image, width, height)",
    "render_formulas": "SELECT formula_id, CASE WHEN NOT contains(latex, '{') THEN '<svg>' || length(latex) || '</svg>' END AS svg, CASE WHEN contains(latex, '{') THEN 'out of ink' END AS error, CASE WHEN contains(latex, '{') THEN 'failing' ELSE 'drawing' END AS renderer FROM formulas WHERE latex IS NOT NULL",
    # 50 pixels a unit; the longest arrow, of length sqrt 2, is 10 pixels.
    "vector_field": """SELECT printf('x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f"', 50.0 * (x + 1), 100.0 - 50.0 * (y + 1), 50.0 * (x + 1) - y * 10 / sqrt(2), 100.0 - 50.0 * (y + 1) - x * 10 / sqrt(2)) AS line
      FROM (SELECT unnest([-1.0, 0.0, 1.0]::DOUBLE[]) AS x) a, (SELECT unnest([-1.0, 0.0, 1.0]::DOUBLE[]) AS y) b""",
}
_BOXES = [(i, *map(int, box.split(","))) for i, (_, boxes) in enumerate(cases.PAGES) for box in boxes.split()]
_BOXED = "(VALUES " + ", ".join(f"({', '.join(map(str, b))})" for b in _BOXES) + ") c(page, x, y, width, height)"
SQL["page_regions"] = f"SELECT page, x, y, width, height, width || ' ' || height AS size FROM {_BOXED}"
SQL["region_recognition"] = f"SELECT page, x, y, width, height, 'P5 ' || width || ' ' || height AS latex, 1.0::DOUBLE AS confidence, 'sizes' AS backend FROM {_BOXED}"
