"""Column functions over LaTeX strings; all of them are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mathloom.functions.vocab import MATH_MARKS, OCR_REPLACEMENTS

#: White space as Unicode knows it; Java's own \s is that of ASCII.
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same for text that is all ASCII: one range table, where several ranges cost Java many times as much.
ASCII_SPACE = r"[\x09-\x0d\x1c-\x20]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at its ends."""
    return F.when(is_ascii(text), F.regexp_replace(text, rf"^{ASCII_SPACE}+|{ASCII_SPACE}+$", "")).otherwise(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""))


def presence(text: Column, parts: tuple[str, ...]) -> Column:
    """How many of ``parts`` occur in ``text``."""
    total = F.lit(0)
    for part in parts:
        total = total + text.contains(F.lit(part)).cast("int")
    return total


def confidence(raw: Column) -> Column:
    """Score of a formula as captured: 0.5, 0.05 for each kind of mark up to 0.4, 0.1 for a usual length.

    NULL for NULL.  The additions keep their order, so doubles are equal to the bit.
    """
    marks = F.least(F.lit(0.4), presence(raw, MATH_MARKS).cast("double") * F.lit(0.05))
    score = F.lit(0.5) + marks
    score = F.when(F.length(raw).between(2, 1000), score + F.lit(0.1)).otherwise(score)
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def position(start: Column) -> Column:
    """The box of a formula that begins at character ``start``."""
    return F.struct(F.lit(0).alias("x"), (start * 10).cast("int").alias("y"), F.lit(100).alias("width"), F.lit(20).alias("height"))


def confidence_band(score: Column) -> Column:
    """high from 0.8, medium from 0.5, else low."""
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score.isNotNull(), "low")


# The rules of the normal form, pattern and replacement, in order; \\s is any white space.
_SIZING = (r"\\left\s*", ""), (r"\\right\s*", "")
_LIMITS = (r"\\limits\s*", ""), (r"\\nolimits\s*", "")
_SPACING_AWAY = (r"\\[,;:!]\s*", " "), (r"\\(?:quad|qquad)\s*", " ")
_THIN_SPACES = (r"\\,(?![a-zA-Z])", " "), (r"\\,\s*(?=d[a-z])", r"\\,"), (r"(?<=[0-9])\s*\\,\s*(?=[0-9])", " ")
_TIGHT_AND_WIDE = (r"\s*([_^])\s*", "$1"), (r"\s*([+\-*/=<>])\s*", " $1 ")
_TRIMMED = (r"\s+", " "), (r"^\s|\s$", "")


def normalize(latex: Column, preserve_spacing: bool = False, aggressive: bool = False) -> Column:
    """One spelling of spaces around operators and scripts; ``aggressive`` also drops sizing and spacing commands."""
    spacing = () if preserve_spacing else _SPACING_AWAY if aggressive else _THIN_SPACES
    # All white space becomes a blank anyway; with the rare kinds gone first, the rules need ASCII only.
    out = F.when(is_ascii(latex), latex).otherwise(F.regexp_replace(latex, SPACE, " "))
    for pattern, to in (*_TRIMMED, *_LIMITS, *(_SIZING if aggressive else ()), *spacing, *_TIGHT_AND_WIDE, *_TRIMMED):
        out = F.regexp_replace(out, pattern.replace(r"\s", ASCII_SPACE), to)
    return out


def formula_hash(latex: Column) -> Column:
    """Sixteen hexadecimal digits that equal formulas share."""
    return F.substring(F.md5(normalize(latex, aggressive=True)), 1, 16)


def text_to_latex(text: Column) -> Column:
    """Recognised plain text as basic LaTeX; one fraction is built where nothing else was replaced."""
    out = strip(text)
    for old, new in OCR_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    parts = F.split(out, "/")
    top, bottom = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    single = (F.size(parts) == 2) & ~out.contains("\\") & (top != "") & (bottom != "")
    return F.when(single, F.concat(F.lit("\\frac{"), top, F.lit("}{"), bottom, F.lit("}"))).otherwise(out)


def lexical_tokens(latex: Column) -> Column:
    """The tokens of a formula by one alternation; exact but for optional arguments, which need state."""
    pattern = r"\\(?:begin|end)\{\w+\*?\}|\\[a-zA-Z]+|(?s:\\[^a-zA-Z])|[{}_^]|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\p{L}|[+\-*/=<>]|[()\[\]]|\s+|(?s:.)"
    return F.regexp_extract_all(latex, F.lit(pattern), F.lit(0))


def token_kind(token: Column) -> Column:
    """The kind of a lexical token."""
    from mathloom.functions.vocab import ACCENTS, FONTS, FUNCTIONS, GREEK
    from mathloom.functions.vocab import SPACING as SPACES

    name = F.substring(token, 2, 1_000_000)

    def one_of(words) -> Column:
        return name.isin(*sorted(words))

    command = F.when(one_of(GREEK), "symbol").when(one_of(FUNCTIONS), "operator").when(one_of(SPACES), "spacing").when(name.rlike(r"^(begin|end)(\{|$)"), "environment").otherwise("command")
    return (
        F.when((F.length(token) > 1) & token.startswith("\\"), command)
        .when(token.isin("{", "}"), "group")
        .when(token == "_", "subscript")
        .when(token == "^", "superscript")
        .when(token.rlike(r"^\d"), "number")
        .when(token.rlike(r"^\p{L}$"), "variable")
        .when(token.isin(*"+-*/=<>"), "operator")
        .when(token.isin(*"()[]"), "delimiter")
        .when(token.rlike(r"^\s+$"), "spacing")
        .otherwise("symbol")
    )


def brace_errors(latex: Column) -> Column:
    """Number of braces without a partner, escaped ones left out."""
    braces = F.regexp_extract_all(F.regexp_replace(latex, r"(?s)\\.", ""), F.lit("[{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("stray"))
    state = F.aggregate(
        braces,
        zero,
        lambda s, b: F.when(b == "{", F.struct((s["open"] + 1).alias("open"), s["stray"].alias("stray")))
        .when(s["open"] > 0, F.struct((s["open"] - 1).alias("open"), s["stray"].alias("stray")))
        .otherwise(F.struct(s["open"].alias("open"), (s["stray"] + 1).alias("stray"))),
    )
    return state["open"] + state["stray"]


def latex_error_message(output: Column) -> Column:
    """The telling lines of a compiler's output: the first three of error lines and what follows, else the last three."""
    lines = F.split(output, "\n")
    filled = F.filter(lines, lambda x: strip(x) != "")
    # Each error line with up to two lines after it that hold something.
    around = F.flatten(
        F.transform(
            lines,
            lambda line, i: F.when(
                line.startswith("!"),
                F.concat(F.array(line), F.filter(F.slice(lines, i + 2, F.lit(2)), lambda x: strip(x) != "")),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    last = F.when(F.size(filled) > 0, F.concat_ws(" ", F.slice(filled, F.greatest(F.size(filled) - 2, F.lit(1)), F.lit(3)))).otherwise("Unknown error")
    return F.when(F.size(around) > 0, F.concat_ws(" ", F.slice(around, 1, 3))).otherwise(last)


def render_cache_key(latex: Column, dpi: int = 300, output_format: str = "png", font_size: int = 12) -> Column:
    """Key of a rendering in the general cache."""
    return F.md5(F.concat_ws("_", latex, F.lit(str(dpi)), F.lit(output_format), F.lit(str(font_size))))


def compile_cache_key(latex: Column, dpi: int = 300, font_size: int = 12, font_family: str = "Computer Modern", text_color: str = "black", background: str = "white", padding: int = 10) -> Column:
    """Key of a compiled rendering, which also depends on its look."""
    return F.md5(F.concat_ws("|", latex, *(F.lit(str(x)) for x in (dpi, font_size, font_family, text_color, background, padding))))
