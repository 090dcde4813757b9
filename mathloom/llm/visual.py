"""Visually identical text with different characters (problem 1).

Full-width forms, odd spaces and look-alike letters are mapped first.  What is left of invisible
characters and combining sequences is made equal by the accent-sensitive Unicode collation under
which SQL groups the mapped values.  Each class gets a deterministic canonical member, its
shortest and then smallest mapped spelling; that one spelling of a class is composed and rid of
invisible characters, and then joined back to the rows.

The collation also takes characters for equal that look different: marks that it gives no weight,
such as Hebrew accents, and letters or digits that it tells apart by their code points only.  So each
character that is neither invisible nor part of a composed letter goes into the grouping as its number (``_spelled_out``).
All members of a class then have the same form: a row's form never depends on other rows.

Only values holding a character that can differ invisibly enter the grouping.  Every other
value is its own canonical form: the form of an equal-looking value is that string.

Look-alikes of Cyrillic and Greek are stated, since these scripts also have words and symbols of their own here; those of
other scripts come from the public confusables data that ICU holds, by ``from_confusables``.

Defined results: NULL stays NULL and is no case; an empty text is its own form; invisible
operators U+2061 to U+2064 are kept; a word of another script stays as it is unless all its
foreign letters look like Latin ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.runtime import cut, spread

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏѵАВЕКМНОРСТУХЅІЈҮԌԚԜӀѴ", "aeopcyxsijhdqwlvABEKMHOPCTYXSIJYGQWIV", strict=True))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹϳͿ", "oABEZHIKMNOPTYXcCjJ", strict=True))
#: Operators of MathML that are invisible on purpose.
OPERATORS = "\u2061\u2062\u2063\u2064"
_FULL_WIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
#: In markup these would read as syntax.
_MARKUP = {"<": "&lt;", ">": "&gt;", "&": "&amp;"}
_FULL_WIDTH_MARKUP = _FULL_WIDTH | {c: _MARKUP[t] for c, t in _FULL_WIDTH.items() if t in _MARKUP}
_SPACES = {c: " " for c in (*range(0x2000, 0x200B), 0x0B, 0x0C, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
#: Format and control characters, selectors and fillers, which show nothing; not those signs of numbers and abbreviations that do.
_INVISIBLE = (
    r"[[\p{Cf}\p{Variation_Selector}\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f͏ᅟᅠ឴឵ㅤﾠ]"
    r"--[⁡-⁤؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd]]"
)
_invisible = regex.compile(_INVISIBLE, regex.V1)
_word = regex.compile(rf"(?:[\p{{L}}\p{{M}}]|{_INVISIBLE})+", regex.V1)
_wide = re.compile("[\uff01-\uff5e" + "".join(map(chr, _SPACES)) + "]")
_reference = re.compile(r"&#(?:[xX]0*([0-9A-Fa-f]{1,6})|0*([0-9]{1,7}));")
#: Scripts whose letters stand beside Latin ones in every text or as ideographs, and those with a table here.
_NO_CONFUSABLES = regex.compile(r"[\p{Latin}\p{Common}\p{Inherited}\p{Han}\p{Hangul}\p{Greek}\p{Cyrillic}]")


@lru_cache(maxsize=1)
def from_confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of scripts without a table here, written from left to right, that ICU's confusables data give one Latin letter for."""
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and unicodedata.bidirectional(c) == "L" and not _NO_CONFUSABLES.match(c)]
    # The skeleton is taken character by character, so one call does for all.
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    # A skeleton writes the capital I as l.
    return {c: "I" if s == "l" and not c.islower() else s for c, s in zip(letters, skeletons, strict=True) if len(s) == 1 and s.isascii() and s.isalpha()}


def decode_references(text: str) -> str:
    """Numeric character references as their characters; those of markup as their names."""

    def one(m):
        code = int(m[1], 16) if m[1] else int(m[2])
        if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
            return m[0]
        return _MARKUP.get(chr(code), chr(code))

    return _reference.sub(one, text) if "&#" in text else text


def _spans(codes: Iterable[int]) -> str:
    """The inside of a pattern class."""
    spans, last = [], -2
    for code in sorted(codes):
        if code == last + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
        last = code
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in spans)


_beyond = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=4)
def _suspect(lookalikes: str) -> Callable[[str], bool]:
    """The test for suspects, made once in each worker.

    A class of characters up to U+FFFF is a table, one that goes beyond is a list of spans, which takes many times as long.
    """
    codes = {*map(ord, lookalikes), *_FULL_WIDTH}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x10000, 0x12000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] == "M" or kind in ("Cf", "Cc") or unicodedata.normalize("NFC", c) != c:
            codes.add(code)
    codes = {c for c in codes if _invisible.match(chr(c)) or unicodedata.category(chr(c)) not in ("Cf", "Cc")}
    codes |= {*_SPACES, *range(9), *range(0x0E, 0x20), 0x7F, 0x115F, 0x1160, 0x3164, 0xFFA0}
    low, high = re.compile(f"[{_spans(c for c in codes if c < 0x10000)}]").search, re.compile(f"[{_spans(c for c in codes if c >= 0x10000)}" + r"\U000E0000-\U000E0FFF]").search
    return lambda text: bool(low(text)) or not text.isascii() and bool(_beyond.search(text)) and bool(high(text))


class Forms:
    """The one form of texts, given look-alikes besides those of Cyrillic and Greek."""

    def __init__(self, others: dict[str, str] | None = None):
        self.lookalikes = CYRILLIC | GREEK | (others or {})
        self.table = str.maketrans(self.lookalikes)
        self.foreign = re.compile("[" + "".join(self.lookalikes) + "]")

    def _latin(self, match) -> str:
        """A word with look-alikes replaced, unless it belongs to another script."""
        if not self.foreign.search(match[0]):
            return match[0]
        word = unicodedata.normalize("NFC", _invisible.sub("", match[0]))
        latin = alike = other = 0
        for c in word:
            if c in self.lookalikes:
                alike += 1
            elif c.isalpha():
                if unicodedata.name(c, "").startswith("LATIN"):
                    latin += 1
                else:
                    other += 1
        if alike and (not other or latin + alike > other > 0 and latin):
            return word.translate(self.table)
        return match[0]

    def mapped(self, decoded: str, markup: bool) -> str:
        """Full-width forms, spaces and look-alike letters replaced; marks and invisible characters left."""
        text = decoded
        if _wide.search(text):
            text = text.translate(_FULL_WIDTH_MARKUP if markup else _FULL_WIDTH).translate(_SPACES)
        return _word.sub(self._latin, text) if self.foreign.search(text) else text

    def polished(self, mapped: str, markup: bool) -> str:
        """The form of a mapped spelling: without invisible characters, letters composed."""
        text = self.mapped(unicodedata.normalize("NFC", _invisible.sub("", mapped)), markup)
        return unicodedata.normalize("NFC", text)

    def one_form(self, value: str, markup: bool = False) -> str:
        """The form of a single value, for use outside the grouping."""
        text = decode_references(value) if markup else value
        return self.polished(self.mapped(text, markup), markup) if self.suspect(text) else text

    @property
    def suspect(self) -> Callable[[str], bool]:
        """Whether a text holds a character that can make equal-looking values differ; without one, a value is its own form."""
        return _suspect("".join(self.lookalikes))


#: The forms where no session tells the other look-alikes.
BASE = Forms()


@lru_cache(maxsize=1)
def forms_for(spark: SparkSession) -> Forms:
    """The forms with all look-alikes known; built on the driver and sent with the tasks."""
    return Forms(from_confusables(spark))


#: Around the number of a character; if stored themselves, they are spelled out as well.
_OPEN, _CLOSE = "\uf8f0", "\uf8f1"


def composing() -> set[int]:
    """Characters beyond ASCII that are, or are part of, a composed letter or sign of Latin, Greek, Cyrillic, kana and mathematics.

    Of other scripts the collation gives some marks the same weight.
    """
    codes: set[int] = set()
    for code in (*range(0xA0, 0x0590), *range(0x1E00, 0x2000), *range(0x2100, 0x2300), *range(0x3040, 0x3100)):
        parts = unicodedata.decomposition(chr(code))
        if parts and parts[0] != "<":
            codes |= {code, *(int(x, 16) for x in parts.split())}
    return {c for c in codes if c > 0x7F}


@lru_cache(maxsize=1)
def _opaque() -> regex.Pattern:
    """Characters that go into the grouping as their number: not ASCII, invisible, composing, Hangul or ideographs."""
    kept = _spans({*range(0x80), *composing(), *range(0x1100, 0x1200), *range(0x3400, 0xA000), *range(0xA960, 0xA980), *range(0xAC00, 0xD7FC)})
    return regex.compile(rf"[[^{kept}\U00020000-\U0002F7FF]--{_INVISIBLE}]", regex.V1)


def _spelled_out(mapped: str) -> str:
    """``mapped`` with the characters that the collation might take for others as their numbers."""
    return mapped if mapped.isascii() else _opaque().sub(lambda m: f"{_OPEN}{ord(m[0]):x}{_CLOSE}", mapped)


_number = re.compile(f"{_OPEN}([0-9a-f]+){_CLOSE}")


def _read_back(spelled: str) -> str:
    return _number.sub(lambda m: chr(int(m[1], 16)), spelled)


#: The cheap test in the JVM; a class of more ranges costs Java many times as much.
_PLAIN = r"[^\x20-\x7E\t\n\r]"


def _odd() -> Column:
    """The test in the JVM: characters or references that Python has to look at."""
    return F.col("value").rlike(_PLAIN) | ((F.col("field_name") == "mathml") & F.col("value").contains("&#"))


def suspects(rows: DataFrame) -> DataFrame:
    """Of rows (row_id, field_name, value), those that may have another form, with decoded and mapped spelling.

    ``field_name`` "mathml" marks values in which numeric character references count.
    """
    forms = forms_for(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspect = forms.suspect
        for batch in batches:
            kept, decoded, keys = [], [], []
            for i, (field, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                markup = field == "mathml"
                text = decode_references(value) if markup else value
                if text is not value or suspect(text):
                    kept.append(i)
                    decoded.append(text)
                    keys.append(_spelled_out(forms.mapped(text, markup)))
            own = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(decoded, pa.string()), pa.array(keys, pa.string())], names=["row_id", "field_name", "decoded", "mapped"])

    found = rows.select("row_id", "field_name", "value").where(F.col("value").isNotNull() & _odd())
    return spread(found).mapInArrow(run, f"row_id {dict(rows.dtypes)['row_id']}, field_name string, decoded string, mapped string")


def _polished(classes: DataFrame) -> DataFrame:
    """Classes (field_name, look, members, member) with the form of their canonical member."""
    forms = forms_for(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [forms.polished(_read_back(x), f == "mathml") for f, x in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, pa.string())], names=["field_name", "look", "members", "canonical"])

    return classes.mapInArrow(run, "field_name string, look string, members bigint, canonical string")


#: Longest look, in bytes, of the hot classes that are broadcast.
HOT_BYTES = 16_384


def canonical_forms(rows: DataFrame, hot: int = 1024, least: int = 10_000) -> DataFrame:
    """(row_id, field_name, decoded, canonical) of the suspects in rows (row_id, field_name, value).

    SQL groups mapped values under the accent- and case-sensitive collation UNICODE, with partial
    aggregates before the shuffle.  Suspects and classes are written once.  A class can hold a
    third of all rows: those of more than ``least`` rows and more than one of ``hot`` parts of all are joined where the
    rows are.  There are fewer than ``hot`` of them, of ``HOT_BYTES`` each at most; adaptive execution splits hot classes of longer values.
    """
    spark, spelled = rows.sparkSession, cut(suspects(rows))
    grouped = spark.sql(
        """
        SELECT field_name, CAST(look AS STRING) AS look, members, member
        FROM (
          SELECT field_name, look, count(*) AS members, min(struct(char_length(mapped) AS n, mapped)).mapped AS member
          FROM (SELECT field_name, mapped COLLATE UNICODE AS look, mapped FROM {spelled})
          GROUP BY field_name, look)
        """,
        spelled=spelled,
    )
    classes = cut(_polished(grouped))
    limit = max(least, (classes.agg(F.sum("members")).first()[0] or 0) / hot)
    is_hot = (F.col("members") > limit) & (F.octet_length("look") <= HOT_BYTES) & (F.octet_length("canonical") <= HOT_BYTES)
    joined = """
        SELECT {hint} s.row_id, s.field_name, s.decoded, c.canonical
        FROM {spelled} s JOIN {classes} c ON s.field_name = c.field_name AND s.mapped COLLATE UNICODE = c.look COLLATE UNICODE
    """
    large = classes.where(is_hot)
    if large.isEmpty():
        return spark.sql(joined.replace("{hint}", ""), spelled=spelled, classes=classes)
    others = spark.sql(
        "SELECT /*+ BROADCAST(c) */ s.* FROM {spelled} s LEFT ANTI JOIN {large} c ON s.field_name = c.field_name AND s.mapped COLLATE UNICODE = c.look COLLATE UNICODE",
        spelled=spelled,
        large=large,
    )
    found = spark.sql(joined.replace("{hint}", "/*+ BROADCAST(c) */"), spelled=spelled, classes=large)
    return found.unionByName(spark.sql(joined.replace("{hint}", ""), spelled=others, classes=classes.where(~is_hot)))


def all_forms(rows: DataFrame) -> DataFrame:
    """(row_id, field_name, form) of all rows (row_id, field_name, value) that aren't NULL.

    Only suspects are shuffled; values that are their own form pass through.
    """
    forms = forms_for(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspect = forms.suspect
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            own = [i for i, (field, value) in enumerate(pairs) if not suspect(value) and (field != "mathml" or decode_references(value) is value)]
            yield batch.take(pa.array(own, pa.int32())).rename_columns(["row_id", "field_name", "form"])

    rows = rows.select("row_id", "field_name", "value").where("value IS NOT NULL")
    plain = rows.where(~_odd()).withColumnRenamed("value", "form")
    settled = spread(rows.where(_odd())).mapInArrow(run, plain.schema)
    return plain.unionByName(settled).unionByName(canonical_forms(rows).select("row_id", "field_name", F.col("canonical").alias("form")))


def melt(formulas: DataFrame, key: str = "formula_id", fields: tuple[str, ...] = ("latex", "mathml")) -> DataFrame:
    """(row_id, field_name, value) of the non-NULL values of some columns; other columns are not read."""
    pairs = F.inline(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))
    return formulas.select(F.col(key).alias("row_id"), pairs).where("value IS NOT NULL")
