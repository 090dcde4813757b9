"""Evaluation texts leaking into training text (problem 6).

Words are the longest runs of letters or digits in lower case; each word of the items is one
symbol, all other words are one symbol that no item has.  One Aho-Corasick automaton holds anchors: of each item every run
of ``words // 2`` words that begins at a multiple of ``words - words // 2 + 1``, so that any ``words`` words
in a row hold one.  A document is scanned once, word by word; where an anchor is found, text and item are
compared to either side, and what is equal for at least ``words`` words is a match.  Matches map to offsets in
the original text.  Anchors take a tenth of the memory that all runs of ``words`` words would.

The automaton is built once in each Python worker from the items, which are broadcast.  Up to ``BLOCK_CHARS`` characters of items
share one automaton and one scan; beyond, each further block has its own, so any number of items can be looked for.

Defined results: a NULL or empty document or item has no match; an item of fewer words than
``words`` can't leak; items with equal passages are all reported; an empty table on either
side gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.runtime import spread

_WORD = re.compile(r"[^\W_]+")
#: Characters of items in a block; its automaton then takes some 400 MB at the very most.
BLOCK_CHARS = 32_000_000
MATCHES = "doc_id bigint, item_id bigint, char_start int, char_end int, passage_words int"


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


def _equal(a: str, i: int, b: str, j: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 16
    while n < most:
        if a[i + n : i + n + step] == b[j + n : j + n + step] and n + step <= most:
            n, step = n + step, 2 * step
        elif step > 1:
            step //= 2
        else:
            break
    return n


class Passages:
    """The automaton over the anchors of some items (item id, text)."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.words, self.symbols = words, {}
        self.anchor = max(1, words // 2)
        self.items = [(item, "".join(self._symbol(w) for w in words_of(text))) for item, text in items]
        self.back = [run[::-1] for _, run in self.items]
        anchors: dict[str, list[tuple[int, int]]] = {}
        for n, (_, run) in enumerate(self.items):
            if len(run) >= words:
                for at in range(0, len(run) - self.anchor + 1, words - self.anchor + 1):
                    anchors.setdefault(run[at : at + self.anchor], []).append((n, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for anchor, places in anchors.items():
            self.automaton.add_word(anchor, places)
        self.any = bool(anchors)
        if self.any:
            self.automaton.make_automaton()

    def _symbol(self, word: str) -> str:
        """One character a word, counted from U+0001; the surrogates are left out, U+0000 is any other word."""
        n = len(self.symbols) + 1
        return self.symbols.setdefault(word, chr(n if n < 0xD800 else n + 0x800))

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item, first and last offset and length in words of each maximal passage of ``text``."""
        if not self.any:
            return []
        spans = [*_WORD.finditer(text)]
        if len(spans) < self.words:
            return []
        get = self.symbols.get
        line = "".join([get(m[0].lower(), "\0") for m in spans])
        back = line[::-1]
        # Of item and shift against it, up to where it has been compared; of each item the first and last ends of matches.
        compared: dict[tuple[int, int], int] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for last, places in self.automaton.iter(line):
            first = last - self.anchor + 1
            for n, at in places:
                if compared.get((n, first - at), -1) >= last:
                    continue
                item, run = self.items[n]
                begin = first - _equal(back, len(line) - first, self.back[n], len(run) - at)
                end = last + _equal(line, last + 1, run, at + self.anchor)
                compared[n, first - at] = end
                if end - begin + 1 >= self.words:
                    ends.setdefault(item, []).append((begin + self.words - 1, end))
        found = []
        for item, spans_ in ends.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans_):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            found += [(item, spans[a - self.words + 1].start(), spans[b].end(), b - a + self.words) for a, b in merged]
        return found


_built: dict[tuple, Passages] = {}


def _passages(key: tuple, items: list[tuple[int, str]], words: int) -> Passages:
    """The worker's automaton, built once for all its tasks of a block."""
    if key not in _built:
        _built.clear()
        _built[key] = Passages(items, words)
    return _built[key]


def _scan(key: tuple, items, words: int):
    """``items`` is the broadcast of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = _passages(key, items.value, words)
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in passages.matches(text.as_py())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "char_start", "char_end", "passage_words"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each passage of at least ``words`` words that a document (doc_id, text) shares with an item (item_id, text).

    Columns: doc_id, item_id, char_start, char_end (offsets of the original text, end exclusive)
    and passage_words.  The items' texts are taken to the driver one block at a time.
    """
    if words < 1:
        raise ValueError("words must be at least 1")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL AND text <> ''")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= 2 * words - 1)
    result = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted((r.item_id, r.text) for r in own.toLocalIterator())
        shared = documents.sparkSession.sparkContext.broadcast(rows)
        found = spread(docs).mapInArrow(_scan((hash(tuple(rows)), words), shared, words), MATCHES)
        result = found if result is None else result.unionByName(found)
    return result


def leaks(documents: DataFrame, items: DataFrame, words: int = 12) -> DataFrame:
    """Each document with each item found in it, once: doc_id, item_id."""
    return leaked_passages(documents, items, words).select("doc_id", "item_id").distinct()
