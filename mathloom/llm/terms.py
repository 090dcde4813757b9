"""Frequency of every distinct term, in occurrences and in records (problem 5).

Each task counts its terms in a burst trie: inner nodes lead by the characters of a term to
containers, compact tables of suffixes with their counters; a container that outgrows ``burst``
becomes an inner node, which holds the characters that all its suffixes begin with, and a
container for each next character.  A task emits each container as one row - a subtree: its prefix
and its sorted suffixes with occurrences and records.

Subtrees are routed by adaptive prefixes: the sorted list of the shortest prefixes that tell
apart equal parts of all emitted terms.  A route is what lies between two of them, so common
prefixes of any length don't make a route hot.  The list comes from weighted summaries of all
subtrees, merged in a tree of fixed fan-in.  Subtrees that reach over an end of a route are cut
there; what lies in one route meets in one task, where matching subtrees are merged node by
node: equal containers add their counters, a container that meets an inner node is divided among
its children.  A term is in one route only, so the merged tries give the result.

A route takes about ``ROUTE_TERMS`` emitted terms at most, which bounds the memory of a merge;
the list of routes, which goes to the driver and to all tasks, has one short prefix for as many.

Defined results: NULL values and NULLs among a record's terms are no terms; a record without terms counts as a record only; an
empty text is a term of a plain field; an empty input gives no row.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.runtime import cut

#: A subtree: the prefix all its terms share, their suffixes, occurrences and records.
SUBTREE = "field_name string, prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_SCHEMA = pa.schema([("field_name", pa.string()), ("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_ROUTED = pa.schema([pa.field("route", pa.int32()), *_SCHEMA])
#: Commands of LaTeX: a backslash and the ASCII letters after it.
COMMAND = r"\\[A-Za-z]+"
#: Emitted terms of a route.
ROUTE_TERMS = 500_000
#: Characters of terms after which a task emits its tries and begins new ones.
CHARACTERS = 64_000_000
#: Summaries of routes merged at once.
FAN_IN = 32


class _Inner:
    """A node: the characters ``edge`` below its parent's, the term that ends here, children by next character."""

    __slots__ = ("edge", "own", "children")

    def __init__(self, edge: str):
        self.edge, self.own = edge, -1
        self.children: dict[str, _Inner | dict[str, int]] = {}


class BurstTrie:
    """Occurrence and record counters of terms, in containers that burst."""

    def __init__(self, burst: int = 2048):
        self.burst, self.characters = burst, 0
        self.root: _Inner | dict[str, int] = {}
        # Containers and nodes hold places in these two tables.
        self.occurrences, self.records = array("q"), array("q")

    def __len__(self) -> int:
        return len(self.occurrences)

    def _counter(self, occurrences: int, records: int) -> int:
        self.occurrences.append(occurrences)
        self.records.append(records)
        return len(self.occurrences) - 1

    def _sum(self, place: int, occurrences: int, records: int) -> None:
        self.occurrences[place] += occurrences
        self.records[place] += records

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at = self.root, 0
        while node.__class__ is _Inner and term.startswith(node.edge, at) and len(term) > at + len(node.edge):
            at += len(node.edge) + 1
            node = node.children.get(term[at - 1])
        if node.__class__ is dict and (place := node.get(term[at:])) is not None:
            self._sum(place, occurrences, records)
        elif node.__class__ is dict and len(node) < self.burst:
            node[term[at:]] = self._counter(occurrences, records)
            self.characters += len(term) - at
        else:
            self.graft("", (term,), (occurrences,), (records,))

    def graft(self, prefix: str, suffixes, occurrences, records) -> None:
        """Merge the subtree of some sorted, distinct ``suffixes`` below ``prefix``."""
        # What hangs where: the parent and the character that leads to it.
        todo = [(None, "", prefix, list(zip(suffixes, occurrences, records, strict=True)))]
        while todo:
            parent, key, prefix, entries = todo.pop()
            if not entries:
                continue
            node = self.root if parent is None else parent.children.get(key)
            if node is None:
                node = parent.children[key] = {}
            if isinstance(node, dict):
                self._fill(node, prefix, entries)
                if len(node) > self.burst:
                    self._hang(parent, key, self._burst(node))
                continue
            n, edge = len(commonprefix((prefix, node.edge))), node.edge
            if n < len(edge) and (n < len(prefix) or not all(s.startswith(edge[n:]) for s in (entries[0][0], entries[-1][0]))):
                # The paths part within the edge: another node goes in between.
                if n == len(prefix):
                    n += len(commonprefix((entries[0][0], entries[-1][0], edge[n:])))
                between = _Inner(edge[:n])
                between.children[edge[n]] = node
                node.edge = edge[n + 1 :]
                self._hang(parent, key, between)
                node, edge = between, between.edge
            if len(edge) < len(prefix):
                todo.append((node, prefix[len(edge)], prefix[len(edge) + 1 :], entries))
                continue
            skip = len(edge) - len(prefix)
            if len(entries[0][0]) == skip:
                _, o, r = entries[0]
                if node.own < 0:
                    node.own = self._counter(o, r)
                    self.characters += skip
                else:
                    self._sum(node.own, o, r)
                entries = entries[1:]
            begin = 0
            for end in range(1, len(entries) + 1):
                if end == len(entries) or entries[end][0][skip] != entries[begin][0][skip]:
                    todo.append((node, entries[begin][0][skip], "", [(s[skip + 1 :], o, r) for s, o, r in entries[begin:end]]))
                    begin = end

    def _fill(self, container: dict[str, int], prefix: str, entries: list[tuple[str, int, int]]) -> None:
        for suffix, o, r in entries:
            suffix = prefix + suffix
            if (place := container.get(suffix)) is None:
                container[suffix] = self._counter(o, r)
                self.characters += len(suffix)
            else:
                self._sum(place, o, r)

    def _hang(self, parent: _Inner | None, key: str, node: _Inner) -> None:
        if parent is None:
            self.root = node
        else:
            parent.children[key] = node

    def _burst(self, container: dict[str, int]) -> _Inner:
        """The container as a node; of its children those that are still too large burst as well."""
        top = None
        todo = [(None, "", container)]
        while todo:
            parent, key, full = todo.pop()
            node = _Inner(commonprefix((min(full), max(full))))
            skip = len(node.edge)
            for suffix, place in full.items():
                if len(suffix) == skip:
                    node.own = place
                else:
                    node.children.setdefault(suffix[skip], {})[suffix[skip + 1 :]] = place
            if parent is None:
                top = node
            else:
                parent.children[key] = node
            todo += [(node, k, c) for k, c in node.children.items() if len(c) > self.burst]
        return top

    def subtrees(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """Prefix, sorted suffixes and counters of each container, in order of the terms."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if isinstance(node, dict):
                suffixes = sorted(node)
                if suffixes:
                    yield prefix, suffixes, [self.occurrences[node[s]] for s in suffixes], [self.records[node[s]] for s in suffixes]
                continue
            prefix += node.edge
            if node.own >= 0:
                yield prefix, [""], [self.occurrences[node.own]], [self.records[node.own]]
            todo += [(prefix + k, node.children[k]) for k in sorted(node.children, reverse=True)]


def _rows(subtrees: list[tuple], schema: pa.Schema = _SCHEMA) -> pa.RecordBatch:
    columns = zip(*subtrees, strict=True) if subtrees else ([],) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _count(burst: int, most: int):
    """Terms of a task as subtrees; the tries are emitted and begun anew when they hold ``most`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}

        def emitted() -> Iterator[pa.RecordBatch]:
            for field in sorted(tries):
                chunk = []
                for subtree in tries[field].subtrees():
                    chunk.append((field, *subtree))
                    if len(chunk) == 64:
                        yield _rows(chunk)
                        chunk = []
                yield _rows(chunk)
            tries.clear()

        for batch in batches:
            fields = batch.column("field_name")
            for field in pc.unique(fields).to_pylist():
                own = batch.filter(pc.equal(fields, field))
                terms = pc.value_counts(pc.list_flatten(own.column("terms")))
                records = pc.value_counts(pc.list_flatten(own.column("distinct_terms")))
                in_records = dict(zip(records.field(0).to_pylist(), records.field(1).to_pylist(), strict=True))
                trie = tries.setdefault(field, BurstTrie(burst))
                for term, n in zip(terms.field(0).to_pylist(), terms.field(1).to_pylist(), strict=True):
                    trie.add(term, n, in_records[term])
            if sum(map(len, tries.values())) > most or sum(t.characters for t in tries.values()) > CHARACTERS:
                yield from emitted()
        yield from emitted()

    return run


def lighter(summary: list[tuple[str, int]], size: int) -> list[tuple[str, int]]:
    """At most ``size`` + 1 of the prefixes of a summary, each with the weight from it to the next.

    A kept prefix is cut to the shortest that still tells it from what comes before it.
    """
    summary = sorted(summary)
    step = sum(n for _, n in summary) / size
    kept: list[tuple[str, int]] = []
    before = None
    for prefix, n in summary:
        if kept and (kept[-1][1] + n <= step or prefix == before):
            kept[-1] = (kept[-1][0], kept[-1][1] + n)
        else:
            kept.append(("" if before is None else prefix[: len(commonprefix((before, prefix))) + 1], n))
        before = prefix
    return kept


_SUMMARY = "field_name string, node bigint, prefix string, n bigint"


def _summary(size: int, merging: bool):
    """Summaries of the prefixes (field_name, node, prefix, n) of a task or, when merging, of a group."""

    def rows(field: str, node: int, summary: list[tuple[str, int]]) -> pa.Table:
        kept = lighter(summary, size)
        return pa.table({"field_name": pa.array([field] * len(kept), pa.string()), "node": pa.array([node] * len(kept), pa.int64()), "prefix": pa.array([p for p, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, list[tuple[str, int]]] = {}
        for batch in batches:
            for field, prefix, n in zip(*(batch.column(c).to_pylist() for c in ("field_name", "prefix", "n")), strict=True):
                own = held.setdefault(field, [])
                own.append((prefix, n))
                if len(own) > 16 * size:
                    held[field] = lighter(own, 4 * size)
        for field, own in held.items():
            yield from rows(field, TaskContext.get().partitionId(), own).to_batches()

    def of_group(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return rows(key[0].as_py(), key[1].as_py(), [*zip(group["prefix"].to_pylist(), group["n"].to_pylist(), strict=True)])

    return of_group if merging else of_task


def routes_of(subtrees: DataFrame, route_terms: int = ROUTE_TERMS, part: int = 64) -> dict[str, list[str]]:
    """By field the sorted prefixes at which its routes begin, "" the first.

    Every ``part``-th term of a subtree stands for those that follow it.  A route has at most about
    ``route_terms`` terms, and there is one for each core at least, if there are terms enough.
    """
    total = subtrees.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    routes = max(subtrees.sparkSession.sparkContext.defaultParallelism, -(-total // route_terms))
    starts = F.transform(F.sequence(F.lit(0), F.size("suffixes") - 1, F.lit(part)), lambda i: F.struct(F.concat("prefix", F.get("suffixes", i)).alias("prefix"), F.least(F.lit(part), F.size("suffixes") - i).cast("bigint").alias("n")))
    level = subtrees.select("field_name", F.inline(starts)).mapInArrow(_summary(4 * routes, False), _SUMMARY)
    nodes = subtrees.rdd.getNumPartitions()
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("bigint"))
        level = level.groupBy("field_name", "node").applyInArrow(_summary(4 * routes, True), _SUMMARY)
    found: dict[str, list[tuple[str, int]]] = {}
    for r in level.collect():
        found.setdefault(r.field_name, []).append((r.prefix, r.n))
    share = {f: max(1, round(routes * sum(n for _, n in s) / total)) for f, s in found.items()}
    return {f: [p for p, _ in lighter(s, share[f])] for f, s in found.items()}


def _split(routes: dict[str, list[str]]):
    """Subtrees with their route, cut where they reach over the end of one."""
    first = dict(zip(sorted(routes), [0, *_running([len(routes[f]) for f in sorted(routes)])], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                field, prefix, suffixes, occurrences, records = row.values()
                starts, at = routes[field], 0
                while at < len(suffixes):
                    route = bisect_right(starts, prefix + suffixes[at]) - 1
                    end = len(suffixes)
                    if route + 1 < len(starts) and prefix + suffixes[-1] >= starts[route + 1]:
                        end = bisect_left(suffixes, starts[route + 1], at, key=lambda s: prefix + s)
                    out.append((first[field] + route, field, prefix, suffixes[at:end], occurrences[at:end], records[at:end]))
                    at = end
            yield _rows(out, _ROUTED)

    return run


def _running(sizes: list[int]) -> list[int]:
    total, sums = 0, []
    for n in sizes:
        total += n
        sums.append(total)
    return sums


COUNTS = "field_name string, term string, occurrences bigint, records bigint"
_COUNTS = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _merge(burst: int):
    """The terms of each route, whose subtrees follow each other, from one trie."""

    def terms(field: str, trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        for prefix, suffixes, occurrences, records in trie.subtrees():
            columns = ([field] * len(suffixes), [prefix + s for s in suffixes], occurrences, records)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, field, trie = None, "", BurstTrie(burst)
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != current:
                    yield from terms(field, trie)
                    current, field, trie = row["route"], row["field_name"], BurstTrie(burst)
                trie.graft(row["prefix"], row["suffixes"], row["occurrences"], row["records"])
        yield from terms(field, trie)

    return run


def count_terms(rows: DataFrame, burst: int = 2048, most: int = 500_000, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """(field_name, term, occurrences, records) of rows (field_name, terms ARRAY<STRING>).

    A task holds at most some ``most`` terms and those of one batch when counting, and one route's when merging.
    """
    rows = rows.select("field_name", F.array_compact("terms").alias("terms")).where("size(terms) > 0")
    rows = rows.withColumn("distinct_terms", F.array_distinct("terms"))
    subtrees = cut(rows.mapInArrow(_count(burst, most), SUBTREE))
    routed = subtrees.mapInArrow(_split(routes_of(subtrees, route_terms)), "route int, " + SUBTREE)
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merge(burst), COUNTS)


def marked(counts: DataFrame, totals: DataFrame, rare: int = 2, common: float = 0.15) -> DataFrame:
    """``counts`` with the rows of their tables, from totals (field_name, total), and a mark.

    ``mark`` is "rare" in at most ``rare`` records, "common" in at least the share ``common`` of
    all rows, else NULL; a term that is both, in a table of a few rows, is rare.
    """
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") / F.col("total") >= common, "common")
    return counts.join(totals, "field_name").withColumn("mark", mark)
