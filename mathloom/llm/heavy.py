"""Most frequent items in bounded memory (problem 2).

Each task keeps a Misra-Gries summary of at most ``capacity`` counters.  A batch of rows is
counted by Arrow, added to the summary, and the next-largest counter (the one after the last
that fits) is subtracted from all; what falls to zero goes.  Summaries merge by the same rule
in a tree of fixed fan-in.  After n rows any count is low by at most n / (capacity + 1), so
every item above that share is among the counters, whatever the order or the partitioning.

Defined results: NULL values count neither as items nor as rows; the empty text is an item;
a tie at the next-largest counter removes all items of that count; an empty input gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.runtime import cut

#: A summary's rows: counters, and one with item NULL that holds the rows seen and the most that was subtracted.
SUMMARY = "field_name string, node bigint, item string, kept bigint, seen bigint, lost bigint"
_SCHEMA = pa.schema([("field_name", pa.string()), ("node", pa.int64()), ("item", pa.string()), ("kept", pa.int64()), ("seen", pa.int64()), ("lost", pa.int64())])
FAN_IN = 32


class Summary:
    """A Misra-Gries summary: ``items`` and ``kept`` counters, rows ``seen``, most ``lost`` by any item."""

    def __init__(self, capacity: int):
        self.capacity, self.seen, self.lost = capacity, 0, 0
        self.items, self.kept = pa.array([], pa.string()), pa.array([], pa.int64())

    def add(self, items: pa.Array, counts: pa.Array, seen: int, lost: int = 0) -> None:
        """Add counters, those of another summary or exact ones of a batch."""
        self.seen += seen
        self.lost += lost
        both = pa.table({"item": pa.chunked_array([self.items, items], pa.string()), "n": pa.chunked_array([self.kept, counts], pa.int64())})
        both = both.group_by("item").aggregate([("n", "sum")])
        n = both["n_sum"]
        if len(both) > self.capacity:
            next_largest = n.take(pc.select_k_unstable(n, self.capacity + 1, [("", "descending")])[-1:])[0].as_py()
            both = both.filter(pc.greater(n, next_largest))
            n = pc.subtract(both["n_sum"], next_largest)
            self.lost += next_largest
        self.items, self.kept = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (both["item"], n))

    def rows(self, field: str, node: int) -> pa.RecordBatch:
        k = len(self.items)
        columns = ([field] * (k + 1), [node] * (k + 1), pa.concat_arrays([self.items, pa.nulls(1, pa.string())]), pa.concat_arrays([self.kept, pa.array([0], pa.int64())]), [0] * k + [self.seen], [0] * k + [self.lost])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _summarise(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by: dict[str, Summary] = {}
        for batch in batches:
            fields = batch.column(0)
            for field in pc.unique(fields).to_pylist():
                values = batch.column(1).filter(pc.equal(fields, field)).drop_null()
                counts = pc.value_counts(values)
                by.setdefault(field, Summary(capacity)).add(counts.field(0), counts.field(1), len(values))
        for field, summary in by.items():
            yield summary.rows(field, TaskContext.get().partitionId())

    return run


def _merged(capacity: int, group: pa.Table) -> Summary:
    """One summary of those in ``group``, added batch by batch."""
    merged = Summary(capacity)
    for batch in group.combine_chunks().to_batches():
        meta = pc.is_null(batch.column("item"))
        counters, totals = batch.filter(pc.invert(meta)), batch.filter(meta)
        merged.add(counters.column("item"), counters.column("kept"), pc.sum(totals.column("seen")).as_py() or 0, pc.sum(totals.column("lost")).as_py() or 0)
    return merged


def _merge(capacity: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_merged(capacity, group).rows(key[0].as_py(), key[1].as_py())], _SCHEMA)

    return run


def _finish(capacity: int, share: float):
    """The last merge: the items that may have the share, each with the bound of its error and the rows seen."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        s = _merged(capacity, group)
        low, n = s.kept.to_pylist(), max(s.seen, 1)
        keep = pa.array([(k + s.lost) / n >= share for k in low], pa.bool_())
        items, kept = s.items.filter(keep), s.kept.filter(keep)
        return pa.table({"field_name": pa.array([key[0].as_py()] * len(items), pa.string()), "item": items, "approx_count": kept, "max_error": pa.array([s.lost] * len(items), pa.int64()), "seen_rows": pa.array([s.seen] * len(items), pa.int64())})

    return run


def frequent_items(rows: DataFrame, share: float = 0.01, capacity: int | None = None) -> DataFrame:
    """Items of rows (field_name, item) that may be held by at least ``share`` of a field's non-NULL rows.

    Columns: field_name, item, approx_count (at most the true count), max_error (the true count
    is at most approx_count + max_error), seen_rows.  No item of that share is missing.  A
    summary holds ``capacity`` counters, ten for each item there can be unless given.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    capacity = capacity or round(10 / share)
    if capacity * share < 1:
        raise ValueError("capacity is too small for the share")
    rows = rows.select("field_name", "item").where("item IS NOT NULL")
    # The summaries are written once; their partitions, those of the rows, tell how deep the tree is.
    level = cut(rows.mapInArrow(_summarise(capacity), SUMMARY))
    parts = level.rdd.getNumPartitions()
    # A group holds at most FAN_IN summaries, that is FAN_IN * (capacity + 1) rows.
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("bigint"))
        level = level.groupBy("field_name", "node").applyInArrow(_merge(capacity), SUMMARY)
    return level.groupBy("field_name").applyInArrow(_finish(capacity, share), "field_name string, item string, approx_count bigint, max_error bigint, seen_rows bigint")


def exact_frequent(rows: DataFrame, share: float = 0.01, capacity: int | None = None) -> DataFrame:
    """(field_name, item, n, seen_rows) of the items with at least ``share`` of a field's rows, counted exactly.

    Only rows whose hash is among the candidates' are counted.  There are at most
    1 / (share - 1 / (capacity + 1)) candidates a field, of which only 8-byte hashes are broadcast.
    """
    candidates = cut(frequent_items(rows, share, capacity))  # used twice, found once
    hashes = candidates.select("field_name", F.xxhash64("item").alias("h"))
    rows = rows.select("field_name", "item").where("item IS NOT NULL").withColumn("h", F.xxhash64("item"))
    counted = rows.join(F.broadcast(hashes), ["field_name", "h"], "left_semi").groupBy("field_name", "item").agg(F.count("*").alias("n"))
    return counted.join(candidates.select("field_name", "item", "seen_rows"), ["field_name", "item"]).where(F.col("n") / F.col("seen_rows") >= share)
