"""Mixing sources to target weights (problem 7).

Sizes are tokens of a public tokenizer.  A source whose share needs more than it holds is
repeated whole; the rest comes from the documents whose hash is under the source's threshold.
A histogram of tokens by source and hash bucket shows the bucket in which a source's budget
runs out; only that bucket is split by further bits of the hash, until what is left of it is
one hash value or within the tolerance.  The thresholds are nested: a smaller budget of the
same source takes a subset of the same documents.  Nothing is sorted.

The size of the mixture is the largest at which no source needs more than ``max_repeats``
copies of its documents, unless a smaller one is asked for.  Sources without a document can
give nothing: the shares of the others keep their proportions and the report shows the gap.

Defined results: documents with a NULL source, of a source without a target, or with a NULL or
empty text are not used; targets that are NULL or not positive count as no target, a NULL
``max_repeats`` as 1; a source listed twice has the sum of its shares and the least of its
``max_repeats``; of documents with equal hashes of their ids all or none are taken.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mathloom.runtime import cut, spread

TOKENIZER = os.environ.get("MATHLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
try:
    from public_tokenizers import PATTERN
except ImportError:
    # Fixed value: the pattern that splits text before the merges of the rank files.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash that one histogram tells apart, and bits in all.
BITS, ALL_BITS = 12, 60
SIZED = "doc_id bigint, source string, tokens bigint"
_encodings: dict[tuple[str, str], object] = {}


def _served(spark: SparkSession, path: str) -> str:
    """The name under which executors fetch the file of ranks from the driver, which alone needs to have it."""
    if not os.path.exists(path):  # the same file where the vocabularies are a package
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a file of ranks, loaded once in each worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def _tokens(name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encode = encoding(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(x.as_py())) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["doc_id", "source", "tokens"])

    return run


def sized(documents: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens) of documents (doc_id, source, text) that have a source and a text."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").where("source IS NOT NULL AND text <> ''")
    return spread(docs).mapInArrow(_tokens(_served(documents.sparkSession, path), pattern), SIZED)


def _place() -> Column:
    """A document's place: ``ALL_BITS`` bits of the hash of its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixture"), "doc_id"), 64 - ALL_BITS)


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row a source, which is broadcast; ``mixture`` bounds how many there are."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _histogram(rows: DataFrame, bits: int) -> DataFrame:
    """Tokens by source and bucket, a bucket being the ``BITS`` bits of the place after the first ``bits``."""
    bucket = F.shiftrightunsigned("place", ALL_BITS - bits - BITS).bitwiseAND(2**BITS - 1)
    return rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"))


def thresholds(sizes: DataFrame, budgets: dict[str, float], tolerance: float = 1e-4, first: DataFrame | None = None) -> dict[str, int]:
    """By source, the place under which its documents hold as near to its budget as the tolerance asks.

    ``first`` is the histogram of the first bits, if it is there.  A round reads only the documents of the boundary buckets, sums them by source and bucket and
    finds the next boundary by running sums over the at most 2**BITS buckets of each source;
    one row a source comes to the driver.
    """
    # Of a source: the prefix that the bits fixed so far form, and the tokens under it.
    state = {s: (0, 0) for s, b in budgets.items() if b > 0}
    done = {s: 0 for s, b in budgets.items() if b <= 0}
    for bits in range(0, ALL_BITS, BITS):
        if not state:
            break
        asked = _local(sizes.sparkSession, [(s, *x, float(budgets[s])) for s, x in state.items()], "source string, prefix bigint, under bigint, budget double")
        if bits:
            counted = _histogram(sizes.join(asked, "source").where(F.shiftrightunsigned("place", ALL_BITS - bits) == F.col("prefix")), bits)
        else:
            counted = _histogram(sizes, 0) if first is None else first
        histogram = counted.join(asked, "source")
        upto = F.col("under") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        beyond = F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("under"), "n"))
        found = {r.source: r.b for r in histogram.withColumn("upto", upto).groupBy("source").agg(F.min(beyond).alias("b")).collect()}
        for source, (prefix, _) in [*state.items()]:
            boundary, budget = found.get(source), budgets[source]
            if boundary is None:  # the budget takes all of the bucket
                done[source] = (prefix + 1) << (ALL_BITS - bits)
            else:
                prefix, left = (prefix << BITS) + boundary.bucket, budget - boundary.under
                if bits + BITS < ALL_BITS and left > tolerance * budget:
                    state[source] = (prefix, boundary.under)
                    continue
                # The boundary bucket is left out, or taken if that comes nearer.
                done[source] = (prefix + (boundary.n - left < left)) << (ALL_BITS - bits - BITS)
            del state[source]
    return done


def _wanted(targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, int]]:
    """By source the sum of its positive shares and the least of its ``max_repeats``."""
    wanted: dict[str, tuple[float, int]] = {}
    for source, share, most in targets:
        if source is not None and share is not None and share > 0:
            old = wanted.get(source, (0.0, None))
            most = 1 if most is None else most
            wanted[source] = (old[0] + share, most if old[1] is None else min(most, old[1]))
    return wanted


def plan(sizes: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, tolerance: float = 1e-4) -> dict[str, dict]:
    """By source with a target: target_share, max_repeats, available and budget tokens, whole copies, threshold."""
    wanted = _wanted(targets)
    if not wanted:
        return {}
    named = _local(sizes.sparkSession, [(s,) for s in wanted], "source string")
    # The first histogram, of 2**BITS rows a source at most, also tells what each source holds.
    first = cut(_histogram(sizes.join(named, "source", "left_semi"), 0))
    held = {r.source: r.n for r in first.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    usable = {s: x for s, x in wanted.items() if held.get(s) and x[1] > 0}
    shares = sum(x[0] for x in usable.values())
    largest = min((most * held[s] / (share / shares) for s, (share, most) in usable.items()), default=0)
    total = largest if total is None else min(total, largest)
    result = {s: {"target_share": share, "max_repeats": most, "available_tokens": held.get(s, 0), "budget": total * share / shares if s in usable else 0.0} for s, (share, most) in wanted.items()}
    for r in result.values():
        # The least of max_repeats times what is there may come out a hair above it.
        r["copies"] = min(int(r["budget"] // r["available_tokens"]), r["max_repeats"]) if r["budget"] else 0
    rest = {s: r["budget"] - r["copies"] * r["available_tokens"] if r["copies"] < r["max_repeats"] else 0.0 for s, r in result.items()}
    for source, threshold in thresholds(sizes, rest, tolerance, first).items():
        result[source]["threshold"] = threshold
    return result


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, tolerance: float = 1e-4, path: str = TOKENIZER, pattern: str = PATTERN, most_sources: int = 100_000) -> tuple[DataFrame, dict[str, dict]]:
    """The mixture (doc_id, source, tokens, repeats) and the plan it follows.

    ``total`` is the size in tokens, by default the largest possible.  The targets, of which
    there may be ``most_sources``, go to the driver; only documents of their sources are read on.  The documents' sizes are written once.
    """
    rows = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    spark, asked = documents.sparkSession, [tuple(r) for r in rows]
    named = _local(spark, [(s,) for s in _wanted(asked)], "source string")
    sizes = cut(sized(documents.join(named, "source", "left_semi"), path, pattern).withColumn("place", _place()))
    by = plan(sizes, asked, total, tolerance)
    planned = _local(spark, [(s, r["copies"], r["threshold"]) for s, r in by.items()], "source string, copies int, threshold bigint")
    mixed = sizes.join(planned, "source").withColumn("repeats", F.col("copies") + (F.col("place") < F.col("threshold")).cast("int"))
    return mixed.where("repeats > 0").select("doc_id", "source", "tokens", "repeats"), by


def shares(mixed: DataFrame, by: dict[str, dict]) -> DataFrame:
    """Per source with a target: tokens reached, share reached and wanted, documents and the most copies of one."""
    spark = mixed.sparkSession
    rows = [(s, r["target_share"], r["max_repeats"], r["available_tokens"]) for s, r in sorted(by.items())]
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens bigint")
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    full = wanted.join(used, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return full.withColumn("share", F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0))
