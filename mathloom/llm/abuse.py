"""Abusive, hateful or sexual content (problem 8).

A linear classifier of character n-grams scores windows of a document; a document's score is
that of its worst window, so a threat in a long text counts in full.  Features are scaled by
naive Bayes log-count ratios, and a logistic regression learns one weight for each scaled
feature.

Ratings hold for whole documents and some are wrong.  So the ratios of one part of the sample,
counted on the other parts, pick the most suspicious window of each of its documents: a
document rated toxic is a positive example only if its window stands out from those of the
documents rated clean.  In the second round the classifier itself picks the windows: those of
documents rated toxic that it finds toxic, and as hard negative examples the worst windows of the
documents rated clean.

All work on whole texts - counting n-grams, looking for the worst windows, scoring - is spread
over tasks that take texts in pieces of bounded length.  Only windows of some fifty characters go
to the one task that learns weights.  The sample is bounded: at most about ``MOST_TOXIC`` and ``MOST_CLEAN``
documents of either kind, of the latter the windows of the ``HARD`` worst and ``HARD`` others; scoring covers every
document and its whole text.

The level from which documents are flagged is set on held-out ratings (``level_of``).

Defined results: a NULL text has the score NULL and is not flagged; a text that shows
nothing, such as an empty one, has the score BIAS; a document rated differently by different people, or not at all, trains nothing;
without ratings of both kinds, or with fewer than 2 * FOLDS in all, no document is flagged and all scores are BIAS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm.visual import BASE, Forms, forms_for
from mathloom.runtime import cut, spread

#: Most rated documents of either kind in the sample, taken by the hash of their ids.
MOST_TOXIC, MOST_CLEAN = 8_000, 40_000
#: Windows of clean documents that are learned from, the worst and as many others.
HARD = 5_000
BITS, LENGTHS, WINDOW, FOLDS, TURNS = 20, (2, 3, 4, 5), 48, 4, 2
#: Weight of the class-wide rate in a log-count ratio.
PRIOR = 4.0
#: Logit of a window that shows nothing; it is not learned, so that short texts, which show little,
#: stay below the level.
BIAS = -6.0
#: Characters of a piece of text that is taken at once.
PIECE = 1_000_000

# Digits and signs written for the letters they look like.
_LEET = str.maketrans("4310571@$!", "aeiostiasi")
_spelled = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[.\-_*][^\W\d_]){2,}(?![^\W\d_])")
_may_be_spelled = re.compile(r"[.\-_*].[.\-_*]")
_repeated = re.compile(r"([^\W\d_])\1{2,}")
_digits = re.compile(r"\d+")


def _plain_word(word: str) -> str:
    """``word`` with letters for the digits and signs in it, if at least half of it is letters, no letter more than twice in a row, and 0 for any number."""
    core = word.rstrip("!?.,;:")
    if 2 * sum(map(str.isalpha, core)) >= len(core):
        word = core.translate(_LEET) + word[len(core) :]
    return _digits.sub("0", _repeated.sub(r"\1", word))


class _Words(dict):
    """Words met by a worker with their plain form, up to a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        plain = _plain_word(word)
        if len(word) < 100:
            self[word] = plain
        return plain


_words = _Words()


def plain_text(text: str, forms: Forms = BASE) -> str:
    """``text`` in lower case without the usual disguises: look-alikes, digits for letters, spelling out, repetition."""
    text = forms.one_form(text).lower()
    if _may_be_spelled.search(text):
        text = _spelled.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)
    return " " + " ".join(map(_words.__getitem__, text.split())) + " "


class Texts:
    """Texts one after another, with the hashed n-grams that begin at each character.

    ``first`` and ``size`` are where each begins and how long it is; n-grams that reach over an
    end have the number 2**BITS, which no weight is given to.
    """

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.size)
        self.first = ends - self.size
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.grams: list[np.ndarray] = []
        run = code.copy()
        with np.errstate(over="ignore"):
            for n in range(2, max(LENGTHS) + 1):
                run = (run[:-1] * np.uint64(0x100000001B3)) ^ (code[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
                if n in LENGTHS:
                    ids = np.full(len(code), 2**BITS, np.int32)
                    ids[: len(run)] = ((run * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)
                    for k in range(1, n):
                        ids[(ends - k)[self.size >= k]] = 2**BITS
                    self.grams.append(ids)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text and feature, each pair once, in order; for windows, as it takes a table as wide as the longest text."""
        width = int(self.size.max(initial=0))
        which = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(which)) - np.repeat(self.first, self.size)
        table = np.full((len(self.size), width * len(self.grams)), 2**BITS, np.int32)
        for n, ids in enumerate(self.grams):
            table[which, place + n * width] = ids
        table.sort(axis=1)
        kept = table < 2**BITS
        kept[:, 1:] &= table[:, 1:] != table[:, :-1]
        return np.nonzero(kept)[0], table[kept]

    def worst_windows(self, weights: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights of the n-grams that begin in the worst window of each text, and where in it that begins, if ``places`` are asked for."""
        weights = np.append(weights, np.float32(0))
        value = np.zeros(int(self.size.sum()))
        for ids in self.grams:
            value += weights[ids]
        sums = np.concatenate(([0.0], np.cumsum(value)))
        window = sums[np.minimum(np.arange(len(value)) + WINDOW, len(value))] - sums[:-1]
        short = self.size <= WINDOW
        score, begin = np.zeros(len(self.size)), np.zeros(len(self.size), np.int64)
        score[short] = sums[(self.first + self.size)[short]] - sums[self.first[short]]
        if not short.all():
            at = self.first[~short]
            # Every other sum of reduceat is over what lies between the starts of two texts' windows.
            bounds = np.stack([at, at + (self.size[~short] - WINDOW + 1)], axis=1).ravel()
            best = np.maximum.reduceat(window, bounds[:-1])[::2] if bounds[-1] >= len(value) else np.maximum.reduceat(window, bounds)[::2]
            score[~short] = best
            if not places:
                return score, begin
            inside = np.repeat(best, self.size[~short] - WINDOW + 1)
            starts = np.repeat(at - np.cumsum(np.append(0, self.size[~short] - WINDOW + 1))[:-1], self.size[~short] - WINDOW + 1) + np.arange(len(inside))
            of = np.repeat(np.arange(len(at)), self.size[~short] - WINDOW + 1)
            hits = np.flatnonzero(window[starts] == inside)
            owners, where = np.unique(of[hits], return_index=True)
            found = np.zeros(len(at), np.int64)
            found[owners] = starts[hits[where]] - at[owners]
            begin[~short] = found
        return score, begin


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of pieces of texts, some ``PIECE`` characters each: which text, at which character, the piece.

    Pieces of one text overlap by a window and the n-grams that begin in it.
    """
    which, starts, group, size = [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text)), PIECE):
            piece = text[start : start + PIECE + WINDOW + max(LENGTHS)]
            which.append(i)
            starts.append(start)
            group.append(piece)
            size += len(piece)
            if size >= PIECE:
                yield which, starts, group
                which, starts, group, size = [], [], [], 0
    if group:
        yield which, starts, group


def worst_scores(texts: list[str], models: list[np.ndarray]) -> np.ndarray:
    """Score of the worst window of each text by each model, a row a model; n-grams are hashed once."""
    scores = np.full((len(models), len(texts)), -np.inf)
    for which, starts, group in _pieces(texts):
        use = [k for k, (start, piece) in enumerate(zip(starts, group, strict=True)) if start == 0 or len(piece) > WINDOW + max(LENGTHS)]
        grams, owner = Texts(group), np.array(which)[use]
        for row, weights in zip(scores, models, strict=True):
            np.maximum.at(row, owner, np.round(grams.worst_windows(weights, False)[0], 6)[use])
    return scores


def worst_windows(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Score of the worst window of each text, and the window's text, n-grams that begin in it included."""
    scores, windows = np.full(len(texts), -np.inf), [""] * len(texts)
    for which, starts, group in _pieces(texts):
        found, at = Texts(group).worst_windows(weights)
        # Sums over many texts differ in the last digits by what stands before a text.
        for i, start, piece, score, place in zip(which, starts, group, np.round(found, 6).tolist(), at.tolist(), strict=True):
            if score > scores[i] and (start == 0 or len(piece) > WINDOW + max(LENGTHS)):
                scores[i], windows[i] = score, piece[place : place + WINDOW + max(LENGTHS) - 1]
    return scores, windows


def gram_counts(texts: list[str], rows: list[int], n: int) -> np.ndarray:
    """How often each feature occurs in the texts of each of ``n`` rows."""
    counts = np.zeros((n, 2**BITS + 1), np.float32)
    for row in sorted(set(rows)):
        for _, _, group in _pieces([t for t, r in zip(texts, rows, strict=True) if r == row]):
            # Where pieces of a text overlap, some fifty characters count twice.
            counts[row] += np.bincount(np.concatenate(Texts(group).grams), minlength=2**BITS + 1)
    return counts[:, :-1]


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature, 0 where nothing is known."""
    return (np.log((toxic + PRIOR * rate) / (clean + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))).astype(np.float32)


def logistic(rows: np.ndarray, ids: np.ndarray, toxic: np.ndarray, often: np.ndarray, ratios: np.ndarray, steps: int = 80) -> np.ndarray:
    """Weights of a logistic regression on features scaled by ``ratios``, by full-batch AdaGrad.

    ``rows`` and ``ids`` are the features of each example, in order; ``often`` is how often an example stands
    in the sample.  Only features that occur are carried.
    """
    known = np.flatnonzero(np.bincount(ids, minlength=2**BITS))
    place = np.zeros(2**BITS, np.int32)
    place[known] = np.arange(len(known))
    ids, scale = place[ids], ratios[known]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    kept = rows[starts]
    y, often = toxic[kept].astype(np.float32), often[kept].astype(np.float32)
    size = np.diff(np.append(starts, len(rows)))
    rate = float((y * often).sum() / often.sum())
    cost = np.where(y > 0, 0.15 / max(rate, 1e-9), 1.0) * often / often.sum()
    start = 0.1
    v, seen = np.full(len(known), start), np.full(len(known), 1e-8)
    for _ in range(steps):
        z = np.add.reduceat((scale * v)[ids], starts) + BIAS
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        slope = scale * np.bincount(ids, np.repeat(error, size), len(known)) + 1e-6 * (v - start)
        seen += slope**2
        v -= 0.05 * slope / np.sqrt(seen)
    weights = np.zeros(2**BITS, np.float32)
    weights[known] = scale * v
    return weights


def learned(windows: list[str], toxic: list[bool], steps: int = 80) -> np.ndarray | None:
    """Weights from windows and their ratings, or None without a toxic one; equal examples are taken together."""
    counted: dict[tuple[str, bool], int] = {}
    for w, y in zip(windows, toxic, strict=True):
        if w.strip():
            counted[w, bool(y)] = counted.get((w, bool(y)), 0) + 1
    examples = sorted(counted)
    y, often = np.array([t for _, t in examples], bool), np.array([counted[e] for e in examples])
    if not y.any() or y.all():
        return None
    rows, ids = Texts([w for w, _ in examples]).features()
    counts = [np.bincount(ids[mine[rows]], often[rows[mine[rows]]], 2**BITS) for mine in (y, ~y)]
    rate = float(often[y].sum() / often.sum())
    return logistic(rows, ids, y, often, log_count_ratios(*counts, rate), steps)


def level_of(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The logit from which documents are flagged, given held-out scores.

    Wrong ratings are missed by any sensible level, so of the levels that miss hardly more ratings than the
    best does, the one in the middle of the widest gap between scores is taken.
    """
    steps = np.unique(scores)
    bad, clean = np.sort(scores[toxic]), np.sort(scores[~toxic])
    # What a level just above each step misses.
    missed = np.searchsorted(bad, steps, "right") + len(clean) - np.searchsorted(clean, steps, "right")
    gaps = np.append(np.diff(steps), 0.0)
    gaps[missed > missed.min() + 0.01 * len(bad)] = -1.0
    widest = int(gaps.argmax())
    return float(steps[widest] + gaps[widest] / 2)


def _stands_out(score: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Windows, picked by ratios, that few of those rated clean are as suspicious as.

    A small sample repeats little, so fewer of its toxic windows stand out far.
    """
    for level in (0.995, 0.95, 0.8, 0.0):
        far = score >= np.quantile(score[~toxic], level)
        if 3 * (far & toxic).sum() >= toxic.sum():
            break
    return far


def examples(toxic: np.ndarray, score: np.ndarray, window: list[str], other: list[str], stands_out: np.ndarray) -> tuple[list[str], list[bool]]:
    """The windows to learn from: toxic ones that stand out, the worst of the clean ones, and others of clean documents."""
    clean = np.flatnonzero(~toxic)
    hard = clean[np.argsort(-score[clean], kind="stable")][:HARD]
    rest = np.random.default_rng(7).permutation(clean)[:HARD]
    bad = np.flatnonzero(stands_out & toxic)
    return [window[i] for i in (*bad, *hard)] + [other[i] for i in rest], [True] * len(bad) + [False] * (len(hard) + len(rest))


def rated_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, fold, text) of the sample, plain texts: about MOST_TOXIC and MOST_CLEAN documents at most.

    The hash of its id alone decides about a document: of either kind the share of the hashes
    is kept that holds as many as wanted.
    """
    rated = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    rated = rated.where("low = high").select("doc_id", (F.col("high") > 0).alias("y"), F.pmod(F.xxhash64(F.lit("rated"), "doc_id"), F.lit(1_000_000)).alias("h"))
    held = {r.y: r["count"] for r in rated.groupBy("y").count().collect()}
    keep = {y: min(1.0, most / held[y]) * 1e6 if held.get(y) else 0.0 for y, most in ((True, MOST_TOXIC), (False, MOST_CLEAN))}
    sample = rated.where(F.col("h") < F.when(F.col("y"), keep[True]).otherwise(keep[False])).select("doc_id", "y")
    forms = forms_for(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([plain_text(x, forms) for x in batch.column(3).to_pylist()], pa.string())], names=["doc_id", "y", "fold", "text"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    # About MOST_TOXIC + MOST_CLEAN ids of 8 bytes.
    return docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", fold, "text").mapInArrow(run, "doc_id bigint, y boolean, fold int, text string")


_WINDOWS = "doc_id bigint, y boolean, fold int, score double, window string, other string"
Batches = Iterator[pa.RecordBatch]


def _ratios(sample: DataFrame) -> np.ndarray | None:
    """For each fold the ratios counted on the others: counts are summed in one task, a row of features a fold and kind."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            rows = [2 * f + y for f, y in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            for row, counts in enumerate(gram_counts(batch.column("text").to_pylist(), rows, 2 * FOLDS)):
                ids = np.flatnonzero(counts).astype(np.int32)
                columns = [pa.array([row]), pa.array([rows.count(row)]), pa.array([ids.tobytes()], pa.binary()), pa.array([counts[ids].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "texts", "ids", "counts"])

    def total(batches: Batches) -> Batches:
        counts, texts = np.zeros((FOLDS, 2, 2**BITS), np.float32), np.zeros((FOLDS, 2))
        for batch in batches:
            for row, n, ids, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[row // 2, row % 2, np.frombuffer(ids, np.int32)] += np.frombuffer(k, np.float32)
                texts[row // 2, row % 2] += n
        if texts.sum() < 2 * FOLDS or not texts.sum(axis=0).all():
            return
        for fold in range(FOLDS):
            (clean, toxic), (n, m) = counts.sum(axis=0) - counts[fold], texts.sum(axis=0) - texts[fold]
            rate = min(max(m / max(n + m, 1), 1e-6), 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([log_count_ratios(toxic, clean, rate).tobytes()], pa.binary())], names=["fold", "ratios"])

    counted = sample.mapInArrow(count, "row bigint, texts bigint, ids binary, counts binary").repartition(1)
    rows = sorted((r.fold, bytes(r.ratios)) for r in counted.mapInArrow(total, "fold bigint, ratios binary").collect())
    return np.stack([np.frombuffer(r, np.float32) for _, r in rows]) if rows else None


def _windows(sample: DataFrame, models: np.ndarray) -> DataFrame:
    """The worst window of each document of the sample by the model of its fold, and another one that its id decides."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, folds, texts = (batch.column(c).to_pylist() for c in ("doc_id", "fold", "text"))
            score, window = np.zeros(len(ids)), [""] * len(ids)
            for fold in {f % len(shared.value) for f in folds}:
                mine = [i for i, f in enumerate(folds) if f % len(shared.value) == fold]
                found, at = worst_windows([texts[i] for i in mine], shared.value[fold])
                score[mine] = found
                for i, w in zip(mine, at, strict=True):
                    window[i] = w
            starts = [i * 2654435761 % max(1, len(t) - WINDOW) for i, t in zip(ids, texts, strict=True)]
            other = [t[a : a + WINDOW + max(LENGTHS) - 1] for t, a in zip(texts, starts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), pa.array(window, pa.string()), pa.array(other, pa.string())], names=["doc_id", "y", "fold", "score", "window", "other"])

    return sample.mapInArrow(run, _WINDOWS)


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    group = group.sort_by("doc_id")
    return np.array(group["y"].to_pylist(), bool), np.array(group["score"].to_pylist()), group["window"].to_pylist(), group["other"].to_pylist()


def _learn(windows: DataFrame, first: bool, parts: int) -> list[np.ndarray] | None:
    """Weights learned from all windows and, with ``parts`` of 3, from either half of the folds, each in its own task."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        toxic, score, window, other = _columns(group)
        weights = None
        if toxic.any() and not toxic.all():
            weights = learned(*examples(toxic, score, window, other, _stands_out(score, toxic) if first else score + BIAS > 0), 80 if parts > 1 and key[0].as_py() == 0 else 40)
        rows = [] if weights is None else [weights.tobytes()]
        return pa.table({"part": pa.array([key[0].as_py()] * len(rows), pa.int32()), "weights": pa.array(rows, pa.binary())})

    # Part 0 learns from all, part 1 from odd folds, to be held against the even ones, part 2 the other way round.
    part = F.explode(F.array(F.lit(0), F.lit(2) - F.col("fold") % 2) if parts == 3 else F.array(F.lit(0))).alias("part")
    found = windows.select("*", part).groupBy("part").applyInArrow(run, "part int, weights binary").collect()
    by = {r.part: np.frombuffer(bytes(r.weights), np.float32) for r in found}
    return [by.get(p, by[0]) for p in range(parts)] if 0 in by else None


def _level(sample: DataFrame, weights: list[np.ndarray]) -> float:
    """The lower of the level on held-out scores and that on the scores of the final weights.

    The first knows what is not learned by heart, but has the scale of weights that half the sample taught; of a small
    sample the second is too high.
    """
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Batches) -> Batches:
        for batch in batches:
            own, odd, even = worst_scores(batch.column("text").to_pylist(), shared.value)
            # Part 1 learned from odd folds, part 2 from even ones.
            held = np.where(batch.column("fold").to_numpy() % 2 == 0, odd, even)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(held), pa.array(own)], names=["doc_id", "y", "held", "own"])

    def run(batches: Batches) -> Batches:
        rows = pa.Table.from_batches(batches).sort_by("doc_id")
        toxic = np.array(rows["y"].to_pylist(), bool)
        level = min(level_of(rows[c].to_numpy() + BIAS, toxic) for c in ("held", "own"))
        yield pa.RecordBatch.from_arrays([pa.array([level])], names=["level"])

    both = sample.mapInArrow(score, "doc_id bigint, y boolean, held double, own double")
    return both.repartition(1).mapInArrow(run, "level double").first().level


def fitted(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and the level from which documents are flagged; None if the ratings teach nothing."""
    sample = cut(rated_sample(documents, labels))
    models, weights = _ratios(sample), None
    for turn in range(TURNS):
        if models is None:
            return None
        weights = _learn(_windows(sample, models), turn == 0, 3 if turn == TURNS - 1 else 1)
        models = None if weights is None else np.stack(weights[:1])
    if weights is None:
        return None
    return weights[0], _level(sample, weights)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document (doc_id, text, source); the score is a logit."""
    known = fitted(documents, labels)
    weights, level = known or (np.zeros(2**BITS, np.float32), np.inf)
    forms = forms_for(documents.sparkSession)
    # A fixed 2**BITS numbers of 4 bytes.
    model = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column(2)
            plain = [plain_text(t, forms) for t in texts.drop_null().to_pylist()]
            scores = np.full(len(texts), np.nan)
            scores[texts.is_valid().to_numpy(zero_copy_only=False)] = worst_scores(plain, [model.value])[0] + BIAS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64(), from_pandas=True), pa.array(scores > level)], names=["doc_id", "source", "score", "flagged"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return spread(docs).mapInArrow(run, "doc_id bigint, source string, score double, flagged boolean")


def source_rates(scores: DataFrame) -> DataFrame:
    """Per source, NULL included: documents, flagged ones, their share and the mean score."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), (F.count_if("flagged") / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
