"""Graded quality by ordinal cumulative-link regression on hashed text.

Labels become grades: 0 for toxic, 1 for low quality, 2 for good. One set of weights over
hashed features gives a text's score, and ordered thresholds turn it into grades:

    P(grade > k) = 1 / (1 + exp(threshold k - score))

so the weights are shared by all grades. Toxic texts come last: held out, that order tells them apart better than
one with low quality last. Features are the different
words of a text, their beginnings of several lengths, beginnings that several of its words share, and
properties of the whole text, each as all the steps up to its value. The expected grade ranks texts; the
tail probability, that of the best grade, selects them.

The model is fitted on a sample of at most SAMPLE_ROWS labelled rows, the first by a hash of
their id; nothing else is sampled. Every text is read whole.

A label with a null id is none; one with a null rating counts if the other rating tells its grade. A text with
several labels has the lowest. A null text is an empty one. Without labels every text is kept. Repeated rows
stay, each with its own result. Of the documents ``doc_id`` and ``text`` are read. No rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakejobs.llm.shared import saved

SAMPLE_ROWS = 10_000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
GRADES = 3
LEAST_ROWS = 5
# Chi-squared of a feature over the grades, from which it is used.
LEAST_CHI2 = 30.0
STEPS, STEP_SIZE, RIDGE = 600, 0.1, 3e-5
# Bytes of the beginnings of words.
STEMS = range(4, 9)
# Up to the square of this number of different words, a feature counts in full.
FULL_VALUE = 8
KEEP_FROM = 0.5
# Words a task keeps the features of, when it needs all features and when it needs those in use.
KEPT_ALL, KEPT_USED = 60_000, 300_000
NOTHING: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
EDGES = b".,;:!?\"'()[]{}#*$%&|<>-_/\\"
CAPITALS = bytes(range(65, 91))


class Words(dict):
    """The features of each word without the marks around it, and the hashes of beginnings that are to be counted.

    ``used`` tells which features are of use; without it all are.
    """

    def __init__(self, used: np.ndarray | None = None) -> None:
        super().__init__()
        self.used = None if used is None else frozenset(np.flatnonzero(used).tolist())
        self.most = KEPT_ALL if used is None else KEPT_USED

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        bare = word.strip(EDGES)
        own = [xxhash.xxh64_intdigest(bare) % BUCKETS]
        stems = [xxhash.xxh64_intdigest(bare[:size], size) for size in STEMS if len(bare) > size]
        own += [h % BUCKETS for h in stems]
        if self.used is not None:
            own = [b for b in own if b in self.used]
            stems = [h for h in stems if not self.used.isdisjoint(several(h, 4))]
        if len(self) >= self.most:
            self.clear()
        # Words without features share one value.
        self[word] = value = (tuple(own), tuple(stems)) if own or stems else NOTHING
        return value


def several(stem: int, words: int) -> list[int]:
    """The features of a beginning that two, or four, and more different words of a text share."""
    two, four = stem >> BUCKET_BITS & BUCKETS - 1, stem >> 2 * BUCKET_BITS & BUCKETS - 1
    return [two, four] if words >= 4 else [two] if words >= 2 else []


def step(share: float) -> int:
    """Shares from none to twice and more, in steps of a half power of two."""
    return 0 if share <= 0 else max(1, min(18, int(2 * np.log2(share) + 16)))


@lru_cache(maxsize=4096)
def up_to(name: bytes, reached: int) -> list[int]:
    return [xxhash.xxh64_intdigest(b"\0%s %d" % (name, k)) % BUCKETS for k in range(reached + 1)]


def of_text(text: bytes | None, known: Words) -> tuple[np.ndarray, float]:
    """The features of a text and their common value."""
    text = text or b""
    words = text.lower().split()
    different = set(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    whole = {
        b"marks": step(sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / n),
        b"bars": step(text.count(b"|") / n),
        b"shouts": step(text.count(b"!") / n),
        b"capitals": step(4 * (size - len(text.translate(None, CAPITALS))) / size),
        b"lines": step(2 - 2 * len(set(lines)) / max(1, len(lines))),
        b"words": step(2 * len(different) / n),
        b"length": n.bit_length(),
    }
    found: set[int] = set()
    stems: Counter[int] = Counter()
    for own, shared in map(known.__getitem__, different):
        if own:
            found.update(own)
        if shared:
            stems.update(shared)
    for stem, count in stems.items():
        found.update(several(stem, count))
    for name, reached in whole.items():
        found.update(up_to(name, reached))
    # In order, so that sums of floats and comparisons do not depend on the order of a set.
    return np.array(sorted(found), np.int64), min(1.0, FULL_VALUE / np.sqrt(max(1, len(different))))


def grades(labels: DataFrame) -> DataFrame:
    quality, toxic = F.col("quality"), F.col("toxic")
    grade = F.when(toxic >= 1, 0).when(quality <= 0, 1).when((quality >= 1) & (toxic <= 0), 2)
    told = labels.select(F.col("doc_id").cast("long").alias("label_id"), grade.alias("grade")).dropna()
    return told.groupBy("label_id").agg(F.min("grade").alias("grade"))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Telling features, their values and the grades of at most ``rows`` labelled texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            got = [of_text(t, known) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.float64()), batch.column("order")],
                ["grade", "found", "value", "order"],
            )

    # At most ``rows`` pairs of numbers, so they may be broadcast.
    picked = grades(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    # An id that documents repeat gives more rows; which of them are left out follows from the texts.
    chosen = texts.select("grade", "text", F.xxhash64("doc_id", "text").alias("order"))
    read = chosen.mapInArrow(emit, "grade int, found array<int>, value double, order long").orderBy("order", "grade").limit(rows).drop("order")
    # Of texts with the same features and grade one is enough: copies would make their words look telling.
    read = saved(saved(read, "sample").groupBy("grade", "found").agg(F.min("value").alias("value")), "features")
    by_grade = [F.count_if(F.col("grade") == k).alias(f"n{k}") for k in range(GRADES)]
    totals = np.array(read.agg(*by_grade).first(), float)
    # One row for each bucket at most.
    seen = read.select("grade", F.explode("found").alias("bucket")).groupBy("bucket").agg(*by_grade).toArrow()
    counts = np.zeros((GRADES, BUCKETS))
    for k in range(GRADES):
        counts[k, seen.column("bucket").to_numpy()] = seen.column(f"n{k}").to_numpy()
    used = telling(counts, totals)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f[used[f]] for f in (np.array(f, np.int32) for f in batch.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.int32())), batch.column("value")], batch.schema.names)

    # The driver adds floats in a fixed order, whatever order the rows came in.
    got = sorted(map(tuple, read.select("grade", "found", "value").mapInArrow(pick, read.select("grade", "found", "value").schema).collect()))
    return [np.array(f, np.int32) for _, f, _ in got], np.array([v for _, _, v in got]), np.array([g for g, _, _ in got], int)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which features differ between grades by more than chance, from the rows of each grade that have them.

    One of only a few rows says more about those than about others.
    """
    total = counts.sum(axis=0)
    chi2 = np.zeros(counts.shape[1])
    for k in range(GRADES):
        for have, all_have in ((counts[k], total), (rows[k] - counts[k], rows.sum() - total)):
            expected = all_have * rows[k] / max(1, rows.sum())
            chi2 += np.where(expected > 0, (have - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    return (total >= LEAST_ROWS) & (chi2 >= LEAST_CHI2)


def fit(found: list[np.ndarray], values: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of largest likelihood, by Adam on the whole sample."""
    weights = np.zeros(BUCKETS, np.float32)
    if len(told) == 0:
        return weights, np.arange(GRADES - 1) - float(GRADES)
    lengths = np.array([len(f) for f in found])
    row = np.repeat(np.arange(len(found)), lengths)
    used, column = np.unique(np.concatenate(found), return_inverse=True)
    value = values[row]
    # The first threshold, and the logarithms of the steps between thresholds, which keeps them in order.
    share = [(told > k).mean().clip(1e-3, 1 - 1e-3) for k in range(GRADES - 1)]
    start = -np.log(np.array(share) / (1 - np.array(share)))
    free = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(0.1, np.diff(start)))))
    mean, square = np.zeros_like(free), np.zeros_like(free)
    n = len(used)
    for t in range(1, STEPS + 1):
        steps = np.exp(free[n + 1 :])
        thresholds = free[n] + np.concatenate(([0], np.cumsum(steps)))
        score = np.bincount(row, value * free[column], len(told))
        above = sigmoid(score[:, None] - thresholds)
        edges = np.hstack((np.ones((len(told), 1)), above, np.zeros((len(told), 1))))
        slope_edges = edges * (1 - edges)
        i = np.arange(len(told))
        chance = np.maximum(edges[i, told] - edges[i, told + 1], 1e-9)
        up, down = slope_edges[i, told] / chance, slope_edges[i, told + 1] / chance
        by_score = -(up - down) / len(told)
        by_threshold = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            by_threshold[k] = (up[told == k + 1].sum() - down[told == k].sum()) / len(told)
        slope = np.concatenate((
            np.bincount(column, value * by_score[row], n) + RIDGE * free[:n],
            [by_threshold.sum()], [by_threshold[k + 1 :].sum() * steps[k] for k in range(GRADES - 2)],
        ))
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        free -= STEP_SIZE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights[used] = free[:n]
    return weights, free[n] + np.concatenate(([0], np.cumsum(np.exp(free[n + 1 :]))))


def score(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, keep: bool = False) -> DataFrame:
    """``doc_id``, ``expected_grade``, ``p_top`` and ``kept``; with ``keep`` also the document as ``row``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # The text goes to the workers once, within the row if that is kept.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole if keep else F.col("text"))
    place = min(range(len(docs.columns)), key=lambda k: (docs.columns[k] != "text", docs.columns[k].lower() != "text"))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(weights != 0)
        for batch in batches:
            texts = (batch.column("row").field(place) if keep else batch.column("text")).cast(pa.binary())
            scores = np.fromiter((float(weights[f].sum()) * v for f, v in (of_text(t.as_py(), known) for t in texts)), float, len(texts))
            above = sigmoid(scores[:, None] - thresholds)
            columns = [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= KEEP_FROM)]
            names = ["doc_id", "expected_grade", "p_top", "kept"]
            if keep:
                columns, names = [*columns, batch.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType.fromDDL("doc_id long, expected_grade double, p_top double, kept boolean")
    return rows.mapInArrow(grade, schema.add(rows.schema["row"]) if keep else schema)


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, every column as it came."""
    return score(docs, *fit(*sample(docs, labels)), keep=True).where("kept").select("row.*")


def op5_ordinal_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(*sample(docs, labels)))
