"""A hashed maximum-entropy language model, and add-one unigrams beside it.

A token is a word or the end of a text. Every token has a class: some frequent words and the end
have one of their own, the other words go by their last letters. The model is class-factored:

    P(token | history) = P(class | history) * P(leaf | class, history) * (count + 1) / (mass of the leaf)

where the class is a softmax over hashed features of the history: the word before (an n-gram
feature), the word before that (a skip feature), and the pair of their classes. The leaf is a
softmax too, taken as choices among WAYS down a Huffman tree of the class, each with hashed features of
the word before and the one before that for its node. A frequent word is a leaf of its own; the others
are dealt to leaves by their hash, of which there are about as many as words, up to BUCKETS. A choice
without features is that of the counts, raised by one; one unseen word has room in a class, its share of a
leaf being that of an even hash, so probabilities add up to one.

Counting is a Spark aggregation over all training texts. Training runs in rounds over parts of
them: every task takes AdaGrad steps on its texts from the same weights, and the weights move by the
mean of the tasks' moves, weighted by tokens and summed block by block. Weights, classes and the
counts of the most frequent words have a fixed size and are sent to the tasks; the counts of all
other words meet their texts in a join, so no count is left out and frequent words are never shuffled.

A null or empty text is the end alone. A null ``doc_id`` counts as training. Repeated rows stay and
count each time. Only ``doc_id`` and ``text`` are read. No rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.shared import listed_bytes, numbered_words, saved, text_slices

FOLDS, HELD_OUT = 7, 2
END = b""
# Words whose counts are sent to the tasks, and the size of the model.
HEAD = (1 << 17) - 1
CLASSES, OWN_CLASSES = 32, 8
FEATURE_ROWS = 1 << 14
# Leaves that words outside the head share, branches of a choice inside a class, and the most rows of the choices' weights.
BUCKETS = 1 << 17
WAYS = 16
CHOICE_ROWS = 1 << 16
ROUNDS = 2
STEP_TOKENS, STEP_SIZE = 8192, 0.15
# The largest score that goes into a power, the least power of a taken branch, and the runs that are added member by member.
MOST, LEAST, FEW = np.float32(80), np.float32(1e-37), 4
CHUNK_TOKENS = 400_000
# Tokens whose scores are made at once, and rows of weights that are moved at once: so many stay near the processor.
PASS_TOKENS, STEP_ROWS = 4096, 2048
# Members that a sum of a run takes in one after the other.
PART = 16
# Every task's move of the weights is stored, whatever the task has read; so tasks that learn get so many tokens at least.
TASK_TOKENS = 2_000_000
BLOCK_ROWS = 512
BLOCK_WEIGHTS = BLOCK_ROWS * CLASSES
ENDINGS = b".,;:!?\"')]}#*$%&|"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS == HELD_OUT


def ending(word: bytes) -> bytes:
    return word.rstrip(ENDINGS)[-2:]


@dataclass
class Trees:
    """The classes' trees: leaves first, those of the head by their place, then the shared ones of each class.

    A node knows the one above it (-1: none), and which of its branches it is. The logs of the shares that counts
    give the branches stand in ``shares``, from the first node that is no leaf. A class whose word is alone has no choices.
    """

    above: np.ndarray
    branch: np.ndarray
    shares: np.ndarray
    # By leaf, the log10 of its mass; by class, its first shared leaf and how many less one.
    log_mass: np.ndarray
    first: np.ndarray
    mask: np.ndarray
    # One row for each hash of a word and a node, one column a branch.
    weights: np.ndarray

    def leaves(self, flat: np.ndarray) -> np.ndarray:
        place, own = flat & HEAD, flat >> 17 & 63
        return np.where(place > 0, place, self.first[own] + (flat >> 23 & self.mask[own]))

    @cached_property
    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each leaf's choices begin, and of all leaves' choices the nodes and the branches, from the leaf up."""
        size = len(self.log_mass)
        leaf = node = np.arange(size)
        steps = []
        while len(leaf):
            going = self.above[node] >= 0
            leaf, node = leaf[going], node[going]
            steps.append((leaf, self.above[node], self.branch[node]))
            node = steps[-1][1]
        depth = sum(np.bincount(leaf, minlength=size) for leaf, _, _ in steps)
        starts = np.append(0, np.cumsum(depth))
        nodes, branches = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.int8)
        for k, (leaf, above, branch) in enumerate(steps):
            nodes[starts[leaf] + k], branches[starts[leaf] + k] = above, branch
        return starts, nodes, branches


@dataclass
class Model:
    """What tasks need: classes by word and by ending, the head's counts, the trees, and the weights."""

    own: dict[bytes, int]
    by_ending: dict[bytes, int]
    head: dict[bytes, int] = field(default_factory=dict)
    log_head: np.ndarray = field(default_factory=lambda: np.zeros(1))
    # One row a feature, one column a class; the last row is the constant.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURE_ROWS + 1, CLASSES), np.float32))
    log_mass: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    trees: Trees | None = None

    def class_of(self, word: bytes) -> int:
        found = self.own.get(word)
        return self.by_ending.get(ending(word), CLASSES - 1) if found is None else found


HASH = (1 << 40) - 1


def hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & HASH


class Codes:
    """Per word one number: 40 bits of its hash, 6 of its class, 17 of its place in the head (0: not there)."""

    def __init__(self, model: Model) -> None:
        # A word's class is that of the word, or of its ending.
        self.own, self.own_class = listed(model.own)
        self.endings, self.ending_class = listed(model.by_ending)
        self.head, self.place = listed(model.head)

    def of(self, words: pa.Array) -> np.ndarray:
        endings = pc.binary_slice(pc.ascii_rtrim(words, ENDINGS.decode()).cast(pa.binary()), -2)
        own = found(words, self.own, self.own_class, -1)
        own = np.where(own < 0, found(endings, self.endings, self.ending_class, CLASSES - 1), own)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, listed_bytes(words)), np.uint64, len(words)).view(np.int64)
        return (hashes & HASH) << 23 | own << 17 | found(words, self.head, self.place, 0)


def listed(numbers: dict[bytes, int]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(list(numbers), pa.binary()), np.fromiter(numbers.values(), np.int64, len(numbers))


def found(words: pa.Array, known: pa.Array, numbers: np.ndarray, other: int) -> np.ndarray:
    """The numbers of the words that are known, for others that one."""
    at = pc.index_in(words.cast(pa.binary()), known).fill_null(len(known)).to_numpy()
    return np.append(numbers, other)[at]


def chunks(texts: pa.Array, codes: Codes) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words, each token's place among them, codes, lengths): some texts at a time, about CHUNK_TOKENS tokens."""
    for first, some in text_slices(texts):
        words, which, sizes = numbered_words(pc.ascii_lower(some))
        words = pa.concat_arrays([words, pa.array([END.decode()], words.type)])
        lengths = sizes + 1
        every = np.full(len(which) + len(some), len(words) - 1, np.int32)
        every[np.arange(len(which)) + np.repeat(np.arange(len(some)), sizes)] = which
        code = codes.of(words)
        ends = np.cumsum(lengths)
        at = start = 0
        while at < len(some):
            stop = min(len(some), int(np.searchsorted(ends, start + CHUNK_TOKENS)) + 1)
            here = every[start : ends[stop - 1]]
            yield first + at, words, here, code[here], lengths[at:stop]
            at, start = stop, int(ends[stop - 1])


def earlier(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the codes of the word before and of the one before that, -1 where there is none."""
    starts = np.cumsum(lengths) - lengths
    one, two = np.full(len(flat), -1, np.int64), np.full(len(flat), -1, np.int64)
    one[1:] = flat[:-1]
    two[2:] = flat[:-2]
    one[starts] = two[starts] = -1
    two[starts[lengths > 1] + 1] = -1
    return one, two


def contexts(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three rows of the weights for each token, and two numbers.

    The rows are by the word before, the word before that, and their classes; the numbers by the two words.
    """
    one, two = earlier(flat, lengths)
    before = np.empty((2, len(flat)), np.uint32)
    rows = np.empty((3, len(flat)), np.int64)
    for k, (code, odd) in enumerate(((one, 0x9E3779B97F4A7C15), (two, 0xC2B2AE3D27D4EB4F))):
        before[k] = (code >> 23).view(np.uint64) * np.uint64(odd) >> np.uint64(32)
        rows[k] = before[k] >> np.uint32(18)
    pair = (one >> 17 & 63) * 64 + (two >> 17 & 63) + 7
    rows[2] = (pair.view(np.uint64) * np.uint64(0x165667B19E3779F9) >> np.uint64(50)).view(np.int64) & FEATURE_ROWS - 1
    rows[:2] &= FEATURE_ROWS - 1
    return rows, before


def bounded(score: np.ndarray) -> np.ndarray:
    """At most MOST, so that sums of powers stay finite."""
    return np.minimum(score, MOST, out=score) if score.size and score.max() > MOST else score


def choices(trees: Trees, before: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their two rows, branches, scores): the choices of some tokens, one token after the other, each from its leaf up.

    Scores are those of all branches, as powers of e.
    """
    shift = np.uint32(33 - len(trees.weights).bit_length())
    starts, nodes, branches = trees.paths
    first = np.take(starts, leaves)
    depth = np.take(starts, leaves + 1) - first
    token = np.repeat(np.arange(len(leaves)), depth)
    place = np.arange(len(token)) + np.repeat(first - np.cumsum(depth) + depth, depth)
    node = np.take(nodes, place)
    at = np.take(before, token, axis=1)
    at ^= node.view(np.uint32) * np.uint32(0x85EBCA6B)
    at *= np.uint32(0x9E3779B1)
    at >>= shift
    score = np.take(trees.shares, node - len(trees.log_mass), axis=0)
    score += np.take(trees.weights, at[0], axis=0)
    score += np.take(trees.weights, at[1], axis=0)
    return token, at, np.take(branches, place), np.exp(bounded(score), out=score)


def log_leaf(trees: Trees, before: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The log of the leaves' probabilities inside their classes."""
    token, _, branch, score = choices(trees, before, leaves)
    taken = np.maximum(np.take(score.reshape(-1), np.arange(len(token)) * WAYS + branch), LEAST)
    return np.bincount(token, np.log(taken / row_sums(score)), len(leaves))


def learn_leaves(trees: Trees, squares: np.ndarray, before: np.ndarray, leaves: np.ndarray) -> None:
    """One AdaGrad step on the choices of some tokens."""
    rows, misses = [], []
    for i in range(0, len(leaves), PASS_TOKENS):
        _, at, branch, miss = choices(trees, before[:, i : i + PASS_TOKENS], leaves[i : i + PASS_TOKENS])
        miss /= row_sums(miss)[:, None]
        miss.reshape(-1)[np.arange(len(branch)) * WAYS + branch] -= 1
        rows.append(at)
        misses.append(miss)
    if any(map(len, misses)):
        move(trees.weights, squares, np.concatenate(rows, axis=1), np.concatenate(misses))


def scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The classes' scores of some tokens."""
    score = np.take(weights, rows[0], axis=0)
    score += np.take(weights, rows[1], axis=0)
    score += np.take(weights, rows[2], axis=0)
    score += weights[-1]
    return bounded(score)


def row_sums(values: np.ndarray) -> np.ndarray:
    """As a product, which for short rows is several times faster than a sum."""
    return values @ np.ones(values.shape[1], values.dtype)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    score = scores(weights, rows)
    score -= np.log(row_sums(np.exp(score)))[:, None]
    return score


def learn(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One AdaGrad step on some tokens."""
    n = len(classes)
    miss = scores(weights, rows)
    np.exp(miss, out=miss)
    miss /= row_sums(miss)[:, None]
    miss.reshape(-1)[np.arange(n) * CLASSES + classes] -= 1
    move(weights, squares, rows, miss)
    step(weights, squares, np.array([len(weights) - 1]), (np.ones(n, miss.dtype) @ miss)[None])


def move(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, miss: np.ndarray) -> None:
    """A step on the rows met, at most 65,536 of them, each by the sum of its tokens' misses."""
    # Small integers are sorted by their digits.
    at = rows.reshape(-1).astype(np.uint16)
    order = np.argsort(at, kind="stable")
    at = at[order].astype(np.int64)
    order = np.tile(np.arange(len(miss)), len(rows))[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sizes = np.diff(np.append(starts, len(at)))
    # Most rows are met once or twice; a sum over runs pays for every run.
    for size in range(1, FEW + 1):
        alike = starts[sizes == size]
        for i in range(0, len(alike), STEP_ROWS):
            begin = alike[i : i + STEP_ROWS]
            slope = np.take(miss, order[begin], axis=0)
            for k in range(1, size):
                slope += np.take(miss, order[begin + k], axis=0)
            step(weights, squares, at[begin], slope)
    many = sizes > FEW
    if many.any():
        step(weights, squares, at[starts[many]], run_sums(miss, order, starts[many], sizes[many]))


def run_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``values[order]``: of its parts of at most PART first, all parts at a time, then of their sums."""
    parts = (sizes + PART - 1) // PART
    first = np.cumsum(parts) - parts
    within = np.arange(int(parts.sum())) - np.repeat(first, parts)
    begin = np.repeat(starts, parts) + within * PART
    size = np.minimum(np.repeat(sizes, parts) - within * PART, PART)
    # The longest parts first, so that those with one more member stand in front.
    longest = np.argsort((PART - size).astype(np.uint8), kind="stable")
    begin = begin[longest]
    longer = len(size) - np.cumsum(np.bincount(size, minlength=PART + 1))
    total = np.take(values, order[begin], axis=0)
    for k in range(1, PART):
        n = longer[k]
        total[:n] += np.take(values, order[begin[:n] + k], axis=0)
    out = np.empty_like(total)
    put_rows(out, longest, total)
    return out if len(out) == len(sizes) else run_sums(out, np.arange(len(out)), first, parts)


def step(weights: np.ndarray, squares: np.ndarray, which: np.ndarray, slope: np.ndarray) -> None:
    square = np.take(squares, which, axis=0)
    square += slope * slope
    put_rows(squares, which, square)
    square += 1e-6
    np.sqrt(square, out=square)
    slope *= STEP_SIZE
    slope /= square
    put_rows(weights, which, np.subtract(np.take(weights, which, axis=0), slope, out=slope))


def put_rows(table: np.ndarray, which: np.ndarray, rows: np.ndarray) -> None:
    """``table[which] = rows``; as one item a row it is several times faster."""
    item = np.dtype((np.void, rows.itemsize * rows.shape[1]))
    np.put(table.view(item).reshape(-1), which, rows.view(item).reshape(-1))


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and its count ``c`` over all rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                words, n = pc.value_counts(pc.ascii_split_whitespace(pc.ascii_lower(texts)).flatten()).flatten()
                # Beside white space at the ends of a text there are empty words, which are none.
                some = pc.greater(pc.binary_length(words), 0)
                yield out(words.filter(some), n.filter(some))
            yield out(pa.array([END]), pa.array([batch.num_rows]))

    def out(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), n.cast(pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(emit, "word binary, n long")
    return saved(counted.groupBy("word").agg(F.sum("n").alias("c")), "counts")


def head_of(counts: DataFrame) -> list:
    """The most frequent words: all from a count on, at most HEAD. Ties are by the word.

    The count comes from a histogram of steps, of which there are a few thousand for each power of two.
    """
    exact = 1 << 12
    step = F.when(F.col("c") < exact, F.col("c")).otherwise(F.expr("shiftleft(shiftright(c, int(log2(c)) - 11), int(log2(c)) - 11)"))
    least, words = 1 << 62, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        words += row["count"]
        if words > HEAD:
            break
        least = row["step"]
    return sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def choose_classes(top: list) -> Model:
    """Classes and the head from the most frequent words."""
    own = {END: 0}
    for row in top:
        if len(own) <= OWN_CLASSES:
            own.setdefault(bytes(row["word"]), len(own))
    mass: Counter = Counter()
    for row in top:
        if bytes(row["word"]) not in own:
            mass[ending(bytes(row["word"]))] += row["c"]
    ranked = sorted(mass, key=lambda e: (-mass[e], e))[: CLASSES - 1 - len(own)]
    model = Model(own, {e: len(own) + i for i, e in enumerate(ranked)})
    model.head = {bytes(row["word"]): i + 1 for i, row in enumerate(top)}
    model.log_head = np.log10(np.array([0, *[row["c"] for row in top]], float) + 1)
    return model


def class_masses(counts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            own = np.fromiter(map(model.class_of, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            words += np.bincount(own, minlength=CLASSES)
            np.add.at(size, own, batch.column("c").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(size), pa.array(words)], ["k", "size", "words"])

    found = counts.mapInArrow(emit, "k long, size long, words long").groupBy("k").agg(F.sum("size").alias("size"), F.sum("words").alias("words"))
    size, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in found.collect():
        size[row["k"]], words[row["k"]] = row["size"], row["words"]
    return size, words


def huffman(masses: np.ndarray, leaves: np.ndarray, first: int, above: np.ndarray, branch: np.ndarray, shares: np.ndarray) -> int:
    """Joins the leaves into one tree whose other nodes are numbered from ``first``; returns the next number.

    The lightest are joined again and again: leaves in the order of mass, or joined nodes in the order they were made.
    """
    size = len(above) - len(shares)
    order = np.argsort(masses, kind="stable")
    # Branches without words, so that every choice has WAYS of them.
    empty = -(len(leaves) - 1) % (WAYS - 1)
    waiting, mass = [-1] * empty + leaves[order].tolist(), [0.0] * empty + masses[order].tolist()
    made: list[float] = []
    i = j = 0
    while len(waiting) - i + len(made) - j > 1:
        node, joined = first + len(made), []
        for k in range(WAYS):
            if j >= len(made) or i < len(mass) and mass[i] <= made[j]:
                own = waiting[i]
                joined.append(mass[i])
                i += 1
            else:
                own = first + j
                joined.append(made[j])
                j += 1
            if own >= 0:
                above[own], branch[own] = node, k
        made.append(sum(joined))
        with np.errstate(divide="ignore"):
            shares[node - size] = np.log(np.array(joined) / made[-1])
    return first + len(made)


def grow_trees(counts: DataFrame, model: Model, top: list, words: np.ndarray) -> Trees:
    """The trees of the classes, from the counts of the head and the sums of the other words' by shared leaf."""
    own = np.fromiter((model.class_of(bytes(row["word"])) for row in top), np.int64, len(top))
    rare = words - np.bincount(own, minlength=CLASSES)
    wanted = np.maximum(1, rare * min(1, BUCKETS / max(1, rare.sum())))
    shared = 1 << np.floor(np.log2(wanted)).astype(np.int64)
    size = len(top) + 1 + int(shared.sum())
    inner = size // (WAYS - 1) + 2 * CLASSES
    trees = Trees(
        np.full(size + inner, -1, np.int32), np.zeros(size + inner, np.int8), np.zeros((inner, WAYS), np.float32), np.zeros(size),
        len(top) + 1 + np.cumsum(shared) - shared, shared - 1, np.zeros((0, WAYS), np.float32),
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if word not in model.head:
                    k = model.class_of(word)
                    sums[trees.first[k] + (hashed(word) & int(trees.mask[k]))] += c + 1
        leaves = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(sums[leaves])], ["leaf", "mass"])

    mass = np.zeros(size)
    # At most BUCKETS and a few numbers.
    for row in counts.mapInArrow(emit, "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).collect():
        mass[row["leaf"]] = row["mass"]
    mass[1 : len(top) + 1] = [row["c"] + 1 for row in top]
    mass[len(top) + 1 :] += np.repeat(1 / shared, shared)
    alone = set(model.own.values())
    place = np.arange(1, len(top) + 1)
    following = size
    trees.log_mass[1:] = np.log10(mass[1:])
    for k in range(CLASSES):
        leaves = np.append(place[own == k], np.arange(shared[k]) + trees.first[k])
        if k in alone:
            trees.log_mass[leaves] = np.log10(mass[leaves].sum())
        else:
            following = huffman(mass[leaves], leaves, following, trees.above, trees.branch, trees.shares)
    # A row and more for four words of the training rows, as far as they go.
    bits = max(10, min(CHOICE_ROWS.bit_length() - 1, int(words.sum() // 4).bit_length()))
    trees.weights = np.zeros((1 << bits, WAYS), np.float32)
    return trees


def summed(moves: DataFrame, keys: list[str]) -> DataFrame:
    """Moves of the weights added up by key, one batch at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n = None, None, 0

        def out() -> pa.RecordBatch:
            values = [pa.array([v], pa.int32()) for v in key]
            return pa.RecordBatch.from_arrays([*values, pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], [*keys, "move", "n"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for *here, move, size in zip(*columns, batch.column("move").to_pylist(), batch.column("n").to_pylist()):
                if here != key:
                    if key is not None:
                        yield out()
                    key, total, n = here, np.zeros(len(move) // 4, np.float32), 0
                total += np.frombuffer(move, np.float32)
                n += size
        if key is not None:
            yield out()

    dealt = moves.select(*keys, "move", "n").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(add, ", ".join(f"{k} int" for k in keys) + ", move binary, n long")


def one_round(docs: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of choices after each of so many tasks has learned from its texts and the moves are averaged."""
    # Moves are summed in groups, then the sums of the groups.
    groups = isqrt(tasks)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model)
        weights, squares = model.weights.copy(), np.zeros_like(model.weights)
        trees = replace(model.trees, weights=model.trees.weights.copy())
        inner_squares = np.zeros_like(trees.weights)
        n = 0
        for batch in batches:
            for _, _, _, flat, lengths in chunks(batch.column("text"), codes):
                rows, before = contexts(flat, lengths)
                classes, leaves = flat >> 17 & 63, trees.leaves(flat)
                for at in range(0, len(flat), STEP_TOKENS):
                    learn(weights, squares, rows[:, at : at + STEP_TOKENS], classes[at : at + STEP_TOKENS])
                    learn_leaves(trees, inner_squares, before[:, at : at + STEP_TOKENS], leaves[at : at + STEP_TOKENS])
                n += len(flat)
        if n:
            moved = ((weights - model.weights).ravel(), (trees.weights - model.trees.weights).ravel())
            move = np.concatenate(moved) * np.float32(n)
            parts = [move[i : i + BLOCK_WEIGHTS].tobytes() for i in range(0, len(move), BLOCK_WEIGHTS)]
            size = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(size), pa.int32()), pa.array([TaskContext.get().partitionId() % groups] * size, pa.int32()),
                    pa.array(parts, pa.binary()), pa.array([n] * size, pa.int64()),
                ],
                ["block", "part", "move", "n"],
            )

    moves = docs.select("text").coalesce(tasks).mapInArrow(train, "block int, part int, move binary, n long")
    weights = np.concatenate((model.weights.ravel(), model.trees.weights.ravel()))
    for row in summed(summed(moves, ["block", "part"]), ["block"]).collect():
        at = row["block"] * BLOCK_WEIGHTS
        move = np.frombuffer(bytes(row["move"]), np.float32)
        weights[at : at + len(move)] += move / np.float32(row["n"])
    return weights[: model.weights.size].reshape(-1, CLASSES), weights[model.weights.size :].reshape(-1, WAYS)


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """Classes from the counts, then the rounds, each over its part of the training rows."""
    top = head_of(counts)
    model = choose_classes(top)
    size, words = class_masses(counts, model)
    model.log_mass = np.log10(size + words + 1)
    model.weights[-1] = np.log((size + 1) / (size.sum() + CLASSES))
    model.trees = grow_trees(counts, model, top, words)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(size.sum()) // ROUNDS // TASK_TOKENS)
    for k in range(ROUNDS):
        part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k
        model.weights, model.trees.weights = one_round(docs.where(~held_out() & part), model, tasks)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """One row a text with sums over its tokens, and one row a text and word outside the head.

    Rows of a text have no ``word``. ``at`` numbers the rows by task, so a task run again gives the same.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model)
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, words, which, flat, lengths in chunks(batch.column("text"), codes):
                rows, before = contexts(flat, lengths)
                classes, place, leaves = flat >> 17 & 63, flat & HEAD, model.trees.leaves(flat)
                chance = np.empty(len(flat))
                for i in range(0, len(flat), PASS_TOKENS):
                    some = slice(i, i + PASS_TOKENS)
                    own = classes[some]
                    inside = log_leaf(model.trees, before[:, some], leaves[some])
                    chance[some] = log_softmax(model.weights, rows[:, some])[np.arange(len(own)), own] + inside
                chance = chance / np.log(10) - model.trees.log_mass[leaves]
                n = len(lengths)
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(v, starts) for v in (model.log_head[place], chance, (place > 0).astype(np.int64))]
                ids = batch.column("doc_id").slice(first, n)
                keys = np.arange(at, at + n)
                nulls = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys), ids, pa.array(lengths), *map(pa.array, sums), nulls], NAMES)
                # The words outside the head of one text after the other.
                where = np.flatnonzero(place == 0)
                of_text = np.searchsorted(starts, where, side="right") - 1
                pairs, number = np.unique(of_text * len(words) + which[where], return_counts=True)
                m = len(pairs)
                empty = [pa.nulls(m, t) for t in (pa.float64(), pa.float64(), pa.int64())]
                rare = words.take(pa.array(pairs % len(words))).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at + pairs // len(words)), pa.nulls(m, pa.int64()), pa.array(number), *empty, rare], NAMES)
                at += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "at long, doc_id long, n_tokens long, log_counts double, chance double, known long, word binary")


NAMES = ["at", "doc_id", "n_tokens", "log_counts", "chance", "known", "word"]


def score_all(docs: DataFrame, train: Callable[[DataFrame, DataFrame], Model] = fit) -> DataFrame:
    """Every text with its base score and the model's."""
    counts = count_words(docs.where(~held_out()))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = train(docs, counts)
    scored = saved(score_texts(docs, model), "scored")
    rare = scored.where("word IS NOT NULL").select("at", "word", F.col("n_tokens").alias("n"))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_text = met.groupBy("at").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    texts = scored.where("word IS NULL").drop("word").join(of_text, "at", "left")
    counted = F.col("log_counts") + F.coalesce("rare_log", F.lit(0.0))
    return texts.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * float(np.log10(totals["n"] + totals["v"] + 1))).alias("base_score"),
        (counted + F.col("chance")).alias("score"),
    )


def op4_maxent_scoring(docs: DataFrame) -> DataFrame:
    return score_all(docs)
