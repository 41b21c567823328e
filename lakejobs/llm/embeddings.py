"""Near duplicates among vectors: an exact metric range join.

Vectors of one label link at a cosine of at least the bound, which for vectors of length one is a
Euclidean distance ``r``. Some vectors of each label are pivots; every vector belongs to the cell
of its nearest pivot. By the triangle inequality a vector at distance ``d`` from its pivot can be
within ``r`` of a member of another cell only if that cell's pivot is at most ``d + 2 r`` away, and
of these cells only where the plane between the pivots is at most ``r`` away; into those it is
copied. Cells are then joined independently: each vector finds all its links in its own cell. How
many pivots a label gets is told by those not yet taken: where more of them would copy vectors
rather than part them, as in many dimensions, there are fewer, or one cell.

A large cell is cut into pieces. A task keeps one piece and reads others past it, half of them at
most, since two pieces meet in one of their tasks only. Products are taken in single
precision, and once more in double where they come too near to the bound to tell.

Rows move as little as may be. A vector is known by a hash of 128 bits, so vectors go to their
units straight from the input, which is read several times and must be the same each time. Equal
vectors of a label are one entry with a count, so a vector that very many rows share costs no more
than one: a bitmap of fixed size tells which rows may share theirs, and only those are shuffled and
stored to be grouped, by the vectors themselves. A full bitmap would only let more through.

Vectors that are null, zero, or hold a null or a component that is not finite, and
those with a null label, link with nothing; so do vectors of different lengths. Repeated
``vec_id`` rows are rows of their own. Floats and doubles are
compared as they come, other numbers as doubles. Only ``vec_id``, ``embedding`` and ``label`` are read. No rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lakejobs.llm.graph import components, lowest_linked
from lakejobs.llm.shared import saved

BOUND = 0.98
# One in so many entries may be a pivot, but no more than PIVOTS in all: that bounds what tasks are sent.
ENTRIES_PER_PIVOT = 512
PIVOTS = 2048
# A cell of more rows is cut into pieces of so many, but PIECES at most as long as no piece takes more bytes.
LEAST_UNIT, PIECES, PIECE_BYTES = 16384, 3, 96 << 20
# So many pieces at most are read past the one that a task keeps.
STREAMED = 2
# Rows and columns of products made at once, and components of pairs that are told in double at once.
TILE, EXACT = (512, 1024), 1 << 20
# Vectors of fewer components have no heads.
LEAST_HEADED = 32
# A join of so many pairs, or of so many rows, is worth a task.
TASK_PAIRS, TASK_ROWS = 100_000_000, 200_000
# What the cost of a plan is counted in: a pair's component, and what a row that is dealt out costs of them.
ROW_COST = 1 << 17
BITMAP_BITS = 1 << 25
CELL, UNIT = ["label", "dims", "cell"], ["unit", "part"]


def can_link() -> Column:
    """Whether a row's vector can link at all."""
    e = F.col("embedding")
    # NaN is the largest of all; both ends are null without a number.
    low, high = F.array_min(e), F.array_max(e)
    finite = (low > float("-inf")) & (high < float("inf")) & ((low != 0) | (high != 0))
    return F.coalesce(F.col("label").isNotNull() & finite & ~F.exists(e, lambda x: x.isNull()), F.lit(False))


def raw(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long vectors as rows, as they come."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length one in double precision."""
    rows = rows.astype(np.float64)
    # Large and small components are scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long vectors, as rows of length one in double precision."""
    return unit(raw(column))


def cells_of(points: np.ndarray, pivots: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, cell, home) for each vector: its own cell and those it must be copied into."""
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    for at in range(0, len(points), 4096):
        square = np.maximum(0, 2 - 2 * points[at : at + 4096] @ pivots.T)
        far = np.sqrt(square)
        home = far.argmin(axis=1)
        own = np.arange(len(home))
        slack = 1e-9
        near = far <= far[own, home][:, None] + 2 * reach + slack
        apart = between[home]
        plane = (square - square[own, home][:, None]) / np.where(apart > 0, 2 * apart, 1)
        near &= (plane <= reach + slack) | (apart == 0)
        near[own, home] = True
        i, cell = np.nonzero(near)
        yield i + at, cell, home[i] == cell


class Entries:
    """The different vectors with their keys ``k1``, ``k2``, ``weight`` and ``first``; rows that may share theirs are stored once."""

    def __init__(self, rows: DataFrame, keys: DataFrame) -> None:
        self.n, self.bitmap = shared_keys(keys)
        self.rows = rows.withColumn("weight", F.lit(1).cast("long")).withColumn("first", F.col("vec_id")).drop("vec_id")
        self.shared = None
        if self.bitmap.any():
            same = rows.mapInArrow(self.choose(True), rows.schema).groupBy("label", "dims", "embedding", "k1", "k2")
            grouped = same.agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
            self.shared = saved(grouped.select(*self.rows.columns), "shared")

    def choose(self, shared: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        bitmap = self.bitmap

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("k1").to_numpy() & (BITMAP_BITS - 1)
                some = (bitmap[at >> 6] >> (at & 63) & 1).astype(bool) == shared
                yield batch if some.all() else batch.filter(pa.array(some))

        return chosen

    def map(self, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, where: Column | None = None) -> DataFrame:
        """What ``each`` makes of the batches of all entries, or of those where a condition holds."""
        alone = self.choose(False)
        some = [d if where is None else d.where(where) for d in (self.rows, self.shared) if d is not None]
        made = some[0].mapInArrow(lambda batches: each(alone(batches)), schema)
        return made if self.shared is None else made.unionByName(some[1].mapInArrow(each, schema))


def shared_keys(keys: DataFrame) -> tuple[int, np.ndarray]:
    """How many keys there are, and a bitmap of those that several rows have; its size does not depend on the input."""
    counts = keys.where("k1 IS NOT NULL").groupBy("k1").count()
    word = F.when(F.col("count") > 1, F.shiftright(F.pmod("k1", F.lit(BITMAP_BITS)), 6)).otherwise(-1).cast("int").alias("at")
    bit = F.expr("bit_or(shiftleft(1L, cast(pmod(k1, 64) AS int)))").alias("bits")
    got = counts.groupBy(word).agg(bit, F.count("*").alias("n")).toArrow()
    at, bits = got.column("at").to_numpy(), got.column("bits").to_numpy()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[at[at >= 0]] = bits[at >= 0]
    return int(got.column("n").to_numpy().sum()), bitmap


def pieces_for(rows: np.ndarray, width: int) -> np.ndarray:
    """How many pieces cells of so many rows, each of so many bytes, are cut into."""
    some = np.minimum(-(-rows // LEAST_UNIT), PIECES)
    return np.where(rows > LEAST_UNIT, np.maximum(some, -(-rows * width // PIECE_BYTES)), 1)


def apart(points: np.ndarray, most: int) -> np.ndarray:
    """The places of all points: first those that are, one after the other, the farthest from all before, at most so many."""
    order, near = [0], points @ points[0]
    while len(order) < most:
        order.append(int(near.argmin()))
        near = np.maximum(near, points @ points[order[-1]])
    order = list(dict.fromkeys(order))
    return np.array([*order, *np.setdiff1d(np.arange(len(points)), order)])


def best_pivots(points: np.ndarray, one_in: int, width: int, reach: float) -> np.ndarray:
    """Those of the points that part the entries best; none if one cell does. The other points, each for ``one_in`` entries, tell."""
    points = points[apart(points, len(points) // 2)]
    best, least, most = points[:0], float("inf"), float("inf")
    n, m = len(points) * one_in, 1
    while m <= max(1, len(points) // 2):
        rows = np.array([float(n)])
        if m > 1:
            cells = np.concatenate([cell for _, cell, _ in cells_of(points[m:], points[:m], reach)])
            rows = np.bincount(cells, minlength=m) * (n / (len(points) - m))
        dealt = float((rows * (1 + pieces_for(rows, width)) / 2).sum())
        most = max(dealt, 2.0 * n) if m == 1 else most
        cost = float((rows**2).sum()) / 2 * points.shape[1] + dealt * ROW_COST
        if cost < least and dealt <= most:
            best, least = points[: m if m > 1 else 0], cost
        m += max(1, m // 3)
    return best


def chosen_pivots(entries: Entries, width: int, reach: float) -> dict[tuple[int, int], np.ndarray]:
    """The pivots of each label and length of vectors that has more than one cell."""
    one_in = max(ENTRIES_PER_PIVOT, -(-entries.n // (PIVOTS // 2)))
    # Chosen by a hash, so every label has pivots in proportion; the limit only bounds their number.
    vector = entries.rows.schema["embedding"].dataType.simpleString()
    found = entries.map(
        lambda batches: (b.select(["label", "dims", "k1", "k2", "embedding"]) for b in batches),
        f"label long, dims int, k1 long, k2 long, embedding {vector}",
        F.pmod("k1", F.lit(one_in)) == 0,
    )
    by_group: dict[tuple[int, int], list] = {}
    for row in found.orderBy("k2", "k1").limit(PIVOTS).collect():
        by_group.setdefault((row["label"], row["dims"]), []).append(row["embedding"])
    pivots = {group: best_pivots(matrix(pa.array(rows)), one_in, width * group[1], reach) for group, rows in by_group.items()}
    return {group: points for group, points in pivots.items() if len(points)}


def dealt(batches: Iterator[pa.RecordBatch], pivots: dict[tuple[int, int], np.ndarray], reach: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, place, cell, home): rows of a label and length, and which of them go to which cells."""
    for batch in batches:
        label, dims = (batch.column(c).to_numpy() for c in ("label", "dims"))
        order = np.lexsort((label, dims))
        new = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
        whole = [np.zeros(0, np.int64)]
        for some in np.split(order, new) if len(order) else ():
            group = int(label[some[0]]), int(dims[some[0]])
            if group not in pivots:
                whole.append(some)
                continue
            rows = batch.take(pa.array(some))
            for i, cell, home in cells_of(matrix(rows.column("embedding")), pivots[group], reach):
                yield rows, i, cell.astype(np.int32), home
        i = np.sort(np.concatenate(whole))
        if len(i):
            yield batch, i, np.zeros(len(i), np.int32), np.ones(len(i), bool)



def cell_sizes(entries: Entries, pivots: dict[tuple[int, int], np.ndarray], width: int, reach: float) -> DataFrame:
    """``rows`` of each cell, and into how many ``pieces`` it is cut."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, cell, _ in dealt(batches, pivots, reach):
            cells = np.stack([*(rows.column(c).to_numpy()[i].astype(np.int64) for c in CELL[:2]), cell])
            found, times = np.unique(cells, axis=1, return_counts=True)
            columns = [pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)), pa.array(times)]
            yield pa.RecordBatch.from_arrays(columns, [*CELL, "rows"])

    found = entries.map(count, "label long, dims int, cell int, rows long").groupBy(*CELL).agg(F.sum("rows").alias("rows"))
    some = F.least(F.ceil(F.col("rows") / LEAST_UNIT), F.lit(PIECES))
    whole = F.ceil(F.col("rows") * F.col("dims") * width / PIECE_BYTES)
    return found.withColumn("pieces", F.when(F.col("rows") > LEAST_UNIT, F.greatest(some, whole)).otherwise(1).cast("int"))


def spread(entries: Entries, pivots: dict[tuple[int, int], np.ndarray], reach: float) -> DataFrame:
    """Entries with their cells: ``k1``, ``k2``, ``weight``, ``first``, ``embedding``, ``label``, ``dims``, ``cell``, ``home``."""
    names = ["k1", "k2", "weight", "first", "embedding", "label", "dims"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, cell, home in dealt(batches, pivots, reach):
            part = rows.select(names)
            part = part if len(i) == part.num_rows and (np.diff(i) == 1).all() else part.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(home)], [*names, "cell", "home"])

    vector = entries.rows.schema["embedding"].dataType.simpleString()
    return entries.map(deal, f"k1 long, k2 long, weight long, first long, embedding {vector}, label long, dims int, cell int, home boolean")


def units_of(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with ``unit``, ``part`` and ``streamed``: each two rows of a cell meet in exactly one unit and part, or are both kept in all parts of one.

    The unit ``u`` of a cell of ``p`` pieces keeps piece ``u``; the pieces after it, up to half way round, come
    streamed, some in each part. The rows come sorted by unit and part, kept ones first, units unbroken.
    """
    large = F.broadcast(sizes.where("pieces > 1").select(*CELL, "pieces"))
    p, piece, one = F.col("pieces"), F.pmod(F.col("k2"), F.col("pieces")).cast("int"), F.lit(1)
    ahead = F.floor((p - 1) / 2) + F.when((p % 2 == 0) & (2 * piece < p), 1).otherwise(0)
    parts = F.greatest(F.ceil(ahead / STREAMED), one).cast("int")

    def meets(unit: Column, part: Column, streamed: bool) -> Column:
        return F.struct(unit.cast("int").alias("unit"), part.cast("int").alias("part"), F.lit(streamed).alias("streamed"))

    def before(step: Column) -> Column:
        return F.pmod(piece - step, p)

    # Of two pieces half way round, only the first's unit has both.
    steps = F.filter(F.sequence(one, F.floor(p / 2).cast("int")), lambda o: (2 * o < p) | (2 * before(o) < p))
    kept = F.transform(F.sequence(F.lit(0), parts - 1), lambda part: meets(piece, part, False))
    passed = F.transform(steps, lambda o: meets(before(o), F.floor((o - 1) / STREAMED), True))
    alone = F.array(meets(F.lit(0), F.lit(0), False))
    placed = rows.join(large, CELL, "left").withColumn("meets", F.when(p > 1, F.concat(kept, passed)).otherwise(alone))
    each = placed.select(*rows.columns, F.inline("meets"))
    # So many tasks as the pairs or the rows are worth, but no more than eight for each unit, so that few units share one.
    work = sizes.select(
        F.sum(F.col("rows") * F.col("rows") / 2).alias("pairs"), F.sum(F.col("rows") * (F.col("pieces") + 1) / 2).alias("rows"),
        F.sum("pieces").alias("units"),
    ).first()
    tasks = max((work["pairs"] or 0) // TASK_PAIRS, (work["rows"] or 0) // TASK_ROWS)
    tasks = int(min(tasks, 8 * (work["units"] or 0))) + 1
    return each.repartition(tasks, *CELL, *UNIT).sortWithinPartitions(*CELL, *UNIT, "streamed")


class Block:
    """Some rows of a unit, at the places from ``at`` on."""

    def __init__(self, batch: pa.RecordBatch, at: int) -> None:
        self.told = batch.select(["k1", "k2", "weight", "first"])
        self.rows = raw(batch.column("embedding"))
        self.weight, self.home = batch.column("weight").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
        self.at, self.n = at, batch.num_rows
        self.links = np.zeros(self.n, np.int64)


def headed(points: np.ndarray) -> np.ndarray:
    """The first of the components, and the length of the rest in place of it: no product of these is below that of the whole."""
    first = max(1, 8 * (points.shape[1] // 24) - 1)
    return np.column_stack([points[:, :first], np.sqrt(np.einsum("ij,ij->i", points[:, first:], points[:, first:]))])


def near_pairs(a: np.ndarray, b: np.ndarray, bound: float, same: bool) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """(rows, columns, row, column): the pairs that link in each part of the products of two blocks, or of one with itself.

    Products of heads leave few pairs, which are told in double; once they leave many, whole products are made.
    """
    dims, (tall, wide) = a.shape[1], TILE
    # What single precision may be wrong by, of vectors of length one.
    least, sure = bound - (dims + 8) * 2.0**-23, bound + (dims + 8) * 2.0**-23
    space = np.empty(tall * wide, np.float32)
    by_head = dims >= LEAST_HEADED

    def part(rows: np.ndarray, at: int, most: int) -> tuple[np.ndarray, np.ndarray | None]:
        points = unit(rows[at : at + most])
        return points.astype(np.float32), headed(points).astype(np.float32) if by_head else None

    right = [(j, part(b, j, wide)) for j in range(0, len(b), wide)]
    for i in range(0, len(a), tall):
        x, x_head = part(a, i, tall)
        for j, (y, y_head) in right:
            if same and j + len(y) <= i + 1:
                continue
            dots = space[: len(x) * len(y)].reshape(len(x), len(y))
            if by_head:
                np.matmul(x_head, y_head.T, out=dots)
                if dots.max() < least:
                    continue
                at = np.flatnonzero(dots.ravel() >= least)
                near = np.zeros(len(at), bool)
                by_head = len(at) <= dots.size >> 7
            if not by_head:
                np.matmul(x, y.T, out=dots)
                if dots.max() < least:
                    continue
                at = np.flatnonzero(dots.ravel() >= least)
                near = dots.ravel()[at] >= sure
            p, q = np.divmod(at, len(y))
            if same:
                later = q + j > p + i
                near, p, q = near[later], p[later], q[later]
            unsure = np.flatnonzero(~near)
            step = max(1, EXACT // dims)
            for some in (unsure[k : k + step] for k in range(0, len(unsure), step)):
                near[some] = np.einsum("ij,ij->i", unit(a[i + p[some]]), unit(b[j + q[some]])) >= bound
            if near.any():
                yield slice(i, i + len(x)), slice(j, j + len(y)), p[near], q[near]


def weighed(at: np.ndarray, weight: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The weights summed up at each place; none where a row is not at home."""
    return np.where(home, np.bincount(at, weight, minlength=len(home)).astype(np.int64), 0)


class Unit:
    """A part of a unit: the blocks that it keeps, and for each place the lowest one that links lead to."""

    def __init__(self, part: int, bound: float) -> None:
        self.part, self.bound = part, bound
        self.blocks: list[Block] = []
        self.low, self.k1, self.k2 = (np.zeros(0, np.int64) for _ in range(3))

    def join(self, a: Block, b: Block) -> None:
        for i, j, p, q in near_pairs(a.rows, b.rows, self.bound, a is b):
            a.links[i] += weighed(p, b.weight[j][q], a.home[i])
            b.links[j] += weighed(q, a.weight[i][p], b.home[j])
            left, right = self.low[a.at : a.at + a.n][i], self.low[b.at : b.at + b.n][j]
            apart = left[p] != right[q]
            if apart.any():
                ends, which = np.unique(np.concatenate([left, right]), return_inverse=True)
                moved = np.arange(len(self.low))
                moved[ends] = ends[lowest_linked(len(ends), which[: len(left)][p[apart]], which[len(left) :][q[apart]])]
                self.low = moved[self.low]

    def add(self, batch: pa.RecordBatch) -> Block:
        new = Block(batch, len(self.k1))
        self.low = np.concatenate([self.low, np.arange(new.at, new.at + new.n)])
        return new

    def keep(self, batch: pa.RecordBatch) -> None:
        new = self.add(batch)
        self.k1, self.k2 = (np.concatenate([k, new.told.column(c).to_numpy()]) for k, c in ((self.k1, "k1"), (self.k2, "k2")))
        self.blocks.append(new)
        if self.part == 0:
            for block in self.blocks:
                self.join(block, new)

    def stream(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """What was found of rows that are not kept; each leads to one that is."""
        new = self.add(batch)
        for block in self.blocks:
            self.join(block, new)
        found = self.found(new, self.low[new.at :] < new.at)
        self.low = self.low[: new.at]
        return found

    def kept(self) -> Iterator[pa.RecordBatch]:
        """What was found of the rows that are kept and have links or equals."""
        for block in self.blocks:
            places = np.arange(block.at, block.at + block.n)
            yield self.found(block, (block.links > 0) | (self.low[places] != places) | (block.weight > 1))

    def found(self, block: Block, some: np.ndarray) -> pa.RecordBatch:
        """Their keys, weight and links found, and the keys of what they lead to."""
        to = self.low[block.at : block.at + block.n][some]
        told = block.told.filter(pa.array(some))
        columns = [*told.columns, pa.array(block.links[some]), pa.array(self.k1[to]), pa.array(self.k2[to])]
        return pa.RecordBatch.from_arrays(columns, [*told.schema.names, "links", "t1", "t2"])


def linked_entries(entries: Entries, bound: float, width: int) -> DataFrame:
    """``k1``, ``k2``, ``weight``, ``first``, ``links`` and ``t1``, ``t2`` as found in the units, of entries with links or equals; an entry may stand in several."""
    reach = float(np.sqrt(2 - 2 * bound))
    pivots = chosen_pivots(entries, width, reach)
    sizes = saved(cell_sizes(entries, pivots, width, reach), "cells")
    keys = [*CELL, *UNIT, "streamed"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            new = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1 if batch.num_rows else ()
            for i, j in zip([0, *new], [*new, batch.num_rows]):
                run = batch.slice(i, j - i)
                *which, streamed = (v[i] for v in values)
                if which != last:
                    yield from now.kept() if now else ()
                    last, now = which, Unit(int(which[-1]), bound)
                if streamed:
                    yield now.stream(run)
                else:
                    now.keep(run)
        yield from now.kept() if now else ()

    units = units_of(spread(entries, pivots, reach), sizes)
    return units.mapInArrow(find, "k1 long, k2 long, weight long, first long, links long, t1 long, t2 long")


def group(vectors: DataFrame, bound: float = BOUND) -> DataFrame:
    """``vec_id``, ``n_links`` and ``component_id`` for every row."""
    given = vectors.schema["embedding"].dataType
    kind, width = ("float", 4) if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else ("double", 8)
    embedding = F.col("embedding").cast(f"array<{kind}>").alias("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding, F.col("label").cast("long").alias("label"))
    hashes = [F.xxhash64(*columns) for columns in (("label", "embedding"), ("embedding", "label"))]
    told = rows.withColumn("able", can_link())
    keys = saved(told.select("vec_id", *[F.when(F.col("able"), h).alias(k) for k, h in zip(("k1", "k2"), hashes)]), "keys")
    known = rows.where(can_link()).withColumns({"dims": F.size("embedding"), "k1": hashes[0], "k2": hashes[1]})
    entries = Entries(known, keys)
    found = saved(linked_entries(entries, bound, width), "found")
    nodes = found.groupBy("k1", "k2").agg(F.min("first").alias("first"), (F.sum("links") + F.max("weight") - 1).alias("n_links"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    a, b = nodes.select("k1", "k2", F.col("node").alias("a")), nodes.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("node").alias("b"))
    roots = components(found.where("k1 <> t1 OR k2 <> t2").join(a, ["k1", "k2"]).join(b, ["t1", "t2"]).select("a", "b"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = rooted.join(lowest, "root").select("k1", "k2", "n_links", "component_id")
    met = keys.where("k1 IS NOT NULL").join(told, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    linked = met.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component)
    rest = keys.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest)


def op9_embedding_range_join(vectors: DataFrame) -> DataFrame:
    found = group(vectors)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {BOUND}),
reach AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.b, reach.low FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
"""
