"""Near duplicates by SimHash, found in a hierarchical index in Gray order.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Two
fingerprints link when they differ in few bits. Equal fingerprints are one entry. Entries are
dealt into cells: with ``distance + g`` blocks of bits, two linked entries agree in at least ``g``
blocks, so the two meet in the cell of some choice of ``g`` blocks. Inside a cell entries are
sorted by Gray rank, so neighbours share long bit patterns; groups of neighbours are nodes that
hold the bits all their entries share, and nodes above hold what their nodes share. A search adds up
differences from the top and leaves out every group whose shared bits already differ too much.
Cells too large for one task are cut into pairs of pieces. Every task hands on a spanning set of
the links it found, not all pairs, and components are built from those.

A null or empty text has no shingles and fingerprint zero, linked like any other. Equal texts and
repeated rows share a fingerprint and so a component; a null ``doc_id`` counts as larger than any
other and is smallest only of its own kind. Only ``doc_id`` and ``text`` are read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakejobs.llm.graph import components, in_units, lowest_linked, runs
from lakejobs.llm.shared import saved

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
UNIT_ROWS = 2048
LEAF, FAN = 16, 8
# Rows a cell should hold on average; more fingerprints use choices of more blocks.
CELL_ROWS = 512


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as a signed number of 64 bits.

    ``bytes.lower`` changes A to Z only and ``bytes.split`` splits at ASCII white space only.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    n = max(1, len(words) - size + 1)
    ends = starts[size : size + n] - 1 if len(words) >= size else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), list(map(int, ends)))), np.uint64, n
    )
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carried``, and ``fp``, the fingerprint as a long."""
    names = ["doc_id", *carried]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            values = np.fromiter((fingerprint(t, size) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(values)], [*names, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, "text")
    return rows.mapInArrow(read, StructType([*rows.drop("text").schema.fields, StructField("fp", LongType())]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shared_bits(codes: np.ndarray, starts: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For groups of neighbours, the mask of bits that all entries share, and those bits.

    ``within`` are masks of the groups' parts, if the groups hold nodes.
    """
    first = np.repeat(codes[starts], np.diff(np.append(starts, len(codes))))
    differ = codes ^ first
    if within is not None:
        differ |= ~within
    mask = ~np.bitwise_or.reduceat(differ, starts)
    return mask, codes[starts] & mask


def search(queries: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in queries, place in codes) of all pairs within the distance; ``codes`` in Gray order."""
    leaves = np.arange(0, len(codes), LEAF)
    leaf_mask, leaf_bits = shared_bits(codes, leaves)
    tops = np.arange(0, len(leaves), FAN)
    top_mask, top_bits = shared_bits(leaf_bits, tops, leaf_mask)
    # Differences in a node's own bits come on top of those in the bits of the node above.
    own_mask = leaf_mask & ~np.repeat(top_mask, np.diff(np.append(tops, len(leaves))))
    found_q, found_c = [], []
    for at in range(0, len(queries), 4096):
        q = queries[at : at + 4096]
        so_far = np.bitwise_count((q[:, None] ^ top_bits) & top_mask)
        qi, ti = np.nonzero(so_far <= distance)
        so_far = so_far[qi, ti]
        child = (ti * FAN)[:, None] + np.arange(FAN)
        real = child < len(leaves)
        child = np.minimum(child, len(leaves) - 1)
        below = so_far[:, None] + np.bitwise_count((q[qi][:, None] ^ leaf_bits[child]) & own_mask[child])
        r, c = np.nonzero((below <= distance) & real)
        li, qi = child[r, c], qi[r]
        for part in range(0, len(li), 1 << 16):
            a, b = qi[part : part + (1 << 16)], li[part : part + (1 << 16)]
            entry = (b * LEAF)[:, None] + np.arange(LEAF)
            real = entry < len(codes)
            entry = np.minimum(entry, len(codes) - 1)
            r, c = np.nonzero((np.bitwise_count(q[a][:, None] ^ codes[entry]) <= distance) & real)
            found_q.append(a[r] + at)
            found_c.append(entry[r, c])
    return np.concatenate(found_q), np.concatenate(found_c)


def unit_links(codes: np.ndarray, mine: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links in one unit: of pairs inside a piece, or of pairs across two."""
    codes = codes.view(np.uint64)
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, mine = codes[order], mine[order]
    across = mine.min() != mine.max()
    if len(codes) <= 64:
        a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes) <= distance, 1))
        if across:
            apart = mine[a] != mine[b]
            a, b = a[apart], b[apart]
    else:
        left = np.flatnonzero(mine == mine.min())
        right = np.flatnonzero(mine == mine.max())
        a, b = search(codes[left], codes[right], distance)
        a, b = left[a], right[b]
    label = lowest_linked(len(codes), a, b)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved].view(np.int64), codes[label[moved]].view(np.int64)


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of bits, one of which two entries within the distance share, as signed longs.

    The more entries, the more blocks a mask takes, so that cells do not grow with the corpus.
    """
    g = 1
    while n / 2 ** (64 * g // (distance + g)) > CELL_ROWS and g < 4:
        g += 1
    cuts = [64 * i // (distance + g) for i in range(distance + g + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, g)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(entries: DataFrame, distance: int = DISTANCE, cap: int = UNIT_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that are within the distance."""
    masks = block_masks(entries.count(), distance)
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)
    ]))
    keys = ["choice", "bits", "pa", "pb"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, cuts in runs(batches, keys):
            codes, mine = whole.column("fp").to_numpy(), whole.column("mine").to_numpy()
            got = [unit_links(codes[i:j], mine[i:j], distance) for i, j in cuts if j - i > 1]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*got)], ["a", "b"])

    units = in_units(entries.select("fp", cells), ["choice", "bits"], "fp", cap)
    return units.mapInArrow(find, "a long, b long")


def group(docs: DataFrame, size: int = SHINGLE_WORDS, distance: int = DISTANCE, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carried``, ``fp``, ``root`` and ``component_id``, the smallest id that links lead to.

    ``root`` is a component's own; components whose rows share an id, or have none, may have the same ``component_id``.
    """
    marked = saved(fingerprints(docs, size, carried), "fingerprints")
    entries = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "entries")
    roots = components(links(entries, distance))
    rooted = entries.join(roots, entries["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_entry = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(of_entry, "fp").select("doc_id", *carried, "fp", "root", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    code = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return group(docs).select("doc_id", code, "component_id")
