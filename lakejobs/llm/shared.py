"""Helpers of the operators: tables, stored intermediates, and expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.session import new_path

# White space of all contracts: the space and the characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
# Bytes of texts whose words a task holds at once, besides a longer text.
SLICE_BYTES = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written to the folder all executors share, and read again: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, which are what stands between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first text, texts) of at most so many bytes, or one text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, the place among them of each word of the texts, and how many words each text has.

    The white space is that of all contracts. There may be an empty word among the different ones.
    """
    split = pc.ascii_split_whitespace(texts)
    found = split.flatten().dictionary_encode()
    words, which = found.dictionary, found.indices.to_numpy()
    # White space at the ends of a text leaves empty words there.
    full = (pc.binary_length(words).to_numpy() > 0)[which]
    before = np.append(0, np.cumsum(full))
    ends = np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return words, which[full], np.diff(before[np.append(0, ends)])


def listed_bytes(words: pa.Array) -> list[bytes]:
    """The bytes of each word; several times faster than ``to_pylist``."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(values: Column, block: int = 128) -> Column:
    """For each place of an array of longs, the sum of what stands before it.

    Sums of blocks come first, so the work is not the square of the length.
    """

    def places(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def of(v: Column) -> Column:
        blocks = F.ceil(F.size(v) / block).cast("int")
        sums = F.transform(places(blocks), lambda b: total(F.slice(v, b * block + 1, F.lit(block))))
        return let(
            let(sums, lambda s: F.transform(places(F.size(s)), lambda b: total(F.slice(s, F.lit(1), b)))),
            lambda starts: F.transform(
                places(F.size(v)),
                lambda i: F.get(starts, F.floor(i / block).cast("int"))
                + total(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block)),
            ),
        )

    return let(values, of)
