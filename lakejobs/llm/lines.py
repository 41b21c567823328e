"""Line deduplication by a deletion-neighbourhood join.

A line with words is a duplicate when an earlier line, by ``doc_id`` and place, has the same words, or, from
``NEAR_WORDS`` words on, differs from it in at most one: one word changed, put in or left out. Every longer line emits the keys of its variants with one word deleted; two
lines within the bound have a variant in common, deleted at the same place, or one is a variant of
the other. Each key hands its members the earliest line it saw, which is compared word by word.

Only a line that shares its first or its last words with a different line can have such a
neighbour, since one edit leaves one end as it is. So short keys of both ends are counted first;
a bitmap of the keys that different lines share, of fixed size, tells the second pass which lines
need their variants, and another one which variants need to be joined: most belong to one line
only. A full bitmap would only let more through. Equal lines are one entry.

Lines are told apart by 128 bits. A null text stays null; blank lines stay. Rows that repeat both
``doc_id`` and text are one document and fare alike; a null ``doc_id`` comes first. Which lines of a document
stay is told by a bitmap of their places, so very long texts take no more than their length. Of a document whose
lines with words are all duplicates no word is left. ``doc_id`` and ``text`` are read, every other
column is handed on, whatever its name. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved

# Words that a line must have to be a duplicate with a word of difference.
NEAR_WORDS = 8
BITMAP_BITS = 1 << 25


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def end_keys(words: list[bytes]) -> list[int]:
    """Keys of a line's ends. Lines within one word have one in common, if both have words enough.

    An end is the largest power of two that is at most half of the words; a line that is just long enough for a
    larger end has those of a line one word shorter as well.
    """
    keys = []
    n = len(words)
    for size in {1 << (n // 2).bit_length() - 1, 1 << ((n - 1) // 2).bit_length() - 1}:
        for side, part in ((1, words[:size]), (2, words[-size:])):
            keys.append(signed(xxhash.xxh64_intdigest(b" ".join(part), 4 * size + side)))
    return keys


def lines_of(text: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    """(place, words) of the lines that can be duplicates."""
    for place, line in enumerate((text or b"").split(b"\n")):
        words = line.split()
        if words:
            yield place, words


def line_hash(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
    return signed(digest >> 64), signed(digest & (1 << 64) - 1)


def shared_keys(keys: DataFrame) -> np.ndarray:
    """A bitmap of the keys that different lines share, from (key, h); its size does not depend on the input."""
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    at = shared.select(F.pmod("key", F.lit(BITMAP_BITS)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    got = words.toArrow()
    bitmap[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return bitmap


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (BITMAP_BITS - 1)
    return (bitmap[at >> 6] >> (at & 63) & 1).astype(bool)


def shared_ends(docs: DataFrame) -> np.ndarray:
    """The bitmap of end keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                for _, words in lines_of(text):
                    if len(words) >= NEAR_WORDS:
                        own = end_keys(words)
                        keys += own
                        hashes += [line_hash(words)[0]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["key", "h"])

    return shared_keys(docs.select("text").mapInArrow(emit, "key long, h long"))


def distinct_lines(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """One row for each different line: ``h1``, ``h2``, its ``first`` place, and the line if it may have neighbours."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text_key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts):
                for place, words in lines_of(text):
                    near = len(words) >= NEAR_WORDS and in_bitmap(bitmap, np.array(end_keys(words))).any()
                    rows.append((*line_hash(words), doc_id, text_key, place, b" ".join(words) if near else None))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["h1", "h2", "doc_id", "text_key", "place", "line"])

    rows = docs.select("doc_id", "text_key", "text").mapInArrow(emit, "h1 long, h2 long, doc_id long, text_key long, place int, line binary")
    return rows.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "text_key", "place")).alias("first"), F.first("line", ignorenulls=True).alias("line")
    )


def variants(near: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """(key, at) of each line: itself at -1, and each variant with the word at ``at`` deleted.

    Without a bitmap only (key, h); with one, whole rows of the keys that are in it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            places: list[int] = []
            row: list[int] = []
            for i, line in enumerate(batch.column("line").to_pylist()):
                words = line.split()
                keys.append(signed(xxhash.xxh64_intdigest(line)))
                # The words before a place and those after it are cut from the line, which joins them by single spaces.
                begin = 0
                for at, word in enumerate(words):
                    end = begin + len(word)
                    cut = line[:begin] + line[end + 1 :] if end < len(line) else line[: max(0, begin - 1)]
                    keys.append(signed(xxhash.xxh64_intdigest(cut)))
                    begin = end + 1
                places += range(-1, len(words))
                row += [i] * (len(words) + 1)
            key, place, at = np.array(keys, np.int64), np.array(places, np.int32), np.array(row, np.int64)
            if bitmap is None:
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("h1").take(pa.array(at))], ["key", "h"])
            else:
                kept = np.flatnonzero(in_bitmap(bitmap, key))
                own = [batch.column(c).take(pa.array(at[kept])) for c in ("h1", "h2", "first")]
                yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(place[kept]), *own], ["key", "at", "h1", "h2", "first"])

    first = "struct<doc_id:long,text_key:long,place:int>"
    schema = "key long, h long" if bitmap is None else f"key long, at int, h1 long, h2 long, first {first}"
    return near.select("h1", "h2", "first", "line").mapInArrow(emit, schema)


def within_one_word(a: bytes, b: bytes) -> bool:
    """Whether two lines differ in at most one word changed, put in or left out."""
    a, b = a.split(), b.split()
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return len(a) <= 1 and len(b) <= 1


def near_duplicates(lines: DataFrame) -> DataFrame:
    """``h1``, ``h2`` of the lines whose first place has an earlier neighbour."""
    near = lines.where("line IS NOT NULL")
    rows = saved(variants(near, shared_keys(variants(near))), "variants")
    member = F.struct("first", "h1", "h2")
    # Of a key: the earliest whole line, the earliest line with any word deleted, and with the word at the same place deleted.
    earliest = rows.groupBy("key", "at").agg(F.min(member).alias("same"))
    by_key = rows.groupBy("key").agg(
        F.min(F.when(F.col("at") < 0, member)).alias("whole"), F.min(F.when(F.col("at") >= 0, member)).alias("cut")
    )
    met = rows.join(earliest, ["key", "at"]).join(by_key, "key")
    partners = F.explode(F.array(F.col("same"), F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole"))))
    pairs = met.select("h1", "h2", "first", partners.alias("p")).where(F.col("p.first") < F.col("first"))
    pairs = pairs.select("h1", "h2", F.col("p.h1").alias("p1"), F.col("p.h2").alias("p2")).distinct()
    texts = near.select("h1", "h2", "line")
    earlier = texts.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("other"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines_, others = batch.column("line").to_pylist(), batch.column("other").to_pylist()
            yield batch.select(["h1", "h2"]).filter(pa.array([within_one_word(a, b) for a, b in zip(lines_, others)], pa.bool_()))

    both = pairs.join(texts, ["h1", "h2"]).join(earlier, ["p1", "p2"]).select("h1", "h2", "line", "other")
    return both.mapInArrow(verify, "h1 long, h2 long").distinct()


def firsts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and a bitmap of the ``places`` of a document's lines that are not duplicates."""
    lines = saved(distinct_lines(docs, shared_ends(docs)), "lines")
    kept = lines.join(saved(near_duplicates(lines), "near"), ["h1", "h2"], "left_anti")
    key = ["doc_id", "text_key"]
    bits = F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits")
    parts = kept.select("first.*").groupBy(*key, F.floor(F.col("place") / 64).cast("int").alias("at")).agg(bits)
    told = parts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("bits"), F.max("at").alias("last"))
    places = F.transform(F.sequence(F.lit(0), F.col("last")), lambda at: F.coalesce(F.try_element_at("bits", at), F.lit(0).cast("long")))
    return told.select(*key, places.alias("places"))


def without_duplicates(text: Column, places: Column) -> tuple[Column, Column]:
    """The text without its duplicate lines, and how many they are."""
    lines = F.split(text, "\n", -1)

    def stays(line: Column, i: Column) -> Column:
        part = F.coalesce(F.get(places, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return ~line.rlike(r"[^\x20\x09-\x0D]") | (F.getbit(part, i % 64) == 1)

    kept = F.filter(lines, stays)
    return F.array_join(kept, "\n"), (F.size(lines) - F.size(kept)).cast("long")


def dedup(docs: DataFrame) -> DataFrame:
    """Every row with ``row``, its columns as they came, the clean text as ``cleaned``, and ``n_dropped``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", whole.alias("row"))
    places = firsts(rows.select("doc_id", "text_key", "text"))
    told = places.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "places")
    narrow = rows.select("doc_id", "text_key", "row")
    met = narrow.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    none = F.array().cast("array<long>")
    cleaned, dropped = without_duplicates(F.col("row.text"), F.coalesce("places", none))
    return met.select("doc_id", "row", cleaned.alias("cleaned"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents with clean texts and lengths; those that have lost their last word are left out."""
    found = dedup(docs)
    word = r"[^\x20\x09-\x0D]"
    left = found.where((F.col("n_dropped") == 0) | F.col("cleaned").rlike(word))
    new = {"text": F.col("cleaned"), "n_chars": F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("cleaned").cast("long")) if "n_chars" in docs.columns else None}
    return left.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    found = dedup(docs)
    return found.select(
        "doc_id", F.size(F.split(F.coalesce("row.text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), "n_dropped",
        F.col("cleaned").alias("text"),
    )
