"""Packing documents into sequences, best fit decreasing.

Longer pieces are placed first, each into the open sequence that it fills most tightly; a segment
tree over remaining capacities names that capacity in logarithmic time. Pieces of one length are
alike, so the whole corpus is packed from its count of pieces by length: a table of at most
``capacity`` numbers, which is all the driver sees. A run of pieces of one length goes into a run of
sequences of one remaining capacity at once, and the result is a list of such runs. Each piece
then finds its place by its rank among the pieces of its length. The packing is that of one
best-fit-decreasing pass over the whole corpus, however many tasks there are.

A null or empty text is a document of the end id alone. A document is cut only if it is longer than a
sequence. Repeated rows are packed like different documents. Only ``doc_id`` and ``text`` are read.
No rows give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakejobs.llm.shared import listed_bytes, numbered_words, saved, text_slices
from lakejobs.operators.skew import stored_rows

CAPACITY = 2048
END = np.array([0], "<u4").tobytes()
# Kept ids of parts of words, and of words that are read alone, in a worker; beyond that the store starts anew.
KEPT_PARTS, KEPT_WORDS = 200_000, 50_000
# Bytes of texts whose words and ids a worker holds at once, besides a longer text.
SLICE_BYTES = 1 << 22
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters that are composed and have one lower-case form wherever they stand, and how the tokenizer cuts words of them,
# lower-case, with the spaces between the words.
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+| ")
# What stands for a space among ids, which are all below 65,536.
SPACE = b"\xff\xff\xff\xff"
# The vocabulary writes a byte as its own character where that can be seen, the others in order from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = dict(zip([b for b in range(256) if b not in _SEEN], range(256, 512)))


class Parts(dict):
    """The ids of one part of a word, lower-case and composed, by the merges alone."""

    def __init__(self, model: object) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, text: str) -> bytes:
        seen = text if text.isascii() else text.encode().decode("latin-1").translate(BYTES)
        ids = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes() if text != " " else SPACE
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[text] = ids
        return ids


class Words:
    """The ids of a word between white space, as bytes of little-endian 32-bit numbers.

    White space ends a word for the tokenizer too, so a text's ids are those of its words. A word of
    printable ASCII and Latin letters is cut into parts as the tokenizer does, and the parts go to its merges alone. So do
    other letters and the punctuation around them, unless composing or lower-casing the letters leaves a mark
    behind, which would join the punctuation; all else is read by the tokenizer as it stands.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Parts(self.tokenizer.model)
        self.others: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def latin(self, text: str) -> bytes:
        """The ids of words of LATIN, with SPACE between them."""
        return b"".join(map(self.parts.__getitem__, LATIN_PARTS.findall(text.lower())))

    def mixed(self, text: str) -> bytes:
        """The ids of another word."""
        right = text.rstrip(PUNCTUATION)
        inner = right.lstrip(PUNCTUATION)
        letters = unicodedata.normalize("NFC", inner).lower()
        # A final capital sigma is lower-cased by its place in the word.
        if not letters.isalpha() or not inner.isalpha() or "\u03a3" in inner or "<|" in text:
            return self.ids(text)
        return self.latin(text[: len(right) - len(inner)]) + self.parts[letters] + self.latin(text[len(right) :])

    def other(self, text: str) -> bytes:
        ids = self.others.get(text)
        if ids is None:
            if len(self.others) >= KEPT_WORDS:
                self.others.clear()
            self.others[text] = ids = self.mixed(text)
        return ids

    def __getitem__(self, word: bytes) -> bytes:
        return self.of([word])[0]

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, those of LATIN read together."""
        texts = b" ".join(words).decode().split(" ")
        plain = [LATIN.fullmatch(text) is not None and "<|" not in text for text in texts]
        read = iter(self.latin(" ".join(compress(texts, plain))).split(SPACE))
        return [next(read) if p else self.other(text) for text, p in zip(texts, plain)]


_WORDS: dict[str, Words] = {}


def words_of_worker(path: str) -> Words:
    """One store of words for all tasks that a worker runs."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def tokens_of(texts: pa.Array, known: Words) -> Iterator[bytes]:
    """The ids of each text and the end id, as bytes; a null text has the end id alone."""
    for _, some in text_slices(texts, SLICE_BYTES):
        words, which, sizes = numbered_words(some)
        ids = known.of(listed_bytes(words))
        ends = np.cumsum(sizes).tolist()
        # A special token may hold no white space but stand anywhere: then the whole text is read at once.
        special = pc.match_substring(some, "<|").to_pylist()
        for i, (begin, end) in enumerate(zip([0, *ends], ends)):
            tokens = known.ids(some[i].as_py()) if special[i] else b"".join(map(ids.__getitem__, which[begin:end].tolist()))
            yield tokens + END


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, place: Column | None = None) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every document; with ``place`` that too."""
    step = 4 * capacity
    carried = [] if place is None else [place.cast("long").alias("place")]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["place"] if carried else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of_worker(path)
        for batch in batches:
            rows: list[tuple] = []
            kept = zip(*[batch.column(c).to_pylist() for c in ["doc_id", *names[5:]]])
            for (doc_id, *own), tokens in zip(kept, tokens_of(batch.column("text"), known)):
                for k, at in enumerate(range(0, len(tokens), step)):
                    part = tokens[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *own))
            columns = list(zip(*rows)) or [()] * len(names)
            types = [pa.int32() if c == "piece" else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    return rows.mapInArrow(cut, ", ".join(f"{c} {'int' if c == 'piece' else 'long'}" for c in names))


class Capacities:
    """A segment tree over remaining capacities: which is the smallest open one of at least so much?"""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) of a best-fit-decreasing packing.

    Pieces of a length that go on into the same sequence stand behind each other in it, as the
    sequence with the least room that still fits is always the one that was just added to.
    """
    tree, rooms = Capacities(capacity), {}
    sequences, out = 0, []

    def leave(room: int, first: int, number: int) -> None:
        if number and room:
            rooms.setdefault(room, []).append((first, number))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            else:
                first, number = rooms[room].pop()
                if not rooms[room]:
                    tree.put(room, False)
            each = room // length
            used = min(number, -(-left // each))
            leave(room, first + used, number - used)
            taken = min(left, used * each)
            full = taken // each
            for layer in range(each):
                wide = full + (1 if full < used and taken - full * each > layer else 0)
                if wide:
                    out.append((length, rank, wide, first, capacity - room + layer * length))
                    rank += wide
            leave(room - each * length, first, full)
            if full < used:
                leave(room - (taken - full * each) * length, first + full, 1)
            left -= taken
    return out


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """The pieces with their ``rank`` among those of their length, which follows ``place`` where they have one.

    A length that many pieces have is numbered in parts: counts of the parts come first. Places are numbers from 0
    without gaps, one a document, so ranges of them are parts.
    """
    parts = max(64, total // 100_000)
    part, order = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)), ["doc_id", "piece", "ids_crc32"]
    if "place" in cut.columns:
        part, order = F.floor(F.col("place") / max(1, -(-total // parts))), ["place", "piece"]
    dealt = cut.withColumn("part", part.cast("int"))
    counted = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy(*order)
    return dealt.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1).drop("part", "before")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number from 0 in this order, which no two share; stored.

    They are sorted in ranges, and what stands before a range is the sum of the ranges before.
    """
    ordered = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shuffle partition.
    starts = ordered.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    made = ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    return made.drop("_part", "_start")


def stored_places(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The documents as they are stored, and the place of each in the order of the files' names and of the rows in them."""
    stored = stored_rows(docs)
    file = F.col("_metadata.file_name")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file.
    files = stored.groupBy(file.alias("file")).agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = stored.select("doc_id", "text", file.alias("file"), F.col("_metadata.row_index").alias("at"))
    return rows.join(F.broadcast(files), "file"), F.col("first") + F.col("at")


def pack_in_order(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` for documents whose order in the stored files counts, such as that of a mixture.

    There are as few sequences. Pieces of one length go to places in the order of their documents, and
    sequences are numbered in the order of their first documents.
    """
    rows, place = stored_places(docs)
    packed = saved(pack(rows, path, capacity, place), "packed")
    first = packed.groupBy("sequence_id").agg(F.min(F.struct("place", "piece")).alias("first"))
    turns = numbered(first, ["first"], "turn").select("sequence_id", "turn")
    return packed.join(turns, "sequence_id").withColumn("sequence_id", F.col("turn")).select(*[c for c in packed.columns if c != "place"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, place_of: Column | None = None) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. The token pass is run once and stored, without texts.

    With ``place_of`` it comes as ``place``, and pieces of one length are placed in that order.
    """
    cut = saved(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity, place_of), "pieces")
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    plan = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 5)
    # The runs of a length follow each other in rank, so a piece finds its run by bisection.
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    lengths = np.unique(plan[:, 0])
    starts = np.searchsorted(plan[:, 0], lengths)
    ends = np.append(starts[1:], len(plan))

    cut_names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                k = np.searchsorted(lengths, value)
                here = length == value
                run[here] = starts[k] + np.searchsorted(plan[starts[k] : ends[k], 1], rank[here], side="right") - 1
            sequence = plan[run, 3] + rank - plan[run, 1]
            kept = [batch.column(c) for c in cut_names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(plan[run, 4])], [*cut_names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {'int' if c == 'piece' else 'long'}" for c in [*cut_names, "sequence_id", "offset"])
    rows = ranked(cut, sum(counts.values())).select(*cut_names, F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(place, schema)


def op6_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
