"""Phrase mining: word sequences that occur together more than their parts would.

Three passes, of which the first two find candidates and the third counts them:

1. Every task numbers the words of its texts and hashes every phrase of one to four words. Equal
   hashes of a chunk are counted, and the counts are dealt out by the first bits of the hash.
2. Each hash partition merges its counts into a Misra-Gries summary. Its capacity is more than the
   partition's mass (all occurrences) divided by the threshold. Whenever the merged counters are
   more than the capacity, the largest counter that does not fit is taken off all; each unit taken off
   costs at least capacity + 1 occurrences, so all that is ever taken off stays below the threshold.
   A phrase that is frequent enough so always survives; phrases that share a hash only add to it.
   Survivors set bits of a bitmap of fixed size.
3. The texts are read again and every phrase whose bit is set is counted by its words, not by its
   hash: exactly. A bit set by chance costs a row in the shuffle; a full bitmap, on very large
   input, lets everything through to the exact count.

Frequent parts of a frequent phrase are frequent, so the counts of parts are among those of the
third pass. Scores are integers, divided as decimals. The best rows of a language are taken in two
steps, so no task sorts all phrases of a language.

A null text is empty, a null ``lang`` is ``und``. Very long texts are read block by block. Repeated rows
count each time. Ties are ordered by the bytes of the phrase. Only ``text`` and ``lang`` are read,
so other columns may have any name. No rows give no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved

LEAST = 30
LONGEST = 4
TOP = 2000
# A phrase inside a longer one with so many per cent of its occurrences is dropped.
CONTAINED = 80
SCALE = 2_000_000
UNKNOWN = "und"
# Text bytes of one hash partition, and how many partitions there may be.
PART_BYTES, PART_BITS = 1 << 24, (4, 16)
# Bits of the bitmap of survivors.
MAP_BITS = 25
# Tokens of a chunk, bytes of a block of text, words that are kept numbered from chunk to chunk.
CHUNK_TOKENS, BLOCK_BYTES, KEPT_WORDS = 600_000, 1 << 20, 150_000
# A number of a word in a key of three; the three limits above keep it.
WORD_BITS = 21
# Hashes in one row of the shuffle: a batch of rows, which Spark counts by rows, is held twice on its way to Python.
ROW_CODES = 512
# Counted phrases that become Python values at once.
BATCH_PHRASES = 1 << 15
# A byte that UTF-8 does not use stands between pieces.
CUT = b"\xff"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + CUT * 10)
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Numbers(dict):
    """The numbers of one language's words, given out as words come."""

    def __init__(self, lang: str, place: int, words: Words) -> None:
        super().__init__({CUT: 0})
        self.place, self.words = place, words
        self.seed = xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words.word)
        self.words.word.append(word)
        self.words.lang.append(self.place)
        self.words.hash.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


class Words:
    """Word, language (its place in ``langs``) and hash of every number; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.word, self.lang, self.hash = [b""], array("i", [0]), array("Q", [0])
        self.langs: list[str] = []
        self.numbers: dict[str, Numbers] = {}

    def of(self, lang: str) -> Numbers:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(lang, len(self.langs), self)
            self.langs.append(lang)
        return self.numbers[lang]


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and the cuts between its pieces, some at a time."""
    text = text.translate(LOWER)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(CUT, b" \xff ").split()
        at = end


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    """Numbers of words; each chunk ends with the first LONGEST - 1 places of the next one."""
    words, parts, size = Words(), [], 0

    def flush(words: Words, parts: list[np.ndarray]) -> tuple[Words, np.ndarray]:
        flat = np.concatenate(parts)
        rest = flat[-(LONGEST - 1) :]
        if len(words.word) > KEPT_WORDS:
            fresh = Words()
            rest = np.array([fresh.of(words.langs[words.lang[i]])[words.word[i]] if i else 0 for i in rest.tolist()], np.int64)
            return fresh, flat, rest
        return words, flat, rest

    ends = np.zeros(LONGEST - 1, np.int64)
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            # One row at a time becomes a Python value, so a batch is held once.
            lang = lang.as_py()
            numbers = words.of(lang)
            for found in blocks(text.as_py() or b""):
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                size += len(found)
                if size >= CHUNK_TOKENS:
                    now = words
                    words, flat, rest = flush(words, parts)
                    yield now, flat
                    numbers, parts, size = words.of(lang), [rest], 0
            parts.append(ends[:1])
    if parts:
        yield words, np.concatenate([*parts, ends])


def phrase_hashes(words: Words, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which places of a chunk begin a phrase of it, and a hash for every place."""
    starts = len(flat) - (LONGEST - 1)
    own = np.array(words.hash, np.uint64)[flat]
    inside = flat > 0
    code, whole = own[:starts], inside[:starts]
    for size in range(1, LONGEST + 1):
        if size > 1:
            code = code * ROLL + own[size - 1 : size - 1 + starts]
            whole = whole & inside[size - 1 : size - 1 + starts]
        mixed = (code ^ code >> np.uint64(29)) * MIX
        yield whole, mixed ^ mixed >> np.uint64(32)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))


def dealt_counts(texts: DataFrame, bits: int) -> DataFrame:
    """Counted hashes by partition: rows of ``codes`` and ``counts``, and before them (``at`` -1) every task's mass."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "at", "mass", "codes", "counts"]
        mass = np.zeros(1 << bits, np.int64)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
        at = TaskContext.get().partitionId() << 36
        for words, flat in chunks(batches):
            # One length after the other: a quarter of the memory, and different lengths share hardly any hash.
            for whole, mixed in phrase_hashes(words, flat):
                keys, counts = np.unique(mixed[whole] >> np.uint64(32 - bits), return_counts=True)
                cuts = np.searchsorted(keys, edges).tolist()
                mass += np.diff(np.append(0, np.cumsum(counts))[cuts])
                codes, counts = keys.astype(np.uint32), counts.astype(np.uint32)
                rows = [(p, i, min(i + ROW_CODES, b)) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) for i in range(a, b, ROW_CODES)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in rows], pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.nulls(n, pa.int64()),
                        *[pa.array([v[i:j].tobytes() for _, i, j in rows], pa.binary()) for v in (codes, counts)],
                    ],
                    names,
                )
                at += n
        seen = np.flatnonzero(mass)
        n = len(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array([-1] * n, pa.int64()), pa.array(mass[seen]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names
        )

    return texts.mapInArrow(emit, "part int, at long, mass long, codes binary, counts binary")


class Summary:
    """A Misra-Gries summary: counters, and how much was taken off all of them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        codes, counts = np.concatenate((self.codes, codes)), np.concatenate((self.counts, counts.astype(np.int64)))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        self.codes = codes[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        over = len(self.counts) - self.capacity
        if over > 0:
            # The largest counter that does not fit.
            off = int(np.partition(self.counts, over - 1)[over - 1])
            left = self.counts > off
            self.codes, self.counts = self.codes[left], self.counts[left] - off
            self.lost += off

    def frequent(self, least: int) -> np.ndarray:
        """All codes that may have occurred ``least`` times."""
        return self.codes[self.counts + self.lost >= least]


def survivors(counts: DataFrame, bits: int, least: int) -> DataFrame:
    """The bits of phrases that may be frequent; sorted partitions are merged one after the other."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary, mass, codes, amounts, size = None, None, 0, [], [], 0

        def fold() -> None:
            nonlocal summary, codes, amounts, size
            summary = summary or Summary(mass // least + 1)
            if codes:
                summary.merge(np.frombuffer(b"".join(codes), np.uint32), np.frombuffer(b"".join(amounts), np.uint32))
            codes, amounts, size = [], [], 0

        def out() -> pa.RecordBatch:
            fold()
            keys = np.uint64(part) << np.uint64(32) | summary.frequent(least).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32 + bits - MAP_BITS)).astype(np.int64))], ["bit"])

        for batch in batches:
            parts, masses = batch.column("part").to_pylist(), batch.column("mass").to_pylist()
            for p, m, c, n in zip(parts, masses, batch.column("codes"), batch.column("counts")):
                if p != part:
                    if part is not None:
                        yield out()
                    part, summary, mass, codes, amounts, size = p, None, 0, [], [], 0
                if m is not None:
                    mass += m
                else:
                    codes.append(c.as_py())
                    amounts.append(n.as_py())
                    size += len(codes[-1]) // 4
                    if size >= max(mass // least, 1 << 18):
                        fold()
        if part is not None:
            yield out()

    dealt = counts.repartition("part").sortWithinPartitions("part", "at")
    return dealt.mapInArrow(merge, "bit long")


def bitmap_of(bits: DataFrame) -> np.ndarray:
    """The bits as an array of bytes of a fixed length."""
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("set"))
    found = words.toArrow()
    bitmap = np.zeros((1 << MAP_BITS) // 64, np.int64)
    bitmap[found.column("at").to_numpy()] = found.column("set").to_numpy()
    return bitmap.view(np.uint8)


def exact_counts(texts: DataFrame, bitmap: np.ndarray, least: int) -> DataFrame:
    """``lang``, ``phrase`` (bytes), ``size`` and ``f`` of all phrases that are frequent; ``size`` 0 has all words of a language."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, flat in chunks(batches):
            starts = len(flat) - (LONGEST - 1)
            own = flat[:starts]
            number = np.bincount(np.array(words.lang)[own[own > 0]], minlength=len(words.langs)).tolist()
            yield batch_of(words.langs[: len(number)], [None] * len(number), [0] * len(number), number)
            for size, (whole, mixed) in enumerate(phrase_hashes(words, flat), 1):
                bit = mixed >> np.uint64(64 - MAP_BITS)
                at = np.flatnonzero(whole & (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
                key = flat[at]
                for k in range(1, size):
                    if k * WORD_BITS + WORD_BITS > 63:
                        key = np.unique(key, return_inverse=True)[1].ravel()
                    key = key << WORD_BITS | flat[at + k]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                word = words.word
                for i in range(0, len(first), BATCH_PHRASES):
                    places = at[first[i : i + BATCH_PHRASES]]
                    found = [flat[places + k].tolist() for k in range(size)]
                    phrases = [b" ".join([word[i] for i in own]) for own in zip(*found)]
                    yield batch_of([words.langs[words.lang[i]] for i in found[0]], phrases, [size] * len(places), n[i : i + BATCH_PHRASES])

    def batch_of(lang, phrase, size, f) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), pa.array(size, pa.int32()), pa.array(f, pa.int64())], ["lang", "phrase", "size", "f"]
        )

    rows = texts.mapInArrow(emit, "lang string, phrase binary, size int, f long")
    counted = rows.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | (F.col("size") == 0)).withColumn("phrase", F.col("phrase").cast("string"))


def part_of(words: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Every phrase of two words and more with its worst cut: ``a``, ``l``, ``r`` and ``score``."""
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    own = F.split("phrase", " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part_of(own, F.lit(1), F.col("k")).alias("first"), part_of(own, F.col("k") + 1, F.col("size")).alias("rest"))
    known = counts.where("size > 0")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"(cast(a AS decimal(20, 0)) * {SCALE}) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    worst = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    return met.groupBy("lang", "phrase", "size", "a").agg(worst).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def outside_longer(phrases: DataFrame) -> DataFrame:
    """Without the phrases that stand inside a longer one nearly as often."""
    own = F.split("phrase", " ")
    longer = phrases.where("size > 2").select("lang", "size", "a", own.alias("words"))
    sizes = longer.withColumn("part", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    places = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    parts = places.select("lang", part_of(F.col("words"), F.col("at"), F.col("part")).alias("phrase"), "a")
    most = parts.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    met = phrases.join(most, ["lang", "phrase"], "left")
    return met.where(F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * CONTAINED)).drop("around")


def best_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ``rank``.

    Each of some parts gives its own first ones; with about the square root of the rows as parts, the parts and
    what they hand on are of a size.
    """
    parts = 1 + int((phrases.count() / top) ** 0.5)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("salt")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the best phrases of each language."""
    texts = texts_of(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    low, high = PART_BITS
    bits = min(high, max(low, (size // PART_BYTES).bit_length()))
    bitmap = bitmap_of(survivors(dealt_counts(texts, bits), bits, least))
    counts = saved(exact_counts(texts, bitmap, least), "counts")
    phrases = saved(outside_longer(scored(counts)), "phrases")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best_of_each(phrases, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(docs: DataFrame) -> DataFrame:
    return mine(docs)


SQL = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, {LONGEST + 1}) AS s(size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= {LEAST}),
cut AS (SELECT *, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cut.*, x.f AS l, y.f AS r, {SCALE} * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS around FROM (
  SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS i FROM c, range(2, {LONGEST}) AS q(m) WHERE m < size) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.around IS NULL OR 100 * i.around < {CONTAINED} * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= {TOP}
"""
