"""Quality rules: every rule is evaluated once into a bit, and policies read only the bits.

The ledger holds a document's measurements and the bits of the rules it breaks. A policy is a
set of rules with a version; it keeps a document when none of its bits is set. What a rule costs
on its own is counted from the ledger by bitwise aggregation, without reading a text again.

A null or empty text has no words and breaks the rule ``few_words``. Repeated rows stay, each with
its own result; a null ``doc_id`` is carried along. Only ``doc_id`` and ``text`` are read, so other
columns of any name do no harm. Windows are compared by a 64-bit hash of their three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.shared import SPACE, let, total, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_upper", "n_letters")

# A rule's place in this list is its bit; new rules go to the end, so old ledgers stay readable.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "exclamations": "10 * n_exclaim > 3 * n_words",
    "capitals": "n_letters >= 100 AND 100 * n_upper > 60 * n_letters",
    "long_words": "word_chars > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines"),
    3: (*BASE, "symbols", "repeated_lines", "exclamations", "capitals", "long_words", "short_words"),
}
LATEST = 3


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: int) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that the text holds twice or more."""

    def covered(starts: Column) -> Column:
        return total(
            F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))).cast("long"))
        )

    def repeated(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

    def count(w: Column) -> Column:
        return F.when(
            F.size(w) >= 4, let(let(F.sort_array(windows(w)), repeated), covered)
        ).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each text, all whole numbers."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    return read.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaim"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``, one bit for each rule a document breaks."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    found = bits[0]
    for b in bits[1:]:
        found = found.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", found)


def apply_policy(entries: DataFrame, policy: int = LATEST) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the version of the policy that decided."""
    broken = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    base = F.col("fail_bits").bitwiseAND(F.lit(sum(map(bit, BASE))).cast("long"))
    return entries.withColumns(
        {"base_failed": base != 0, "kept": broken == 0, "policy": F.lit(policy)}
    ).withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def ablation(entries: DataFrame, policy: int = LATEST) -> DataFrame:
    """For each rule of a policy: documents that break it, and those that only it keeps out.

    The ledger is reduced to one row for each pattern of bits, of which there are at most two to
    the number of rules.
    """
    of_policy = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    patterns = entries.groupBy(of_policy.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.inline(rules))
    broken, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(broken, F.col("n")).otherwise(0)).alias("n_broken"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
    )


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs)).select("doc_id", *MEASURES[:5], "base_failed", "kept", "fail_bits", "policy")


# The rules are whole-number comparisons that DuckDB reads as they stand.
_RULE_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
LEDGER_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
t AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM g),
rep AS (SELECT r, i FROM t QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(ls) AS n_lines, len(regexp_extract_all(text, '!')) AS n_exclaim,
             len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters
      FROM w LEFT JOIN cov ON w.r = cov.r),
l AS (SELECT *, CAST({_RULE_BITS} AS BIGINT) AS fail_bits FROM m)
"""
SQL = (
    LEDGER_SQL
    + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    fail_bits & {sum(map(bit, BASE))} <> 0 AS base_failed, fail_bits & {mask(LATEST)} = 0 AS kept,
    fail_bits, {LATEST} AS policy FROM l"""
)
ABLATION_SQL = (
    LEDGER_SQL
    + "SELECT rule, CAST(sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_broken, "
    + f"CAST(sum(CASE WHEN fail_bits & {mask(LATEST)} = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only FROM l, (VALUES "
    + ", ".join(f"('{r}', {bit(r)})" for r in POLICIES[LATEST])
    + ") AS rules(rule, bit) GROUP BY rule"
)
