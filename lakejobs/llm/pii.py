"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Wider patterns propose
further spans of the same kinds: spaced or spelled-out addresses, long IP addresses, grouped card
numbers and national phone numbers. Labelers look at every proposed span and vote +1, 0 or -1:
the base rule, the inner structure (check digit, parts), a gazetteer, the words before it, words
that speak against it, and the characters around it. Expectation-maximisation over the counted vote
patterns of each kind estimates how reliable each labeler is, without any labels; its estimates
train a logistic classifier of the votes, which decides about the proposed spans. Base spans stay.

The driver sees the counted patterns only: at most four kinds times three to the number of
labelers. Everything on rows is an expression over the row; there is no shuffle of texts.

A null text is an empty one. Very long texts are read whole, in time that grows with the text and its spans. Repeated rows stay, each with its own result. Only ``doc_id`` and
``text`` are read, so other columns of any name do no harm. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.shared import let, saved, sums_before

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive repeats and a start that cannot lie inside a run of the same characters find the same
# spans as the plain patterns, in time that grows with the text. A span can also start where the last ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:\x20?@\x20?|\x20?[\[(]\x20?at\x20?[\])]\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl|pl|ru|jp|cn|br|ca|au"
ISSUERS = "3[47]|4|5[1-5]|6011|65|35|30[0-5]|36|2[2-7]"
CALLING_CODES = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
BEFORE = {
    "email": "e-?mail|mail|contact|write|correo|courriel|an|from|to",
    "ip": "ip|host|server|address|adresse|from|client|login",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|iban",
    "phone": "tel|phone|call|mobile|cell|fax|telefon|appel|llame|whatsapp|sms",
}
AGAINST = "version|release|isbn|order|invoice|section|no|nr|id|doi|sku|serial|ticket|build"
LABELERS = ("rule", "structure", "gazetteer", "before", "against", "around")
ADD_FROM = 0.9


def luhn(number: Column) -> Column:
    """Whether the digits of a text pass the check-digit rule of card numbers."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))

    def worth(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(values, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def n_digits(number: Column) -> Column:
    return F.length(F.regexp_replace(number, "[^0-9]", ""))


def fits(kind: str, found: Column) -> Column:
    """The check a span must pass after its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n_digits(found).between(14, 19), luhn(found)).otherwise(F.lit(False))
    return n_digits(found).between(10, 15)


def worth_a_look(text: Column, digit: Column, kind: str, wider: bool) -> Column:
    """Cheap tests first: a text that fails holds no match, and most texts fail."""
    if kind == "email":
        spelled = (text.contains("[") | text.contains("(")) & text.rlike(r"[\[(]\x20?at\x20?[\])]")
        return text.contains("@") | spelled if wider else text.contains("@")
    if kind == "ip":
        return text.contains(":") & text.rlike(":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:") if wider else digit & text.rlike(r"[0-9]\.[0-9]")
    return text.contains("+") & digit if kind == "phone" and not wider else digit


def matches(text: Column, digit: Column, kind: str, pattern: str, wider: bool) -> Column:
    """Non-overlapping matches of a pattern and what stands between them, as (kind, rank, wider, found, gaps)."""
    none = F.array().cast("array<string>")

    def split(found: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(wider).alias("wider"), found.alias("found"),
            F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(none).alias("gaps"),
        )

    look = worth_a_look(text, digit, kind, wider)
    return let(F.when(look, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), split)


def spans(text: Column) -> Column:
    """All matches as (start, rank, end, kind, wider, found, left, right), by pattern and left to right.

    What stands between the matches of a pattern gives their places.
    """

    def placed(s: Column) -> Column:
        both = F.transform(s["found"], lambda m, i: (F.length(F.get(s["gaps"], i)) + F.length(m)).cast("long"))

        def row(before: Column, m: Column, i: Column) -> Column:
            gap, start = F.get(s["gaps"], i), F.get(before, i) + F.length(F.get(s["gaps"], i))
            return F.struct(
                start.alias("start"), s["rank"].alias("rank"), (start + F.length(m)).alias("end"), s["kind"].alias("kind"),
                s["wider"].alias("wider"), m.alias("found"),
                F.right(gap, F.lit(40)).alias("left"), F.left(F.get(s["gaps"], i + 1), F.lit(1)).alias("right"),
            )

        return let(sums_before(both), lambda before: F.transform(s["found"], lambda m, i: row(before, m, i)))

    def sets(digit: Column) -> Column:
        return F.array(*[matches(text, digit, k, p[k], wider) for wider, p in ((False, BASE), (True, WIDER)) for k in KINDS])

    some = F.filter(let(text.rlike("[0-9]"), sets), lambda s: F.size(s["found"]) > 0)
    return F.flatten(F.transform(some, placed))


def passes(span: Column) -> Column:
    """Whether a span passes the check of its kind."""
    out = F.lit(False)
    for kind in KINDS:
        out = F.when(span["kind"] == kind, fits(kind, span["found"])).otherwise(out)
    return out


def votes(span: Column) -> dict[str, Column]:
    """What each labeler says about a span: 1, 0 or -1."""
    kind, found, left, right = span["kind"], span["found"], F.lower(span["left"]), span["right"]

    def by_kind(**said: Column) -> Column:
        out = F.lit(0)
        for name, value in said.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    def either(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    def near(words: str) -> Column:
        return left.rlike(rf"(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}]{{0,12}}$")

    digits = F.regexp_replace(found, "[^0-9]", "")
    return {
        # A wider span has missed the base pattern; only a failed check speaks against it.
        "rule": F.when(passes(span), F.when(span["wider"], 0).otherwise(1)).otherwise(-1),
        "structure": by_kind(
            email=either(found.rlike(r"[A-Za-z]{2,}$"), found.rlike(r"[0-9]$")),
            ip=either(found.rlike(r"^(?:[1-9][0-9]{0,2}\.){3}[0-9]{1,3}$|:"), found.rlike(r"(?:^|\.)0[0-9]")),
            card=either(found.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), found.rlike(r"^(.)(?:[ .-]?\1)+$")),
            phone=either(found.rlike(r"[(). -]"), found.rlike(r"^\+?0+$")),
        ),
        "gazetteer": by_kind(
            email=either(F.lower(found).rlike(rf"[.\x20)\]](?:{DOMAINS})$"), F.lit(False)),
            ip=either(F.lit(False), found.rlike(r"^(?:0|127|255)\.")),
            card=either(digits.rlike(f"^(?:{ISSUERS})"), digits.rlike("^0")),
            phone=either(found.rlike(rf"^\+(?:{CALLING_CODES})"), F.lit(False)),
        ),
        "before": by_kind(**{k: either(near(BEFORE[k]), F.lit(False)) for k in KINDS}),
        "against": either(F.lit(False), near(AGAINST)),
        "around": either(left.rlike(r"(?:^|[\s\p{P}])$") & right.rlike(r"^(?:$|[\s\p{P}])"), left.rlike(r"[\p{L}0-9_]$") | right.rlike(r"^[\p{L}0-9_]")),
    }


def meets(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of ``others``, which are disjoint and in order.

    That can only be the last one that begins before its end, which halving finds.
    """
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(others).cast("long"))))

    def halved(low: Column, high: Column) -> Column:
        mid = F.shiftright(low + high, 1)
        before = F.get(others, mid)["start"] < span["end"]
        return F.struct(F.when((low < high) & before, mid + 1).otherwise(low).alias("low"), F.when((low < high) & ~before, mid).otherwise(high).alias("high"))

    all_of = F.struct(F.lit(0).alias("low"), F.size(others).alias("high"))
    last = F.aggregate(halvings, all_of, lambda at, _: halved(at["low"], at["high"]), lambda at: at["low"]) - 1
    return F.coalesce(F.get(others, last)["end"] > span["start"], F.lit(False))


def clear_of(wider: Column, base: Column) -> Column:
    """The wider spans that meet no base span. Base spans of one kind are disjoint and in order."""
    by_kind = F.array(*[F.filter(base, lambda b: b["kind"] == kind) for kind in KINDS])
    return let(by_kind, lambda own: F.filter(wider, lambda w: ~F.exists(own, lambda others: meets(w, others))))


def propose(docs: DataFrame) -> DataFrame:
    """``doc_id``, the ``base`` spans, and the ``wider`` ones that meet no base span; each with its votes."""
    text = F.coalesce("text", F.lit(""))

    def voted(span: Column) -> Column:
        return F.struct(*[span[f].alias(f) for f in ("start", "rank", "end", "kind")], *[v.cast("int").alias(k) for k, v in votes(span).items()])

    found = docs.select("doc_id", spans(text).alias("all"))
    found = found.select(
        "doc_id", F.filter("all", lambda s: ~s["wider"] & passes(s)).alias("base"), F.filter("all", lambda s: s["wider"]).alias("wider")
    )
    clear = clear_of(F.col("wider"), F.col("base"))
    return found.select("doc_id", F.transform("base", voted).alias("base"), F.transform(clear, voted).alias("wider"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over counted vote patterns: the chance that a span is real.

    Each labeler has, for real and for other spans, its chances of saying 1 and -1 when it says
    anything; a 0 is no evidence. Half a count is added everywhere, so a kind that was hardly seen
    keeps to the start values.
    """
    out = {}
    for kind in KINDS:
        rows = [(p, n) for k, p, n in patterns if k == kind]
        if not rows:
            continue
        real = {p: 1.0 if p[0] > 0 else 0.0 if p[0] < 0 else 0.3 if sum(p) > 1 else 0.05 for p, _ in rows}
        for _ in range(rounds):
            weight = [0.5, 0.5]
            says = [[{1: 0.5, -1: 0.5} for _ in LABELERS] for _ in range(2)]
            for p, n in rows:
                for side, share in ((1, real[p]), (0, 1 - real[p])):
                    weight[side] += n * share
                    for j, v in enumerate(p):
                        if v:
                            says[side][j][v] += n * share
            for p, _ in rows:
                score = math.log(weight[1]) - math.log(weight[0])
                for j, v in enumerate(p):
                    if v:
                        score += math.log(says[1][j][v] / sum(says[1][j].values()))
                        score -= math.log(says[0][j][v] / sum(says[0][j].values()))
                # What passes the base rule is personal data by definition; what fails its check is not.
                real[p] = 1.0 if p[0] > 0 else 0.0 if p[0] < 0 else 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
        out |= {(kind, p): real[p] for p, _ in rows}
    return out


def train(patterns: list[tuple[str, tuple[int, ...], int]], steps: int = 1500, ridge: float = 1e-3) -> dict[str, list[float]]:
    """Weights of the votes and a constant for each kind, fitted to the estimates by gradient steps.

    A pattern weighs as the square root of its count, so that rare ones are learned as well.
    """
    real = estimate(patterns)
    weights = {}
    for kind in KINDS:
        rows = [(p, math.sqrt(n), real[kind, p]) for k, p, n in patterns if k == kind]
        whole = sum(n for _, n, _ in rows) or 1
        w = [1.0] * len(LABELERS) + [-3.0]
        for _ in range(steps):
            slope = [ridge * x for x in w]
            for p, n, target in rows:
                score = sum(a * b for a, b in zip(w, (*p, 1)))
                miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - target) * n / whole
                for j, v in enumerate((*p, 1)):
                    slope[j] += miss * v
            w = [a - b for a, b in zip(w, slope)]
        weights[kind] = w
    return weights


def vote_patterns(found: DataFrame) -> list[tuple[str, tuple[int, ...], int]]:
    """The votes of all spans, counted by kind and pattern."""
    each = found.select(F.explode(F.concat("base", "wider")).alias("s"))
    counted = each.groupBy("s.kind", *[f"s.{name}" for name in LABELERS]).count()
    return sorted((row["kind"], tuple(row[name] for name in LABELERS), row["count"]) for row in counted.collect())


def classify(found: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """``doc_id``, the ``base`` spans and the ``added`` ones, those the classifier takes for real."""

    def likely(span: Column) -> Column:
        out = F.lit(0.0)
        for kind, w in weights.items():
            score = F.lit(w[-1])
            for a, name in zip(w, LABELERS):
                score = score + F.lit(a) * span[name]
            out = F.when(span["kind"] == kind, 1 / (1 + F.exp(-score))).otherwise(out)
        return out

    return found.select("doc_id", "base", F.filter("wider", lambda s: likely(s) >= ADD_FROM).alias("added"))


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, by start and then kind, comma-joined."""
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans of every text. The spans are stored once, without texts."""
    found = saved(propose(docs), "pii")
    return classify(found, train(vote_patterns(found)))


def op1_pii(docs: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs).select(
        "doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
