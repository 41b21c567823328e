"""Phrase mining against plain Python, and the guarantee of the summaries."""

import random
import re
from collections import Counter

import numpy as np
from llm.conftest import prose

from lakejobs.llm import phrases


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own = f.setdefault(lang, Counter())
            for size in range(1, 5):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        ranked = []
        for p, a in found.items():
            if p in around and 100 * around[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(odd_rows):
    rng = random.Random(4)
    rows = [("en", t) for _, t in odd_rows]
    fixed = ["new York city", "machine learning model works", "é ñ ß", "a\x1cb c", "in\tthe end"]
    for k in range(400):
        words = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows


def run(spark, rows, **conf):
    docs = spark.createDataFrame([(t, g, "x", 1) for g, t in rows], "text string, lang string, `my col` string, f int")
    return sorted(tuple(r) for r in phrases.mine(docs.repartition(7), **conf).collect())


def test_against_plain_python(spark, odd_rows):
    rows = corpus(odd_rows)
    want = expected(rows, 5, 2000)
    assert len(want) > 300
    assert run(spark, rows, least=5) == want
    assert run(spark, rows, least=5, top=20) == expected(rows, 5, 20)


def test_small_chunks_blocks_and_stores(spark, odd_rows, monkeypatch):
    for name, value in (("CHUNK_TOKENS", 50), ("BLOCK_BYTES", 40), ("KEPT_WORDS", 30), ("PART_BYTES", 1000), ("ROW_CODES", 8)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(odd_rows)
    assert run(spark, rows, least=5) == expected(rows, 5, 2000)


def test_a_full_bitmap_changes_nothing(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", 6)
    rows = corpus(odd_rows)
    assert run(spark, rows, least=5) == expected(rows, 5, 2000)


def test_no_rows_and_nothing_frequent(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", None), (None, ""), ("en", "a b c")]) == []


def test_every_frequent_code_survives():
    rng = np.random.default_rng(1)
    for _ in range(20):
        codes = (rng.pareto(0.5, 20_000) * 3).clip(0, 1e6).astype(np.uint32)
        least = 30
        summary = phrases.Summary(len(codes) // least + 1)
        for part in np.array_split(codes, rng.integers(1, 40)):
            own, n = np.unique(part, return_counts=True)
            summary.merge(own, n)
        assert summary.lost < least and len(summary.codes) <= summary.capacity
        own, n = np.unique(codes, return_counts=True)
        assert set(own[n >= least].tolist()) <= set(summary.frequent(least).tolist())


def test_long_text(spark):
    rng = random.Random(8)
    text = prose(rng, 200_000, 20)
    assert run(spark, [("en", text), ("en", text)], top=50) == expected([("en", text)] * 2, 30, 50)
