import random

import numpy as np
import pytest
import xxhash
from llm.conftest import prose

from lakejobs.llm import simhash
from lakejobs.llm.graph import components


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows):
    marks = [(i, slow_fingerprint(t)) for i, t in rows]
    codes = sorted({f for _, f in marks})
    roots = slow_components(codes, [(a, b) for a in codes for b in codes if a < b and bin(a ^ b).count("1") <= 4])
    low = {}
    for i, f in marks:
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    return sorted(((i, f"{f:016x}", low.get(roots[f])) for i, f in marks), key=str)


def test_documents_against_brute_force(documents, odd_rows):
    rng = random.Random(1)
    rows = list(odd_rows)
    for k in range(60):
        words = prose(rng, rng.randrange(1, 300)).split()
        for copy in range(rng.randrange(1, 4)):
            for _ in range(copy):
                words[rng.randrange(len(words))] = "changed"
            rows.append((100 + len(rows), " ".join(words)))
    got = simhash.op8_simhash(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_no_rows(documents):
    assert simhash.op8_simhash(documents([])).collect() == []


@pytest.mark.parametrize("cap", [7, 100, 2048])
def test_dense_cells_in_pieces(spark, cap):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 6)
    codes = {int(c ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False))) for c in centre for _ in range(150)}
    codes |= {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)}
    entries = spark.createDataFrame([(c,) for c in codes], "fp long")
    found = {r.node: r.root for r in components(simhash.links(entries, cap=cap)).collect()}
    want = slow_components(sorted(codes), [(a, b) for a in codes for b in codes if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4])
    same = {}
    for code in codes:
        assert same.setdefault(want[code], found.get(code, code)) == found.get(code, code)
    assert len(set(same.values())) == len(same)


def test_search_finds_all_pairs():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 20, 700).astype(np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.search(codes, codes, 2)
    want = np.argwhere(np.bitwise_count(codes[:, None] ^ codes) <= 2)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(map(tuple, want.tolist()))


def test_masks_share_a_choice():
    for n in (10, 10**6, 10**9, 10**12):
        masks = [m & (1 << 64) - 1 for m in simhash.block_masks(n, 4)]
        rng = random.Random(n)
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]
