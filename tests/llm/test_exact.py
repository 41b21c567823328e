"""Exact duplicates against plain Python."""

import hashlib
import random

from llm.conftest import prose
from pyspark.sql import functions as F

from lakejobs.llm import exact


def expected(rows):
    bodies = ["".join(c for c in t or "" if c not in exact.WHITE) for _, t in rows]
    groups = {}
    for k, body in enumerate(bodies):
        groups.setdefault(body, []).append(k)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        own = groups[bodies[k]]
        best = min(own, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        same = [j for j in own if rows[j][0] == rows[best][0] and len(rows[j][1] or "") == len(rows[best][1] or "")]
        out.append((doc_id, rows[best][0], len(own), k in same, hashlib.sha256(bodies[k].encode()).hexdigest()))
    return sorted(out, key=str)


def check(got, rows):
    """Of rows that are alike in all but their place any one may be the one kept, but only one."""
    got = sorted((tuple(r) for r in got), key=str)
    want = expected(rows)
    bare = lambda rows: sorted((r[:3] + r[4:] for r in rows), key=str)
    assert bare(got) == bare(want)
    assert {r for r in got if r[3]} <= set(want)
    kept = [r[4] for r in got if r[3]]
    assert sorted(kept) == sorted({r[4] for r in want})


def cases(odd_rows):
    rng = random.Random(2)
    rows = list(odd_rows)
    for k in range(150):
        words = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(4))]
        rows.append((100 + k, rng.choice([" ", "\n", "\t\x0b", "", "\x0c\r "]).join(words)))
    rows += [(500, "a b"), (400, "a b"), (401, "ab"), (402, "AB"), (403, "a b"), (404, "ab\x1c"), (405, "\U0001f600 \U0001f600")]
    rows += [(600 + k, prose(random.Random(9), 30)) for k in range(300)]
    return rows


def test_against_plain_python(documents, odd_rows):
    rows = cases(odd_rows)
    check(exact.op12_exact_dedup(documents(rows)).collect(), rows)


def test_texts_that_share_a_hash(documents, odd_rows):
    rows = cases(odd_rows)
    check(exact.group(documents(rows), lambda body: F.unhex(F.lpad(F.hex(F.length(body) % 3), 32, "0"))).collect(), rows)


def test_names_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2), (2, "a ", "y", 3)], "doc_id int, text string, `my col` string, `a.b` int")
    assert sorted(tuple(r)[:4] for r in exact.op12_exact_dedup(docs).collect()) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert exact.op12_exact_dedup(docs.where("doc_id > 5")).collect() == []
