import random
import time

from llm.conftest import prose

from lakejobs.llm import lines


def ok(x):
    return [w for w in x.replace("\t", " ").split(" ") if w]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(rows):
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    seen, out = [], {}
    for here, i, text in order:
        kept = []
        for line in text.split("\n"):
            w = ok(line)
            if not w:
                kept.append(line)
                continue
            if not any(w == s or (min(len(w), len(s)) >= 8 and abs(len(w) - len(s)) <= 1 and edits(w, s) <= 1) for s in seen):
                kept.append(line)
            seen.append(w)
        out[here, i, text] = "\n".join(kept)
    return sorted(
        ((i, None if t is None else out[i is not None, i or 0, t]) for i, t in rows), key=str
    )


def test_against_brute_force(documents, odd_rows):
    rng = random.Random(7)
    pool = [prose(rng, n, 30) for n in (1, 3, 4, 5, 7, 8, 8, 9, 15, 16, 17, 17, 31, 32, 33, 40) for _ in range(2)]
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 5000]
    for k in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"x{rng.randrange(3)}"] * rng.randrange(2)
            text.append(rng.choice(["", " ", "\t"]) + "  ".join(words))
        rows.append((50 + k, "\n".join(text)))
    rows.append((50, rows[-1][1]))
    got = lines.op2_line_dedup(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == expected(rows)
    assert all(r.n_dropped >= 0 for r in got)


def test_columns_and_emptied_documents(documents):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, ""), (4, None), (5, "a b c d e\nshort"), (6, "p q r s t u v w x"), (7, "p q r s t u v w z")]
    docs = documents(rows)
    got = lines.clean(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, "a b c d e", 9), (3, "", 0), (4, None, None), (5, "short", 5), (6, "p q r s t u v w x", 17)]


def test_equal_lines_of_any_length(documents):
    rows = [(1, "Les.\nsame three words\n\n***"), (2, "Les.\n same  three words\n\nnew"), (3, "***\nLes."), (4, "Les.\nLes.\n \nown")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.op2_line_dedup(documents(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nnew", 2), 3: ("", 2), 4: (" \nown", 2)}


def test_many_lines(documents):
    rows = [(k, "\n".join(f"line {i % 30_000} {'x' if i % 3 else k}" for i in range(60_000))) for k in range(3)]
    start = time.time()
    got = lines.op2_line_dedup(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == expected_equal(rows) and time.time() - start < 60


def expected_equal(rows):
    seen, out = set(), []
    for i, text in rows:
        kept = [line for line in text.split("\n") if line not in seen and not seen.add(line)]
        out.append((i, "\n".join(kept)))
    return out


def test_no_rows(documents):
    assert lines.op2_line_dedup(documents([])).collect() == []
    assert lines.clean(documents([])).collect() == []


def test_ends_meet():
    rng = random.Random(2)
    for _ in range(3000):
        a = [b"%d" % rng.randrange(3) for _ in range(rng.randrange(9, 70))]
        b = list(a)
        at = rng.randrange(len(a))
        b[at : at + rng.randrange(2)] = [b"new"] * rng.randrange(2)
        if min(len(a), len(b)) >= 8:
            assert set(lines.end_keys(a)) & set(lines.end_keys(b))
