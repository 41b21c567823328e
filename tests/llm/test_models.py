import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import prose

from lakejobs.llm import language_model as lm
from lakejobs.llm import quality_classifier as qc


def words(text):
    return (text or "").encode().lower().split() + [b""]


def test_base_score_and_counts(documents, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 127)
    rng = random.Random(1)
    rows = odd_rows + [(100 + k, prose(rng, rng.randrange(1, 80), 900)) for k in range(200)]
    got = lm.op4_maxent_scoring(documents(rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((i, held(i), len(words(t)), sum(w in count for w in words(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows),
        key=str,
    )
    plain = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [w[:5] for w in plain] == [w[:5] for w in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(plain, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_add_up_and_context_helps(spark, documents):
    rng = random.Random(2)

    def sentence():
        w = "ab" if rng.random() < 0.5 else "cd"
        return " ".join(f"{rng.choice('xyz')}{rng.randrange(20)}{w}" for _ in range(rng.randrange(5, 60)))

    docs = documents([(k, sentence()) for k in range(1500)])
    counts = lm.count_words(docs.where(~lm.held_out()))
    model = lm.fit(docs, counts)
    mass = np.zeros(lm.CLASSES)
    for row in counts.collect():
        mass[model.class_of(bytes(row["word"]))] += row["c"] + 1
    assert np.allclose(np.log10(mass + 1), model.log_mass)
    chance = lm.log_softmax(model.weights, np.random.default_rng(0).integers(0, lm.FEATURE_ROWS, (3, 50)))
    assert np.allclose(np.exp(chance).sum(axis=1), 1, atol=1e-4)
    rows = [r for r in lm.score_all(docs).collect() if r.held_out]
    assert len(rows) > 100 and sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)


def test_language_model_without_rows(documents):
    assert lm.op4_maxent_scoring(documents([])).collect() == []
    only = lm.op4_maxent_scoring(documents([(3, None)])).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in only] == [(3, 1, 1, 1)]


@pytest.fixture(scope="module")
def rated(spark, documents):
    """Texts whose grade is planted: one of some words for 0, symbols for 1."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(1200):
        grade = rng.choice([0, 1, 2, 2, 2, 2])
        text = prose(rng, rng.randrange(40, 300), 3000)
        if grade == 1:
            text = " ".join(w + "***" for w in text.split())
        if grade == 0:
            text += " " + " ".join(rng.choice(["rotten", "vile", "awful"]) for _ in range(3))
        rows.append((k, text))
        labels.append((k, int(grade != 1), int(grade == 0), "x"))
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(documents, rated):
    rows, labels, table = rated
    got = {r.doc_id: r for r in qc.op5_ordinal_quality(documents(rows), table.where("doc_id < 800")).collect()}
    hits = [got[k].kept == (quality == 1 and toxic == 0) for k, quality, toxic, _ in labels if k >= 800]
    assert sum(hits) / len(hits) > 0.95
    by_grade = [np.mean([got[k].expected_grade for k, q, t, _ in labels if (1 - t) * (1 + q) == g]) for g in range(3)]
    assert by_grade[0] < by_grade[1] < by_grade[2]
    assert all(0 <= r.p_top <= r.expected_grade <= 2 for r in got.values())


def test_inflected_words_are_known_by_their_beginnings(spark, documents):
    """No word of the held-out toxic texts was ever seen: only how their words begin tells them."""
    rng = random.Random(6)
    ends = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(600)]
    rows = []
    for k in range(900):
        text = prose(rng, rng.randrange(60, 300), 900)
        rows.append((k, text + "".join(f" grumm{ends[rng.randrange(300) + 300 * (k >= 600)]}" for _ in range(3)) if k % 6 == 0 else text))
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    got = [r.kept == (r.doc_id % 6 != 0) for r in qc.op5_ordinal_quality(documents(rows), labels).collect() if r.doc_id >= 600]
    assert sum(got) / len(got) > 0.98


def test_features_in_use_are_all_a_score_needs():
    rng = random.Random(7)
    weights = np.zeros(qc.BUCKETS, np.float32)
    texts = [" ".join(rng.choice(["grumm", "pol", "straff"]) + str(rng.randrange(50)) * 3 for _ in range(rng.randrange(0, 90))).encode() for _ in range(60)]
    every = qc.Words()
    for text in texts[:10]:
        weights[qc.of_text(text, every)[0][::3]] = 0.5
    some = qc.Words(weights != 0)
    for text in texts:
        (a, x), (b, y) = qc.of_text(text, every), qc.of_text(text, some)
        assert x == y and a[weights[a] != 0].tolist() == b[weights[b] != 0].tolist()


def test_odd_rows_and_labels(spark, documents, odd_rows, rated):
    _, _, table = rated
    docs = documents(odd_rows)
    schema = "doc_id long, quality int, toxic int"
    odd = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 1), (8, 1, None), (77, 1, 0)], schema)
    assert sorted((r.label_id, r.grade) for r in qc.grades(odd).collect()) == [(6, 1), (7, 0), (77, 2)]
    for labels in (odd, table, spark.createDataFrame([], schema)):
        assert qc.op5_ordinal_quality(docs, labels).count() == len(odd_rows)
    kept = qc.select(docs, spark.createDataFrame([], schema))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert qc.op5_ordinal_quality(documents([]), odd).collect() == []


def test_thresholds_are_ordered_and_the_slope_is_right():
    rng = np.random.default_rng(3)
    told = rng.integers(0, 3, 400)
    found = [np.unique(np.append(rng.integers(0, 50, 5), 1000 + t)) for t in told]
    weights, thresholds = qc.fit(found, np.ones(400), told)
    assert (np.diff(thresholds) > 0).all() and weights[1000] < weights[1001] < weights[1002]


def test_grades_against_the_fit_without_spark(documents, rated):
    """The classifier fitted and applied in plain numpy over all rows."""
    rows, labels, table = rated
    rows = rows[:300] + [(7, "an id that repeats"), (None, "no id"), (9000, None)]
    table = table.where("doc_id < 200")
    got = {(r.doc_id, round(r.expected_grade, 9), round(r.p_top, 9), r.kept) for r in qc.op5_ordinal_quality(documents(rows), table).collect()}
    known = qc.Words()
    grade = {i: (0 if toxic else 1 + quality) for i, quality, toxic, _ in labels if i < 200}
    read = {}
    for i, text in rows:
        if i in grade:
            found, value = qc.of_text((text or "").encode(), known)
            key = (grade[i], tuple(int(f) for f in found))
            read[key] = min(value, read.get(key, value))
    sample = sorted((g, f, v) for (g, f), v in read.items())
    totals = np.array([sum(g == k for g, _, _ in sample) for k in range(qc.GRADES)], float)
    counts = np.zeros((qc.GRADES, qc.BUCKETS))
    for g, f, _ in sample:
        for bucket in set(f):
            counts[g, bucket] += f.count(bucket)
    used = qc.telling(counts, totals)
    sample = sorted((g, [b for b in f if used[b]], v) for g, f, v in sample)
    weights, thresholds = qc.fit([np.array(f, np.int32) for _, f, _ in sample], np.array([v for _, _, v in sample]), np.array([g for g, _, _ in sample]))
    want = set()
    for i, text in rows:
        found, value = qc.of_text((text or "").encode(), qc.Words(weights != 0))
        above = 1 / (1 + np.exp(-(weights[found].sum() * value - thresholds)))
        want.add((i, round(float(above.sum()), 9), round(float(above[-1]), 9), bool(above[-1] >= qc.KEEP_FROM)))
    close = lambda a, b: a[0] == b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 1e-5 and abs(a[2] - b[2]) < 1e-5
    assert len(got) == len(want) and all(any(close(a, b) for b in want) for a in got)


def test_history_tells_words_of_one_class_apart(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "STEP_TOKENS", 256)
    rng = random.Random(9)

    def pairs():
        return " ".join(f"x{k}ab y{k}ab" for k in (rng.randrange(30) for _ in range(rng.randrange(10, 40))))

    docs = documents([(k, pairs()) for k in range(1500)])
    counts = lm.count_words(docs.where(~lm.held_out()))
    rare = [f"r{k}ab".encode() for k in range(40)]
    more = spark.createDataFrame([(w, 1) for w in rare], "word binary, c long")
    counts = counts.unionByName(more).localCheckpoint()
    model = lm.fit(docs, counts)
    # The leaves of a class add up to one, whatever the history; so do masses of leaves to that of the class.
    trees = model.trees
    place = {model.head[bytes(r["word"])]: model.class_of(bytes(r["word"])) for r in counts.collect() if bytes(r["word"]) in model.head}
    for k in set(range(lm.CLASSES)) - set(model.own.values()):
        leaves = np.array([p for p, c in place.items() if c == k] + list(range(trees.first[k], trees.first[k] + trees.mask[k] + 1)))
        before = np.repeat(np.random.default_rng(k).integers(0, 1 << 32, (2, 1), np.uint32), len(leaves), axis=1)
        assert abs(np.exp(lm.log_leaf(trees, before, leaves)).sum() - 1) < 1e-4
        assert abs((10 ** trees.log_mass[leaves]).sum() - 10 ** model.log_mass[k]) < 1e-6 * 10 ** model.log_mass[k]
    # Every y follows its x, and all of them may be of one class or single: the next word has to be told by the history.
    rows = [r for r in lm.score_all(docs).collect() if r.held_out]
    assert len(rows) > 100 and sum(r.score for r in rows) > 0.75 * sum(r.base_score for r in rows)


def test_stored_moves_do_not_grow_with_the_partitions(spark, documents, monkeypatch):
    stored, summed = [], lm.summed
    monkeypatch.setattr(lm, "summed", lambda moves, keys: (stored.append((keys, moves.rdd.getNumPartitions())), summed(moves, keys))[1])
    rng = random.Random(11)
    docs = documents([(k, prose(rng, 20, 300)) for k in range(400)]).repartition(97)
    assert lm.op4_maxent_scoring(docs).count() == 400
    learned = [n for keys, n in stored if keys == ["block", "part"]]
    assert len(learned) == lm.ROUNDS and max(learned) <= spark.sparkContext.defaultParallelism


def test_codes_and_histories_against_plain_python(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 40)
    rng = random.Random(12)
    texts = [None, "", " \x0b\r", "  A\x1cB \x85c\x0c\tZed  ", "É é", "x"] + [prose(rng, rng.randrange(0, 30), 60) for _ in range(30)]
    model = lm.Model({lm.END: 0, b"zed": 1}, {lm.ending(w.encode()): 2 + k for k, w in enumerate(["ab", "n.", "e!"])}, {lm.END: 2, b"x": 1})
    got = list(lm.chunks(pa.array(texts), lm.Codes(model)))
    told = [[words[int(k)].as_py().encode() for k in which] for _, words, which, _, _ in got]
    assert [w for some in told for w in some] == [w for t in texts for w in words(t)]
    assert [n for c in got for n in c[4].tolist()] == [len(words(t)) for t in texts]
    for (_, _, _, flat, lengths), some in zip(got, told):
        assert flat.tolist() == [lm.hashed(w) << 23 | model.class_of(w) << 17 | model.head.get(w, 0) for w in some]
        one, two = lm.earlier(flat, lengths)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        assert one.tolist() == [flat[i - 1] if i - 1 >= starts[i] else -1 for i in range(len(flat))]
        assert two.tolist() == [flat[i - 2] if i - 2 >= starts[i] else -1 for i in range(len(flat))]


def test_moves_are_by_the_sums_of_misses():
    rng = np.random.default_rng(13)
    rows = np.minimum(rng.geometric(0.02, (3, 3000)), 999) * (rng.random((3, 3000)) < 0.8)
    miss = rng.normal(size=(3000, 8)).astype(np.float32)
    weights, squares = np.zeros((1000, 8), np.float32), np.zeros((1000, 8), np.float32)
    lm.move(weights, squares, rows, miss)
    slope = np.zeros((1000, 8))
    np.add.at(slope, rows.ravel(), np.tile(miss, (3, 1)))
    assert np.allclose(squares, slope**2, rtol=1e-3, atol=1e-3)
    assert np.allclose(weights, -lm.STEP_SIZE * slope / np.sqrt(slope**2 + 1e-6), atol=1e-3)


def test_words_without_features_share_a_value():
    """A worker keeps hundreds of thousands of words, most of them without a feature in use."""
    known = qc.Words(np.zeros(qc.BUCKETS, bool))
    assert known[b"mountain"] is known[b"river"] == ((), ())
