"""The stages on a small table: each against its operator, and the whole against its parts."""

import random
from collections import defaultdict

import corpus_pipeline as cp
from llm.conftest import prose
from llm.test_lines import expected as clean_lines
from llm.test_simhash import slow_components, slow_fingerprint

from lakejobs.llm.shared import saved

LABELS = "doc_id long, quality int, toxic int"


def write(tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, documents, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        text = "\n".join(prose(rng, rng.randrange(20, 60), 4000) for _ in range(4))
        rows.append((k, " ".join(w + "***" for w in text.split(" ")) if k % 10 == 0 else text))
    rows += [(400 + k, rows[3][1]) for k in range(40)] + [(500 + k, rows[4][1] + f"\nshort {k}") for k in range(20)] + [(600, None), (601, ""), (602, "a b"), (602, "a b")]
    labels = spark.createDataFrame([(k, int(k % 10 != 0), 0) for k in range(300)], LABELS)
    docs = documents(rows)
    sf = write(tmp_path, docs, labels)
    tables = [docs]
    for name, stage in cp.STAGES:
        tables.append(saved(stage(spark, tables[-1], sf), name))
    for made in tables[:5]:
        assert made.columns == docs.columns
    ids = [[r.doc_id for r in t.collect()] for t in tables]
    assert not {k for k in range(0, 300, 10)} & set(ids[1]) and {k for k in range(400) if k % 10} <= set(ids[1])
    before = [(r.doc_id, r.text) for r in tables[1].collect()]
    cleaned = [(i, t) for i, t in clean_lines(before) if t is None or t.split() or (i, t) in before]
    assert sorted(cleaned, key=str) == sorted(((r.doc_id, r.text) for r in tables[2].collect()), key=str)
    marks = defaultdict(list)
    for r in tables[2].collect():
        marks[slow_fingerprint(r.text)].append(r.doc_id)
    roots = slow_components(list(marks), [(a, b) for a in marks for b in marks if a < b and bin(a ^ b).count("1") <= 4])
    low = {}
    for f, own in marks.items():
        low[roots[f]] = min([*own, low.get(roots[f], 10**9)])
    assert sorted(ids[3]) == sorted(low.values()) and sorted(ids[4]) == sorted(ids[3])
    assert {r.doc_id for r in tables[5].collect()} == set(ids[4])
    whole = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in cp.run(spark, sf).collect())
    assert whole == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in tables[5].collect())


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark, documents):
    rng = random.Random(5)
    texts = [prose(rng, 80, 4000) for _ in range(30)]
    # Texts under a null id, two texts under one id, and an id in two groups, one of which another id leads.
    rows = [(None, t) for t in texts[:8]] + [(None, texts[0]), (None, None), (None, "")]
    rows += [(k // 2, t) for k, t in enumerate(texts[8:20])]
    rows += [(50, texts[20] + " a"), (50, texts[21]), (40, texts[20] + " a"), (60, texts[22]), (60, texts[23]), (None, texts[23]), (60, texts[22])]
    docs = documents(rows)
    marks = defaultdict(list)
    for i, t in rows:
        marks[slow_fingerprint(t)].append((i is None, i or 0, t is None, t or ""))
    roots = slow_components(list(marks), [(a, b) for a in marks for b in marks if a < b and bin(a ^ b).count("1") <= 4])
    best = {}
    for f, own in marks.items():
        best[roots[f]] = min([*own, *([best[roots[f]]] if roots[f] in best else [])])
    want = [(None if no_id else i, None if no_text else t) for no_id, i, no_text, t in best.values()]
    got = cp.one_of_a_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark, documents, odd_rows, tmp_path):
    sf = write(tmp_path, documents(odd_rows), spark.createDataFrame([], LABELS))
    assert cp.run(spark, sf).count() > 0


def test_empty_tables(spark, documents, tmp_path):
    sf = write(tmp_path, documents([]), spark.createDataFrame([], LABELS))
    assert cp.run(spark, sf).collect() == []


def test_extra_columns_of_any_name(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, prose(rng, 40), "en", f"s{k % 2}", 200, "x", k, [k], "y") for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long, `my col` string, `a-b:c` int, `a.b` array<int>, `row` string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], LABELS)
    sf = write(tmp_path, docs, labels)
    made = docs
    for name, stage in cp.STAGES[:-1]:
        made = saved(stage(spark, made, sf), name)
        assert made.columns == docs.columns
    assert {(r["doc_id"], r["my col"], r["a-b:c"], r["a.b"][0]) for r in made.collect()} <= {(k, "x", k, k) for k in range(60)}
    assert cp.run(spark, sf).count() >= made.count() > 0


def test_sequences_follow_the_mixture(spark, documents, tmp_path):
    rng = random.Random(8)
    # Sources of unlike size, in long runs as they came; most documents fill more than half a sequence.
    rows = [(k, " ".join(rng.choices(["one", "two", "three"], k=rng.choice([1500, 1500, 300, 2500])))) for k in range(240)]
    docs = saved(documents(rows, ["small" if k >= 200 else "large" for k in range(240)]), "mixed")
    mixed = saved(cp.mix_sources(spark, docs, ""), "mixed")
    place = {}
    names = sorted({r.f for r in mixed.selectExpr("_metadata.file_name AS f").distinct().collect()})
    for r in mixed.selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").collect():
        place[r.doc_id] = (names.index(r.f), r.i)
    got = [r.asDict() for r in cp.pack_sequences(spark, mixed, "").collect()]
    plain = cp.packing.pack(mixed).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, plain))
    members = defaultdict(list)
    for r in got:
        members[r["sequence_id"]].append(r)
    assert sorted(members) == list(range(len({r.sequence_id for r in plain})))
    for own in members.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    firsts = [min((place[r["doc_id"]], r["piece"]) for r in members[k]) for k in sorted(members)]
    assert firsts == sorted(firsts)
    # Pieces of one length are placed in the order of the mixture, so another order gives other sequences.
    turned = docs.repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id")
    other = cp.pack_sequences(spark, saved(turned, "turned"), "").collect()
    assert sorted((*key(r), r["sequence_id"]) for r in other) != sorted((*key(r), r["sequence_id"]) for r in got)
    small = [k for k in sorted(members) if any(r["doc_id"] >= 200 for r in members[k])]
    assert small[len(small) // 2] < len(members) * 3 // 4
