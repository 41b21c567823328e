import random
import tracemalloc
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm.conftest import prose
from tokenizers import Tokenizer

from lakejobs.llm import packing


def slow_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        open_bins = [(room, k) for k, room in enumerate(bins) if room >= length]
        if open_bins:
            bins[min(open_bins)[1]] -= length
        else:
            bins.append(capacity - length)
    return len(bins), sorted(bins)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(4)
    for capacity in (7, 50, 2048):
        for _ in range(30):
            lengths = [rng.choice([1, 2, capacity, rng.randint(1, capacity), rng.randint(1, capacity // 2)]) for _ in range(rng.randrange(1, 300))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            fill = defaultdict(list)
            ranks = defaultdict(set)
            for length, rank, number, first, offset in packing.best_fit(counts, capacity):
                for k in range(number):
                    fill[first + k].append((offset, length))
                    ranks[length].add(rank + k)
            assert all(ranks[x] == set(range(n)) for x, n in counts.items())
            rooms = []
            for places in fill.values():
                end = 0
                for offset, length in sorted(places):
                    assert offset == end
                    end += length
                rooms.append(capacity - end)
            assert (len(fill), sorted(rooms)) == slow_best_fit(lengths, capacity)


def test_tokens_and_places(documents, odd_rows):
    rng = random.Random(9)
    rows = odd_rows + [(100 + k, prose(rng, rng.randrange(1, 900))) for k in range(150)]
    rows += [(300, "It's (DON'T) 'tis we'll <|endoftext|> x<|startoftext|>y 12a3 ÀÉ é ²³ Σας \x85 a_b --- f(x)=\"y\"!")]
    got = packing.op6_best_fit_packing(documents(rows)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(fill) == slow_best_fit([w[3] for w in want], 2048)[0]


def test_greek_capitals_keep_the_tokenizers_ids(documents):
    rows = [(1, "ΟΔΟΣ"), (2, "(ΤΗΣ) ΟΔΟΣ, ΣΑΣ! Οδός"), (3, "ΟΔΟΣ ABC Straße İZMİR")]
    got = packing.op6_best_fit_packing(documents(rows)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in got} == want


def test_no_rows(documents):
    assert packing.op6_best_fit_packing(documents([])).collect() == []


def test_ids_of_every_character():
    """Each character alone, before and after punctuation and beside letters, against the tokenizer itself."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words, tokenizer = packing.Words(path), Tokenizer.from_file(path)
    marks = [chr(c) for c in range(0x21, 0x110000) if unicodedata.category(chr(c))[0] in "LMN" and c < 0x20000] + [chr(c) for c in range(0x21, 0x3000)]
    for pattern in ("{}", "{},", "(x{}.", "a'{}s"):
        texts = [pattern.format(c) for c in marks]
        for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            got = b"".join(map(words.__getitem__, text.encode().split()))
            assert got == np.array(want.ids, "<u4").tobytes(), text
    whole = "BELEDİYESİ, क़क, (ড়ন). ΟΔΟΣ, ΤΗΣ! I'LL DON'T 'S x'Re"
    got = b"".join(map(words.__getitem__, whole.encode().split()))
    assert got == np.array(tokenizer.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_read_together_keep_the_tokenizers_ids(monkeypatch):
    """Words of all kinds in one list, with stores that overflow; only those that are not Latin are read one by one."""
    monkeypatch.setattr(packing, "KEPT_PARTS", 7)
    monkeypatch.setattr(packing, "KEPT_WORDS", 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    known, tokenizer = packing.Words(path), Tokenizer.from_file(path)
    words = "Straße's ÀÉ,'LL óar.boa ½x ÿ×÷ ΟΔΟΣ x<|endoftext|>y áb İz µm 12a3 <|x д'Re (ção) ª ΟΔΟΣ \x85 é".split(" ")
    alone = []
    monkeypatch.setattr(known, "mixed", lambda text, read=known.mixed: (alone.append(text), read(text))[1])
    got = known.of([w.encode() for w in words])
    assert got == [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert not {"Straße's", "ÀÉ,'LL", "óar.boa", "12a3", "(ção)", "é"} & set(alone)
    assert known.of([]) in ([], [b""]) and known[b"12a3"] == got[words.index("12a3")]


def test_many_texts_are_read_by_parts():
    """What a worker holds beside the texts does not grow with their number."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(["".join(rng.choices(letters, k=3)) for _ in range(250)]) for _ in range(200)]
    many = pa.array(texts * 160)
    known = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    once = [tokens for tokens in packing.tokens_of(pa.array(texts), known)]
    tracemalloc.start()
    for k, tokens in enumerate(packing.tokens_of(many, known)):
        assert tokens == once[k % len(texts)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert k + 1 == len(many) and many.nbytes > 30e6
    # All of the texts at once took over 100 MB.
    assert most < 50e6
