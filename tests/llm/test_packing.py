import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def wanted(rows, capacity):
    library = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


def check(docs, rows, capacity):
    found = packing.pack(docs, PATH, capacity=capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted(rows, capacity)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in found)


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in small]
    n, total = check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 4096)
    assert n <= -(-total // 4096) + 1


def test_odd_rows(odd, odd_rows, empty):
    check(odd, [(r[0], r[1]) for r in odd_rows], 64)
    assert packing.pack(empty, PATH).count() == 0


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_GROUP", 10)
    rows = [(i, "same words here" if i % 3 else f"other {i}") for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 16)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_holds_every_piece(histogram):
    configs = packing.plan(histogram, 60)
    held = Counter()
    for config, n in configs:
        assert sum(x * k for x, k in config) <= 60 and n > 0
        for x, k in config:
            held[x] += n * k
    assert held == Counter(histogram)
    if histogram:
        assert sum(n for _, n in configs) <= sum(n for _, n in packing.best_fit(histogram, 60))


def test_knapsack_against_all_multisets():
    lengths, worth = np.array([3, 5, 8]), np.array([0.31, 0.52, 0.85])
    most = max(a * 0.31 + b * 0.52 + c * 0.85 for a in range(8) for b in range(5) for c in range(3) if 3 * a + 5 * b + 8 * c <= 21)
    config = packing.best_configuration(lengths, worth, 21)
    assert abs(sum(dict(zip((3, 5, 8), worth))[x] * k for x, k in config) - most) < 1e-9


def test_other_letters_and_signs(spark):
    """Parts of words by the tokenizer's model against the whole tokenizer."""
    texts = ["Éte ÑANDÚ ß straße Ünïcödé ÿ Ÿ µ ª º", "a1b22c333 x.y,z;w! (a)[b]{c}<d> ~`^_|@#$%&*+=-/ \\ \"q\"", "don't CAN'T it's 'quoted' o'", "ÀÖØöøÿ×÷", "<|startoftext|> a<|endoftext|>b <|end", "e\u0301 A\u030a \u212b \u1e9b\u0323", "1234 ² ½ Ⅷ ٣ 五", "ab\xa0cd \u2003 ef\x1cgh", "word" * 90 + " " + "9" * 300]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), list(enumerate(texts)), 4096)


def test_the_program_places_most_pieces():
    """Lengths like those of documents, with lengths that many copies share: the lower bound is met, and nearly all by the program."""
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.lognormal(6.4, 0.9, 20_000).astype(int) + 1, 4096)
    histogram = Counter(lengths.tolist()) + Counter({829: 900, 3000: 300, 236: 500})
    configs, share = packing.planned(histogram, 4096)
    n = sum(k for _, k in configs)
    assert share >= 0.9 and packing.lower_bound(histogram, 4096) <= n <= sum(k for _, k in packing.best_fit(histogram, 4096))
    assert n <= packing.lower_bound(histogram, 4096) + 1


def test_lower_bound_where_lengths_fit_badly():
    assert packing.lower_bound({2500: 10}, 4096) == 10 and packing.lower_bound({1000: 9}, 4096) == 3 and packing.lower_bound({4096: 2, 1: 1}, 4096) == 3
    assert sum(n for _, n in packing.plan({1000: 9}, 4096)) == 3
