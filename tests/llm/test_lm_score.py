import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from veilspark.llm import lm_score as lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "<end>"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain(rows):
    """The whole model with dictionaries: row -> (held out, tokens, known, training tokens, base, score), and p(w, u)."""
    train = [tokens(t) for i, t in rows if not held(i)]
    words = Counter(w for t in train for w in t)
    pairs = Counter((u, w) for t in train for u, w in zip(["<end>", *t], t))
    n, v = sum(words.values()), len(words)
    if not v:
        return [(held(i), len(tokens(t)), 0, 0, 0.0, 0.0) for i, t in rows], None, {}
    followers = defaultdict(list)
    continues = Counter()
    for (u, w), c in pairs.items():
        followers[u].append(c)
        continues[w] += 1
    d = lm.discounts([sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])
    e = lm.discounts([sum(k == i for k in continues.values()) for i in (1, 2, 3, 4)])
    rest = sum(e[min(k, 3)] for k in continues.values()) / len(pairs)

    def p(w, u):
        k = continues.get(w, 0)
        low = max(k - e[min(k, 3)], 0) / len(pairs) + rest / (v + 1)
        if u not in followers:
            return low
        c, total = pairs.get((u, w), 0), sum(followers[u])
        return max(c - d[min(c, 3)], 0) / total + sum(d[min(x, 3)] for x in followers[u]) / total * low

    out = []
    for i, t in rows:
        x = tokens(t)
        out.append((held(i), len(x), sum(w in words for w in x), n, sum(math.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in x), sum(math.log10(p(w, u)) for u, w in zip(["<end>", *x], x))))
    return out, p, words


def check(docs, rows):
    wanted, p, words = plain(rows)
    found = lm.scores(docs).collect()
    key = lambda r: (r[0], r[1], r[2], r[3], round(r[4], 4), round(r[5], 4))
    got = sorted(key((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in found)
    for a, b in zip(got, sorted(map(key, wanted)), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-5, abs=1e-3)
    return found, p, words


@pytest.mark.parametrize("shard", [12 << 20, 20_000])
def test_whole_table(spark, small, monkeypatch, shard):
    monkeypatch.setattr(lm, "BYTES_A_SHARD", shard)
    monkeypatch.setattr(lm, "TOKENS_A_FLUSH", 3000)
    rows = [(r.doc_id, r.text) for r in small]
    found, p, words = check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
    for u in ("<end>", "the", "never seen"):
        assert sum(p(w, u) for w in words) + p("an unknown word", u) == pytest.approx(1)


def test_odd_rows(odd, odd_rows, empty):
    check(odd, [r[:2] for r in odd_rows])
    assert lm.scores(empty).count() == 0


def test_no_training_text(spark):
    ids = [i for i in range(60) if held(i)][:3]
    check(spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string"), [(i, "a b") for i in ids])


def test_arrays_survive_packing():
    import numpy as np

    keys = np.array([0, 5, 2**40, 2**64 - 1], np.uint64)
    assert (lm.unpacked_sorted(lm.packed_sorted(keys)) == keys).all() and len(lm.unpacked(lm.packed(np.empty(0, np.int64)))) == 0
