import random
import re

import numpy as np
import pytest

from veilspark.llm import near_dedup as n
from veilspark.llm.common import Scratch, WordHashes, ascii_words, shingle_hashes
from veilspark.llm.graph import components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def wanted(rows, width):
    """id -> (set size, least id reachable), by all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(spark, rows, width):
    found = n.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("width", [4, 5])
def test_whole_table(spark, small, width):
    check(spark, [(r.doc_id, r.text) for r in small], width)


@pytest.mark.parametrize("long_list,block", [(64, 1024), (2, 7)])
def test_large_group_of_near_copies(spark, monkeypatch, long_list, block):
    """Chains of edits: many members are too far from any leader, but linked through others."""
    monkeypatch.setattr(n, "LONG_LIST", long_list)
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "STAR_ROUNDS", 2 if block > 7 else 0)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, text = [], words
    for i in range(150):
        text = [*text]
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text if rng.random() < 0.7 else words)))
    rows += [(1000 + i, f"short {i % 3}") for i in range(30)] + [(2000 + i, " ".join(words[:60]) + f" tail {i} " * 20) for i in range(40)]
    check(spark, rows, 4)


def test_odd_rows(odd, odd_rows, empty):
    found = n.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert by[2].n_shingles == by[3].n_shingles == by[1].n_shingles == 0 and by[5].component_id == 4 and not by[5].kept
    assert by[7].component_id == 6 and by[9].component_id == 8
    kept = n.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 6, 8, 10, 11, 12}
    assert n.near_duplicates(empty).count() == 0 and n.drop_near_duplicates(empty).count() == 0


def test_signature_estimates_similarity():
    hashes = WordHashes()
    a = np.unique(shingle_hashes(ascii_words(" ".join(f"a{i}" for i in range(400))), hashes, 5))
    b = np.concatenate([a[:300], np.unique(shingle_hashes(ascii_words(" ".join(f"b{i}" for i in range(100))), hashes, 5))])
    same = (n.signature(a, 4096) == n.signature(b, 4096)).mean()
    assert abs(same - 300 / (len(a) + len(b) - 300)) < 0.03


def test_components_against_plain_search(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (5, 5)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"), "c")
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {r.node: r.label for r in found.collect()} == label


def test_recall_of_pairs_just_above_the_similarity(spark):
    """Pairs planted at 0.80 to 0.85 among texts without links: each is found."""
    rng = random.Random(9)
    rows, planted = [], []
    for i in range(1500):
        words = [f"w{i}x{k}" for k in range(rng.randrange(110, 400))]
        size = len(words) - 3
        changed = list(words)
        # a changed word takes 4 shingles out of either set: similarity (size - 4 c) / (size + 4 c)
        c = max(c for c in range(1, 40) if 100 * (size - 4 * c) >= 80 * (size + 4 * c))
        for at in range(c):
            changed[8 + at * ((len(words) - 16) // c)] = f"y{i}z{at}"
        similarity = (size - 4 * c) / (size + 4 * c)
        if similarity <= 0.85:
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
            planted.append(i)
    found = {r.doc_id: r.component_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()}
    assert len(planted) > 1000 and [i for i in planted if found[2 * i + 1] != 2 * i] == []
    assert all(found[2 * i] == 2 * i for i in planted)
