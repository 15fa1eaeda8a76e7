import random

import numpy as np

from veilspark.llm import license_scan as ls
from veilspark.llm.common import WordHashes, shingle_hashes


def sets(words):
    return {tuple(words[i : i + ls.WIDTH]) for i in range(max(1, len(words) - ls.WIDTH + 1))} if words else set()


def held(text):
    """(license, template) pairs that some window of about the template's length holds, by brute force."""
    words, found = ls.scan_words(text), set()
    for name, texts in ls.TEMPLATES.items():
        for k, t in enumerate(texts):
            template = sets(ls.scan_words(t))
            n = len(template) + ls.WIDTH - 1
            if any(len(sets(words[i : i + n]) & template) >= ls.CONTAINMENT * len(template) for i in range(max(1, len(words) - n + 1))):
                found.add((name, k))
    return found


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r.doc_id, r.license, r.template) for r in ls.scan(docs).collect()}
    likely = [r for r in docs.collect() if "icens" in r.text or "oftware" in r.text]
    wanted = {(r.doc_id, *x) for r in likely for x in held(r.text)}
    assert wanted and found == wanted


def test_long_templates_with_edits(spark):
    rng = random.Random(2)
    filler = lambda n: [f"f{rng.randrange(5000)}" for _ in range(n)]
    rows, wanted, at = [], set(), {}
    for i in range(60):
        name = rng.choice(sorted(ls.TEMPLATES))
        k = rng.randrange(len(ls.TEMPLATES[name]))
        words = ls.TEMPLATES[name][k].split()
        if len(words) > 35:
            words[rng.randrange(10, len(words) - 10)] = "edited"
        before = filler(rng.randrange(300))
        rows.append((i, " ".join([*before, *words, *filler(rng.randrange(300))]).upper() if i % 4 == 0 else " ".join([*before, *words, *filler(50)])))
        wanted.add((i, name, k))
        at[i] = len(before)
    found = ls.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert wanted <= {(r.doc_id, r.license, r.template) for r in found}
    for r in found:
        if (r.doc_id, r.license, r.template) in wanted:
            assert abs(r.first_word - at[r.doc_id]) <= 8 and r.containment >= ls.CONTAINMENT


def test_passages_twice_and_far_apart(spark):
    line = "Released under the MIT License."
    text = f"{line} {'word ' * 50} {line}"
    found = ls.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [(r.license, r.first_word, r.end_word) for r in found] == [("MIT", 0, 5), ("MIT", 55, 60)]


def test_odd_rows(odd, empty, spark):
    assert ls.scan(odd).count() == 0 and ls.scan(empty).count() == 0
    assert ls.scan(spark.createDataFrame([(None, "Released under the MIT License.")], "doc_id bigint, text string")).first().license == "MIT"


def test_blocks_of_larger_sizes_are_unions_of_smaller():
    owner = np.repeat([0, 1, 2], [5, 17, 1])
    small, _ = ls.block_starts(owner, 4)
    large, _ = ls.block_starts(owner, 8)
    assert set(large) <= set(small) and small.tolist() == [0, 4, 5, 9, 13, 17, 21, 22]
    assert len(shingle_hashes([b"a"], WordHashes(), 5)) == 1


def test_short_templates_are_never_missed():
    """Short notices planted in 120,000 texts; with a band of one value for a half of the window, 24 bands miss less than one in ten million."""
    short = [t for texts in ls.TEMPLATES.values() for t in texts if len(ls.scan_words(t)) <= 8]
    templates, hashes = ls.Templates(ls.TEMPLATES), WordHashes()
    rng, missed, planted = random.Random(4), 0, 0
    filler = [f"f{i}".encode() for i in range(5000)]
    assert len(short) >= 5 and templates.bands_of[1] == 24
    for _ in range(240):
        rows, wanted = [], set()
        for i in range(500):
            t = rng.choice(short)
            words = [*rng.choices(filler, k=rng.randrange(6, 14)), *ls.scan_words(t), *rng.choices(filler, k=rng.randrange(6, 14))]
            rows.append(shingle_hashes(words, hashes, ls.WIDTH))
            wanted.add((i, t))
        sizes = np.array([len(x) for x in rows])
        found = {(who, ls.TEMPLATES[templates.names[k][0]][templates.names[k][1]]) for who, k, *_ in ls.matches(np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes), templates, ls.CONTAINMENT)}
        missed += len(wanted - found)
        planted += len(wanted)
    assert planted == 120_000 and missed == 0
