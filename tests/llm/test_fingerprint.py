import hashlib

from veilspark.llm import fingerprint as f


def words(text):
    return [w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if w]


def jaccard(a, b, width=f.WIDTH):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in (words(a), words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def edited(rows):
    """rows: (id, text) with distinct ids -> id: (text, edited text, next text)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = (t, t[: len(t) - cut] + following[:cut], following)
    return out


def check(docs, rows, monkeypatch, rows_a_range):
    monkeypatch.setattr(f.ranges, "__defaults__", (rows_a_range,))
    found = {r.doc_id: r for r in f.edited_fingerprints(docs).collect()}
    wanted = edited(rows)
    assert found.keys() == wanted.keys()
    off = []
    for i, (text, changed, following) in wanted.items():
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert len(r.fingerprint) in (0, f.BINS * f.KEPT_BITS // 4)
        off += [abs(r.near_edited - jaccard(text, changed)), abs(r.near_next - jaccard(text, following))]
        if text == changed:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    return off


def test_whole_table_in_many_ranges(spark, small, monkeypatch):
    rows = [(r.doc_id, r.text) for r in small]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    off = check(docs, rows, monkeypatch, 7)
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2


def test_one_range_and_odd_texts(spark, odd_rows, monkeypatch):
    rows = list({r[0]: (r[0], r[1]) for r in odd_rows if r[0] is not None}.values())
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, monkeypatch, 1000)


def test_nulls_and_repeated_rows(odd, odd_rows, empty):
    found = f.edited_fingerprints(odd).collect()
    assert len(found) == len(odd_rows)
    assert len({r.fingerprint for r in found if r.doc_id == 7}) == 1
    assert f.edited_fingerprints(empty).count() == 0 and f.fingerprints(empty).count() == 0


def test_bins_against_plain_code(spark):
    """The fingerprint of a text by a plain reading of the method, with Spark's hash."""
    text = " ".join(f"w{i}" for i in range(60))
    hashes = [r.h for r in spark.createDataFrame([(words(text)[i : i + 5],) for i in range(56)], "w array<string>").selectExpr("xxhash64(w) h").collect()]
    least = {}
    for h in hashes:
        b = (h >> f.VALUE_BITS) + f.BINS // 2
        least[b] = min(h, least.get(b, h))
    fp = f.fingerprints(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().fingerprint
    values = {}
    for i in range(f.BINS):
        looks = [i, *((a * i + b) % f.BINS for a, b in map(f._step, range(1, f.ATTEMPTS + 1)))]
        if (seen := next((j for j in looks if j in least), None)) is not None:
            values[i] = least[seen]
    assert len(values) > f.BINS * 0.8
    kept = {r.i: r.b for r in spark.createDataFrame(list(values.items()), "i int, v bigint").selectExpr("i", "xxhash64(v, i) & 15 as b").collect()}
    assert all(int(fp[i], 16) == b for i, b in kept.items())


def test_ids_of_other_types(spark, small, monkeypatch):
    """Names as ids, in many ranges: the next document is the one before it in the order of names."""
    monkeypatch.setattr(f.ranges, "__defaults__", (7,))
    rows = {f"doc-{r.doc_id * 7919 % 1000:03}": r.text for r in small}
    found = {r.doc_id: r.edited_sha256 for r in f.edited_fingerprints(spark.createDataFrame(list(rows.items()), "doc_id string, text string")).collect()}
    order = sorted(rows, reverse=True)
    for k, name in enumerate(order):
        text, following = rows[name] or "", rows[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        assert found[name] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
