import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from veilspark.llm import url_filter as u
from veilspark.llm.queries import URL_RULES, op7_url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_hosts_rules_and_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    found = op7_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(urls)
    for r in found:
        host, path = parts(urls[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == (verdict or ("allow" if r.p_allow >= 0.5 else "block"))


@pytest.mark.parametrize("url", [None, "", "nothing", "http://", "HTTP://Sub.Example.ORG/es/1", "x://org", "http://org/", "http://notorg/", "http://a.com?x=/fr/", "http://a.com/fr/#/de/", "http://É.com/de/\n", "a://b://c/d", "http://example.org/en/12", "http://org:80/"])
def test_odd_urls(spark, url):
    r = u.judge(spark.createDataFrame([(1, url, "h")], "page_id bigint, url string, host string"), URL_RULES).first()
    host, path = parts(url)
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule(host, path)[0], rule(host, path)[1] or "allow")


def plain_log_likelihood(url, counts):
    """The mixture written out byte by byte, over exact counts."""
    stream = b"\0" * u.ORDER + url
    total = 0.0
    for i in range(u.ORDER, len(stream)):
        p = 1 / 256
        for k in range(u.ORDER + 1):
            context = stream[i - k : i]
            p = (counts.get((context, stream[i]), 0) + u.PRIOR * p) / (counts.get(context, 0) + u.PRIOR)
        total += math.log(p)
    return total


def exact_counts(urls):
    counts = {}
    for url in urls:
        stream = b"\0" * u.ORDER + url
        for i in range(u.ORDER, len(stream)):
            for k in range(u.ORDER + 1):
                context = stream[i - k : i]
                counts[context] = counts.get(context, 0) + 1
                counts[context, stream[i]] = counts.get((context, stream[i]), 0) + 1
    return counts


def test_model_against_plain_code(spark, tmp_path, monkeypatch):
    """Counts through tasks, shards and files, against dictionaries; with long and repeated URLs."""
    monkeypatch.setattr(u, "FLUSH", 100)
    seen, new = [b"http://good.example/en/1", b"http://good.example/en/22", b"x", b"x", b"\0\0a", b"http://long.example/" + b"ab/" * 3000], [b"http://good.example/de/3", b"", b"zzz", b"\0", b"http://long.example/" + b"ba/" * 3000, "é日".encode()]
    counts = exact_counts(seen)
    for bits in (0, 2):
        folder = str(tmp_path / str(bits))
        batch = pa.RecordBatch.from_arrays([pa.array([x.decode() for x in seen]), pa.array([1] * len(seen), pa.int32()), pa.array([k % 2 for k in range(len(seen))], pa.int32())], ["url", "model", "fold"])
        table = pa.Table.from_batches(list(u._counted(iter([batch.slice(0, 4), batch.slice(4)]), bits)))
        for s in range(1 << bits):
            part = table.filter(pa.compute.equal(table.column("shard"), s))
            if part.num_rows:
                u._write_shard(part, folder)
        found = u.log_likelihood(new, u.Counts(folder, bits, (2, 3)))
        assert np.allclose(found, [plain_log_likelihood(x, counts) for x in new])
        nothing = u.log_likelihood(new, u.Counts(folder, bits, (0, 1)))
        assert np.allclose(nothing, [plain_log_likelihood(x, {}) for x in new])


def test_tells_kinds_apart(spark):
    rows = [(i, f"http://{'cheap-pills' if i % 2 else 'museum'}{i % 37}.{'com/de/' if i % 2 else 'org/'}{i}") for i in range(400)]
    rows += [(1000 + i, f"http://{'cheap-pills' if i % 2 else 'museum'}{i}.net/{i}") for i in range(100)]
    found = u.judge(spark.createDataFrame(rows, "page_id bigint, url string"), URL_RULES).where("page_id >= 1000").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in found) >= 95


def test_empty_and_one_kind(spark, empty):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert u.judge(pages, URL_RULES).count() == 0
    kept = u.keep_allowed(spark.createDataFrame([(1, "http://a.org/x", "en"), (2, "http://b.com/de/", "en"), (None, "http://c.org/", None)], "page_id bigint, url string, lang string"), URL_RULES)
    assert kept.columns == ["page_id", "url", "lang"] and {r.url for r in kept.collect()} == {"http://a.org/x", "http://c.org/"}
