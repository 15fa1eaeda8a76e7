import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def wanted(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def check(docs, rows):
    found = sorted(tuple(r) for r in token_count.token_counts(docs, PATH, limit=3).select("n_bytes", "n_tokens", "over_limit").collect())
    assert found == sorted((len((t or "").encode()), wanted(t), wanted(t) > 3) for t in rows)


def test_library_counts(spark, small):
    check(spark.createDataFrame([(r.doc_id, r.text) for r in small], "doc_id bigint, text string"), [r.text for r in small])


def test_odd_rows(odd, odd_rows):
    check(odd, [r[1] for r in odd_rows])


def test_white_space(spark):
    texts = ["a  b", "a\n\n b", " a", "\n a", "a \t b", "a\t  b", "x  y", "  ", "\n", "a \n b", "​ a", "a\r\n b", "'s  's", "<|endoftext|>", "a <|endoftext|> b", "it's 12 34!? -- ok"]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), texts)


def test_batches_and_full_cache(monkeypatch):
    monkeypatch.setattr(token_count, "CACHED", 3)
    texts = ["the cat sat on the mat " * 5, "", "other words entirely here"]
    assert token_count.count_batch(texts, token_count.PieceCounts(PATH), None).tolist() == [wanted(t) for t in texts]


def test_empty(empty):
    assert token_count.token_counts(empty, PATH).count() == 0


def test_other_letters_and_signs(spark):
    """Parts of words by the tokenizer's model against the whole tokenizer."""
    texts = ["Éte ÑANDÚ ß straße Ünïcödé ÿ Ÿ µ ª º", "a1b22c333 x.y,z;w! (a)[b]{c}<d> ~`^_|@#$%&*+=-/ \\ \"q\"", "don't CAN'T it's 'quoted' o'", "ÀÖØöøÿ×÷", "<|startoftext|> a<|endoftext|>b <|end", "e\u0301 A\u030a \u212b \u1e9b\u0323", "1234 ² ½ Ⅷ ٣ 五", "ab\xa0cd \u2003 ef\x1cgh", "word" * 90 + " " + "9" * 300]
    check(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), texts)


def test_join_of_dataframes(spark, small, odd, odd_rows):
    """Without mapped files: pairs, distinct pre-tokens, counts, join, sum."""
    for docs, texts in ((spark.createDataFrame([(r.doc_id, r.text) for r in small], "doc_id bigint, text string"), [r.text for r in small]), (odd, [r[1] for r in odd_rows])):
        found = sorted(tuple(r) for r in token_count.token_counts(docs, PATH, limit=3, mapped=False).select("n_bytes", "n_tokens", "over_limit").collect())
        assert found == sorted((len((t or "").encode()), wanted(t), wanted(t) > 3) for t in texts)


def test_many_shards(spark, small, monkeypatch):
    monkeypatch.setattr(token_count, "BYTES_A_SHARD", 20_000)
    check(spark.createDataFrame([(r.doc_id, r.text) for r in small], "doc_id bigint, text string"), [r.text for r in small])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1!' \n\t\r\x0b\xa0 　\x1c\x1f\x85᠎​﻿é日<|endoftext|>"), max_size=40) | st.text(max_size=30))
def test_cut_at_any_white_space(text):
    text = text.encode("utf-8", "replace").decode()
    found = token_count.pretokens(text, token_count.added_strings(PATH), token_count.plain_added(PATH))
    assert "".join(found) == text and token_count.PieceCounts(PATH).of(found).sum() == wanted(text)


def test_each_distinct_pretoken_is_counted_once(spark, small, monkeypatch, tmp_path):
    texts = [r.text for r in small]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k::3], pa.string())], ["text"]) for k in range(3)]
    blocks = [b for x in batches for b in token_count._distinct(iter([x]), PATH, 0)]
    counted = []
    monkeypatch.setattr(token_count.PieceCounts, "pieces", lambda self, x: counted.append(x) or 1)
    token_count._write_shard(pa.Table.from_batches(blocks), PATH, str(tmp_path))
    distinct = {x for t in texts for x in token_count.pretokens(t, token_count.added_strings(PATH))}
    assert len(counted) == len(distinct) and set(counted) == distinct
