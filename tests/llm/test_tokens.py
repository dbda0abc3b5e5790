"""Token counts and the codec against the tokenizers library."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

from tallyspark.llm import bpe_codec, bpe_vocab, queries, token_counts

SF = "/root/testdata/sf0.001"


def library():
    return Tokenizer.from_file(bpe_vocab.default_path())


def test_query_results_are_the_librarys(spark):
    t = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {d.doc_id: t.encode(d.text or "", add_special_tokens=False).ids for d in docs}
    text = {d.doc_id: d.text or "" for d in docs}
    for r in queries.QUERIES["op6_token_counts"](spark, SF).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 1024)
    for r in queries.QUERIES["op9_bpe_codec"](spark, SF).collect():
        want = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(spark, odd_docs, no_docs):
    t = library()
    counted = token_counts.token_counts(odd_docs).collect()
    assert len(counted) == odd_docs.count()
    for r in counted:
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
    coded = bpe_codec.decode(bpe_codec.encode(odd_docs)).collect()
    assert all(r.decoded == (r.text or "") for r in coded) and all(np.frombuffer(r.ids, "<u4").tolist() == t.encode(r.text or "", add_special_tokens=False).ids for r in coded)
    assert token_counts.token_counts(no_docs).isEmpty() and bpe_codec.encode(no_docs).isEmpty()


def test_every_token_is_its_own_encoding_or_as_the_library_says():
    v = bpe_vocab.Vocab(bpe_vocab.read_vocab(bpe_vocab.default_path()))
    c, counts = bpe_codec.Codec(v), token_counts.Counts(v)
    some = sorted(v.ids)[::7]
    for word, ids in c.encode_words(some):
        assert len(ids) // 4 == len(word) - counts.merges(word)
        assert b"".join(c.bytes_of[i] for i in np.frombuffer(ids, "<u4")) == word
