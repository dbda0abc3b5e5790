"""Inferred formats: found again without their context, ordinary runs left alone, spans as a plain version gives them."""

import re

import numpy as np
import pyarrow.parquet as pq

from tallyspark.llm import secret_scan as S


def made_docs(spark, n=300):
    """Keys of one format, some behind an assignment and some bare, among words and numbers."""
    draw = np.random.default_rng(12)
    letters, words = list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), [w for w in "alpha betas gamma-ray deltas epsilon 1234567 item.77 under_score file/path/name abcdef".split() for _ in range(3)]
    key = lambda: "-".join("".join(draw.choice(letters, 5)) for _ in range(5))
    keys = [key() for _ in range(n)]
    line = lambda: " ".join(draw.choice(words, 30))
    return keys, spark.createDataFrame([(i, f"{line()} {'token=' if i % 2 else ''}{k}. {line()}") for i, k in enumerate(keys)], "doc_id bigint, text string")


def test_bare_credentials_are_found(spark):
    keys, docs = made_docs(spark)
    rows = {r.doc_id: r for r in S.scan(docs).collect()}
    found = [any(s.kind == "format" and rows[i].text[s.start : s.end] == k for s in rows[i].secrets) for i, k in enumerate(keys) if i % 2 == 0]
    assert np.mean(found) >= 0.95
    assert all(s.base or rows[i].text[s.start : s.end] == keys[i] for i in rows for s in rows[i].secrets)
    assert all([s.kind for s in rows[i].secrets] == ["assign"] and rows[i].secrets[0].margin > S.MARGIN for i in rows if i % 2)
    masked = {r.doc_id: r.text for r in S.redact(docs).collect()}
    assert sum(k in masked[i] for i, k in enumerate(keys)) <= 0.05 * len(keys)


def test_spans_are_those_of_a_plain_version(spark):
    _, docs = made_docs(spark, 60)
    formats = S.learn_formats(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.scan(docs, formats).collect():
        text = texts[r.doc_id]
        base = [(s, e) for (s, _, e), _ in S.base_spans(text)]
        runs = [(m.start(), m.start() + len(m[0].rstrip("."))) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", text)]
        free = [(s, e) for s, e in runs if e - s >= 6 and not any(s < f and b < e for b, f in base)]
        margin = lambda v: max(f.log_likelihood(v) for f in formats.kinds) - max(len(v) * S.EVEN, *(f.log_likelihood(v) for f in formats.ordinary))
        assert [(s.start, s.end) for s in r.secrets if not s.base] == [(s, e) for s, e in free if margin(text[s:e]) >= formats.cut]


def test_held_out_credentials_and_ordinary_runs():
    """Half of the credentials of the given documents are learnt; of the others at least 0.8 are found by their format alone, and of over 200,000 ordinary runs under one in 10,000 is."""
    credentials, ordinary = {}, {}
    for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist():
        found = sorted(S.base_spans(t or ""))
        for (_, kind, _), value in found:
            credentials.setdefault(kind, set()).add(value)
        for _, _, value in S.candidates(t or "", [s for s, _ in found]):
            ordinary.setdefault(S.make_up(value), set()).add(value)
    lowest = lambda values, n: sorted(values, key=S.rank)[:n]
    formats = S.Formats({k: lowest(v, S.LABELLED)[::2] for k, v in credentials.items()} | {3: [x for k in sorted(ordinary) for x in lowest(ordinary[k], 2 * S.LABELLED)]})
    for v in credentials.values():
        unseen = lowest(v, S.LABELLED)[1::2]
        assert np.mean([formats.margin(x) >= formats.cut for x in unseen]) >= 0.8
    runs = [x for v in ordinary.values() for x in v]
    assert len(runs) > 200_000 and np.mean([formats.margin(x) >= formats.cut for x in runs]) < 1e-4


def test_one_long_run_and_many_spans():
    text = "token=abcdef1 " * 2000 + "x" * 50_000
    formats = S.Formats({0: ["abcdef1"], 3: ["words", "x" * 9]})
    assert len(formats.spans(text)[0]) == 2000 and [k for _, k, _ in formats.spans(text)[1] if k == 3] == []
