"""Clustering, packing and ranked search against plain versions and on odd tables."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, log

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark.llm import bpe_rounds, bpe_vocab, centroids, packing, ranked_search
from tallyspark.llm.words import alnum_words

SF = "/root/testdata/sf0.001"


def plain_clusters(rows, k, rounds):
    """rows: (vec_id, integers), as (vec_id, cluster, distance)."""
    order = sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    c = [list(v) for _, v in order]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in rows]
        for j in range(len(c)):
            if own := [v for (_, v), t in zip(rows, to, strict=True) if t == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i if i is not None else -1, near(v)[1], near(v)[0]) for i, v in rows))


@pytest.mark.parametrize(("dim", "k", "n"), [(5, 4, 300), (8, 6, 200), (3, 16, 9)])
def test_clusters_are_those_of_the_plain_version(spark, dim, k, n):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(n, dim)) * 0.3 + rng.integers(0, 3, size=(n, 1))
    x[: n // 3] = x[0]  # a hot vector
    rows = [(None if i == 7 else i // 2, list(map(float, v))) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [None] * dim)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "cluster", "cells", "norm")})
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in centroids.cluster(df, k=k, dim=dim).collect())
    assert got == plain_clusters([(i, [floor(64 * a) for a in v]) for i, v in rows], k, 3)


def test_clusters_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert centroids.cluster(none).isEmpty() and centroids.cluster(none).schema == spark.createDataFrame([], centroids.RESULT).schema
    with pytest.raises(PySparkException, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [2.0**21] * 2)], "vec_id bigint, embedding array<double>"), dim=2).collect()


def test_cells_bound_distances_and_settle_most_vectors(spark):
    x = np.floor(64 * np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()], float)).astype(np.int64)
    cells = centroids.Cells(x, x.min(axis=0), x.max(axis=0))
    middle = np.array([x[i::16].sum(axis=0) // len(x[i::16]) for i in range(16)])
    tables = centroids.Tables(cells, middle)
    codes, norm = cells.encode(x), (x**2).sum(axis=1)
    exact = ((x[:, None] - middle) ** 2).sum(axis=2)
    least, most = tables.intervals(codes, norm)
    assert (least <= exact).all() and (exact <= most).all()
    assert (tables.nearest(x, tables.possible(codes, norm))[0] == exact.argmin(axis=1)).all()
    assert tables.possible(codes, norm).sum() < 0.6 * exact.size


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


ODD = ["", " ", "a  b", "x" * 3000, "don't it's\n\nok  ", "\ta b", "é漢字 <|endoftext|> \U0001f600 naïve", "one two\nthree four,five", "a b c", " lead", "trail ", "aaaa" * 20 + " bb", "1234 56 78x9", "mixed\tTabs and spaces"]


def test_rounds_give_the_library_s_ids(spark):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    path = bpe_vocab.default_path()
    lib, codec = library(path), bpe_rounds.codec(bpe_vocab.read_vocab(path))
    for _ in range(2):  # unknown and known
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    codec.forget()


def check_packing(rows, most):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= most
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_doc, len(by_sequence)


def test_packing_is_whole_gapless_and_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_doc, n = check_packing(packing.pack(docs).collect(), 1024)
    lib = library(bpe_vocab.default_path())
    tokens = 0
    for d in docs.collect():
        ids = np.array(lib.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        parts = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 1024)))
        assert all(r.length == 1024 for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        tokens += len(ids)
    assert n <= 1.005 * -(-tokens // 1024)


def test_packing_odd_tables(spark, odd_docs, no_docs):
    packed = packing.pack(odd_docs, limit=64, with_ids=True)
    by_doc, n = check_packing(packed.collect(), 64)
    assert len(by_doc[2]) == 1 and by_doc[2][0].length == 1 and len(by_doc[1]) == 2 * len(by_doc[None])
    joined = packing.sequences(packed)
    assert joined.count() == n and joined.where("length(ids) <> 4 * n_tokens").isEmpty()
    assert packing.pack(no_docs).isEmpty()


@pytest.mark.parametrize("lengths", [[1] * 5000, [1024] * 7, [600] * 50 + [424] * 30 + [100] * 9, list(range(1, 1025)) * 3, [3], [513] * 40, [341] * 90 + [342] * 30])
def test_plans_place_every_piece(lengths):
    plan = packing.plan_of(Counter(lengths))
    assert {n: sum(c) for n, c in plan.counts.items()} == Counter(lengths)
    room = np.zeros(plan.sequences, int)
    for n, counts in plan.counts.items():
        for count, first in zip(counts, plan.firsts[n], strict=True):
            room[first : first + count] += n
    assert room.max() <= 1024 and plan.sequences <= 1.01 * max(-(-sum(lengths) // 1024), sum(n > 512 for n in lengths)) + 1


def plain_search(docs, queries, k):
    words = [(i, Counter(w), len(w)) for i, t in docs if (w := alnum_words(t or ""))]
    n, total = len(words), sum(x[2] for x in words)
    df = Counter(x for _, c, _ in words for x in c)
    out = []
    for item, t in queries:
        scored = []
        for i, c, size in words:
            m = 75 + (25 * size * n) // total
            s = sum(q * floor(1000 * log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x, q in Counter(alnum_words(t or "")).items() if c[x])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("tokens", "chars"), [(1 << 20, 1 << 22), (60, 40)])
def test_ranked_search_is_the_plain_one(spark, monkeypatch, tokens, chars):
    monkeypatch.setattr(ranked_search, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", chars)
    monkeypatch.setattr(ranked_search, "FIRST_READ", 2)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(words[int(i)] for i in np.minimum(rng.zipf(1.5, n) - 1, 39))
    docs = [(i, text(int(rng.integers(1, 30)))) for i in range(150)] + [(500 + i, "w3 w9 W3") for i in range(60)] + [(None, "w3 w9"), (None, None), (7, ""), (7, "w3 w3 w3 w3 w3"), (8, "w1 " * 900)]
    queries = [(1, "w3 w9"), (2, "W3 w3 w39 nowhere"), (3, None), (4, ""), (5, "nowhere"), (None, "w1 w2"), (1, "w1"), (6, text(30))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("score", "rank", "query", "part")})
    asked = spark.createDataFrame(queries, "item_id bigint, text string").withColumns({c: F.lit(0) for c in ("query", "block", "doc_id")})
    got = ranked_search.search(ranked_search.build_index(df.repartition(3)), asked, k=7)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, queries, 7)


def test_ranked_search_stops_early():
    """Best positions stop before the lists end, and never at an equal score."""
    n = 20_000
    word = {b"a": np.arange(n)[::-1], b"b": np.arange(n)[::-1]}
    codes = [np.array([0, 1] * (1 + (i > n - 40)), np.int32) for i in range(n)]
    number = ranked_search.Numbers()
    for w in word:
        number[w]
    batch = ranked_search.shard(list(range(n)), codes, number, n, sum(map(len, codes)))
    row = {c: batch.column(i)[0].as_py() for i, c in enumerate(batch.schema.names)}
    best = ranked_search.Best(5)
    looked = ranked_search.best_positions(ranked_search.Lists(row, set(word)), [(b"a", 10), (b"b", 7)], best)
    assert looked < n // 100 and best.rows[2].tolist() == list(range(n - 39, n - 34))


def test_ranked_search_of_nothing(spark, no_docs, odd_docs):
    asked = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    assert ranked_search.search(ranked_search.build_index(no_docs), asked).isEmpty()
    index = ranked_search.build_index(odd_docs)
    assert ranked_search.search(index, asked.where("false")).isEmpty()
    assert [(r.rank, r.doc_id) for r in ranked_search.search(index, asked).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 5), (4, None)]
