"""Secrets, benchmark passages, near-duplicates and licences against plain versions, and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import automata, decontaminate, license_scan, near_dups, queries, secret_scan

SF = "/root/testdata/sf0.001"
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def plain_spans(text):
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        found += [(m.start(), 1, m.end())] * (len(m[0]) >= 20)
    for m in re.finditer("[0-9a-f]+", text):
        found += [(m.start(), 2, m.end())] * (len(m[0]) >= 24)
    return sorted(found)


def test_base_secrets(spark):
    texts = {r.doc_id: r.text for r in rows(spark, "/root/testdata/sf0.01", "documents")}
    for r in queries.QUERIES["op3_secret_scan"](spark, "/root/testdata/sf0.01").collect():
        want = plain_spans(texts[r.doc_id])
        line = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_formats_are_inferred():
    draw = np.random.default_rng(1)
    hexes = ["".join(draw.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    a = automata.Automaton(hexes[:150])
    assert len(a.next) < 100
    other = ["".join(draw.choice(list("ghijklmnop"), 40)) for _ in range(20)]
    assert min(map(a.log_likelihood, hexes[150:])) > max(map(a.log_likelihood, other))
    formats = secret_scan.Formats({2: hexes[:150], 3: ["word-like.text1", "some/path/name2", "other_things33"] * 5})
    text = "see " + hexes[160].upper().lower()[:20] + " and token = abc"
    assert [k for _, k, _ in formats.spans(text)[1]] == [3]


def test_odd_secrets(odd_docs, no_docs):
    assert secret_scan.scan(odd_docs).count() == odd_docs.count() and secret_scan.scan(no_docs).isEmpty()
    redacted = secret_scan.redact(odd_docs.withColumn("text", F.concat("text", F.lit(" token=abcdef123")))).collect()
    assert all(r.text is None or r.text.endswith("[SECRET]") for r in redacted)


def test_windows_of_the_benchmark(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = defaultdict(set)
    for r in rows(spark, SF, "benchmark"):
        w = word.findall(low(r.text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            found[tuple(w[i : i + 10])].add(str(r.item_id))
    got = {r.doc_id: r for r in queries.QUERIES["op2_decontamination"](spark, SF).collect()}
    for d in rows(spark, SF, "documents"):
        w, hit, items = word.findall(low(d.text or "")), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if k := found.get(tuple(w[i : i + n])):
                    items |= k
                    hit.update(range(i, i + n))
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_phrases_in_blocks_and_near(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "Beta gamma delta"), (2, "tau"), (None, "eta theta"), (3, None), (1, "Beta gamma delta"), (4, "delta beta")], "item_id bigint, text string")
    whole = {(r.doc_id, r.n_words): (r.hits, {p.item_id for p in r.passages}) for r in decontaminate.contamination(odd_docs, bench).collect()}
    assert whole[(1, 19)][0] == [(1, 4), (6, 8), (18, 19)] and whole[(1, 19)][1] == {"1", "2"}
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", 2)
    again = {(r.doc_id, r.n_words): ([tuple(h) for h in r.hits], {p.item_id for p in r.passages}) for r in decontaminate.contamination(odd_docs, bench).collect()}
    assert again == {k: ([tuple(h) for h in v[0]], v[1]) for k, v in whole.items()}
    near = decontaminate.search(decontaminate.build_index(odd_docs), decontaminate.windows(bench.where("item_id = 4")), span=3).where("doc_id = 1").first()
    assert [tuple(h) for h in near.hits] == [(1, 4)]
    assert decontaminate.contamination(no_docs, bench).isEmpty()
    assert decontaminate.contamination(odd_docs, bench.where("false")).where("size(hits) > 0").isEmpty()


def components(sets, percent=85):
    parent, inverted = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for x in sets[i] for j in inverted[x])
        for x in sets[i]:
            inverted[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(200)).split()
    draw = np.random.default_rng(2)
    made = {}
    for i in range(300):  # variants of one text, from hardly to much changed
        w = list(base)
        for j in draw.choice(200, int(draw.integers(0, 12)), replace=False):
            w[j] = f"v{i}_{j}"
        made[1000 + i] = " ".join(w)
    docs = {r.doc_id: r.text for r in rows(spark, SF, "documents")} | made
    sets = {i: shingles(t) for i, t in docs.items()}
    want = components(sets)
    got = near_dups.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (want[i], len(sets[i]), want[i] == i) for i in docs}


def test_odd_near_duplicates(odd_docs, no_docs):
    got = near_dups.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    kept = [r.doc_id for r in near_dups.deduplicated(odd_docs).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 6, 7, 8] and kept.count(None) == 1
    assert near_dups.near_duplicates(no_docs).isEmpty()


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(4)
    a = np.unique(draw.integers(0, 2**63, 400).astype(np.uint64))
    s = near_dups.sketches([a, a[:300], a[:1]])
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.15 and (s != np.uint64(2**64 - 1)).all()


def test_licences(spark, odd_docs, no_docs):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "import os"), ("a/y.py", "text\nLicensed under the Apache License, Version 2.0.\nmore"), ("c/z.py", "no notice"), (None, "MIT License"), ("top.txt", None)]
    got = {r.path: (r.license, r.license_source, r.license_from) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/LICENSE"][:2] == ("MIT", "header") and got["a/b/x.py"] == ("MIT", "directory", "a") and got["a/y.py"][:2] == ("Apache-2.0", "header")
    assert got["c/z.py"] == got["top.txt"] == got[None] == (None, "none", None)
    with_path = odd_docs.withColumn("path", F.col("doc_id").cast("string"))
    assert license_scan.scan(with_path).count() == odd_docs.count() and license_scan.scan(no_docs.withColumn("path", F.lit("x"))).isEmpty()
