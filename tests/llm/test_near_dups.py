"""Near-duplicates at other thresholds."""

import numpy as np
from test_texts import shingles

from tallyspark.llm import near_dups


def least_of_each(sets, percent):
    """The smallest id of each component, over all pairs."""
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return set(root.values())


def test_deduplicated_at_a_percentage(spark):
    draw = np.random.default_rng(3)
    docs = {}
    for i in range(20):
        w = [f"w{i}_{j}" for j in range(200)]
        docs[2 * i] = " ".join(w)
        for j in draw.choice(200, 1 + i % 8, replace=False):
            w[j] = "changed"
        docs[2 * i + 1] = " ".join(w)
    sets = {i: shingles(t) for i, t in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    kept = {p: {r.doc_id for r in near_dups.deduplicated(df, percent=p).collect()} for p in (80, 85)}
    assert kept == {p: least_of_each(sets, p) for p in (80, 85)} and len(kept[80]) < len(kept[85])


def test_texts_under_one_id(spark):
    a = " ".join(f"a{i}" for i in range(30))
    b = " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (5, b.upper()), (7, a), (5, ""), (5, None), (None, a)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in near_dups.deduplicated(df).collect()), key=repr)
    assert got == sorted([(3, b), (5, a), (5, ""), (None, a)], key=repr)


def test_blocks_and_portions(spark, monkeypatch):
    """Many small blocks and portions find the same components as one."""
    monkeypatch.setattr(near_dups, "BLOCK_SETS", 7)
    monkeypatch.setattr(near_dups, "PORTION", 3)
    draw = np.random.default_rng(5)
    docs = {}
    for g in range(3):
        base = [f"g{g}_{j}" for j in range(120)]
        for i in range(40):
            w = list(base)
            for j in draw.choice(120, int(draw.integers(0, 4)), replace=False):
                w[j] = f"v{g}_{i}_{j}"
            docs[1000 * g + i] = " ".join(w)
    sets = {i: shingles(t) for i, t in docs.items()}
    got = near_dups.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4), percent=80)
    assert {r.component_id for r in got.collect()} == least_of_each(sets, 80)


def test_links_across_two_lists():
    draw = np.random.default_rng(6)
    pool = np.unique(draw.integers(0, 2**63, 60).astype(np.uint64))
    sets = [np.sort(draw.choice(pool, int(draw.integers(40, 60)), replace=False)) for _ in range(40)]
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    for right in (None, sets[15:]):
        left = sets if right is None else sets[:15]
        found = near_dups.linked_between(left, right, 80)
        assert all(linked(i, j) for i, j in found)
        pairs = [(i, j) for i in range(40) for j in range(i + 1, 40) if linked(i, j) and (right is None or (i < 15) != (j < 15))]
        root = list(range(40))
        for i, j in found:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
        assert pairs and all(root[i] == root[j] for i, j in pairs)


def test_each_text_is_hashed_once_by_one_worker_a_task(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = near_dups.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
