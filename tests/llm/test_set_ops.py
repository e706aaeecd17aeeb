"""Joins over the corpus against brute force, with the defined edge cases, and the pipeline."""

import random
import re

import pytest

from canopy.llm import decontaminate, jaccard
from canopy.llm.common import components
from canopy.llm.queries import register

CLASH = "doc_id long, text string, _row long, node long, items string, at int"


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], CLASH)

    return build


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def leaks(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for s in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(item)
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for window, owners in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= owners
        yield doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)


@pytest.mark.parametrize("block", [100_000, 5])
def test_decontamination_equals_brute_force(spark, make, block):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("ab cd ef gh Ée o9 x".split()) for _ in range(n))
    items = [(1, "ab Cd-ef gh"), (2, words(14)), (3, words(25)), (10, "ab cd ef gh"), (4, None), (5, "... !"), (None, "x x ab ab"), (6, "o9"), (7, "zz top"), (2, words(3))]
    docs = [(k, words(60)) for k in range(20)] + [(30, items[1][1] + " AB,cd " + items[2][1]), (31, None), (32, ""), (None, "ab cd ef gh"), (33, "--"), (34, "ab cd ef gh"), (34, "ab cd ef gh"), (35, "x " * 30_000)]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in decontaminate.decontaminate(make(docs), benchmark, block).collect()), key=repr)
    assert got == sorted(leaks(docs, items), key=repr)
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(make(docs), benchmark.limit(0)).collect())
    assert decontaminate.decontaminate(make(docs).limit(0), benchmark).count() == 0


def classes(docs):
    sets = []
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[s : s + 5]) for s in range(max(len(w) - 4, min(len(w), 1)))}))
    label = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[x], label[y]
                label = [new if v == old else v for v in label]
    for (doc, own), mine in zip(sets, label):
        ids = [d for (d, _), v in zip(sets, label) if v == mine and d is not None]
        yield doc, len(own), min(ids) if ids else None


@pytest.mark.parametrize("heavy, group", [(16, 32), (2, 32), (10**9, 2), (3, 2)])
def test_jaccard_join_equals_brute_force(make, monkeypatch, heavy, group):
    """With the usual bounds, with nearly all shingles heavy, with nearly all groups large."""
    monkeypatch.setattr(jaccard, "HEAVY_COUNT", heavy)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", group)
    monkeypatch.setattr(jaccard, "TREE_SETS", 4)
    rng = random.Random(2)
    docs = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "new" + str(rng.randrange(50))
            docs.append((len(docs) * 3 + 7, " ".join(own) + " " * rng.randrange(2)))
    hub = [f"w{k}" for k in range(120)]
    docs += [(1000 + k, " ".join(hub[:k] + [f"e{k}"] + hub[k + 1 :])) for k in range(40)]
    docs += [(500, ""), (501, None), (502, " \t"), (503, "One two"), (504, "one  two"), (None, "one two"), (None, "alone here"), (505, " ".join(hub)), (505, " ".join(hub)), (506, "long " * 20_000), (507, "long " * 30_000)]
    rng.shuffle(docs)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(make(docs)).collect()), key=repr)
    assert got == sorted(classes(docs), key=repr)


def test_shared_passages_chain_nothing_however_many_there_are(make, monkeypatch):
    """Every frequent shingle is last in the order, so texts with own words never meet by a passage."""
    monkeypatch.setattr(jaccard, "HEAVY_SHINGLES", 10, raising=False)  # a bound on their number, as there once was
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(40)]
    docs = [(d, " ".join(f"d{d}w{j}" for j in range(60)) + f" {passages[d % 40]} x{d} {passages[d * 7 % 37]}") for d in range(1600)]
    docs += [(5000, docs[3][1] + " more"), (5001, docs[3][1])]
    met, links = [], jaccard.cluster_links
    monkeypatch.setattr(jaccard, "cluster_links", lambda clusters, texts: met.append(clusters.count()) or links(clusters, texts))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(make(docs)).collect()}
    assert got == {d: 3 if d in (5000, 5001) else d for d, _ in docs}
    assert met == [2]


def test_sets_of_a_cluster_go_only_where_their_length_may_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE_SETS", 4)
    sizes = [10] * 9 + [12] * 6 + [100] * 5 + [1000]
    clusters = spark.createDataFrame([(k, 1, n) for k, n in enumerate(sizes)] + [(99, 2, 7), (98, 2, 500)], "node long, cluster long, n long")
    dealt = {r.node: r for r in jaccard.dealt_sets(clusters).collect()}
    tasks = {node: {tuple(t) for t in r.tasks} for node, r in dealt.items()}
    assert all(len(t) == len(dealt[node].tasks) for node, t in tasks.items())
    assert tasks[99] == tasks[98] == {(0, 0, 0, 0)}  # a small cluster is one task
    for a in range(len(sizes)):
        for b in range(a):
            met = len(tasks[a] & tasks[b])
            if 9 * min(sizes[a], sizes[b]) >= 4 * (sizes[a] + sizes[b]):
                assert met >= 1
            if sizes[a] > 5 * sizes[b]:
                assert met == 0
    assert len(tasks[20]) == 1


def test_jaccard_join_of_nothing(make):
    assert jaccard.near_duplicates(make([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[:3] for r in jaccard.near_duplicates(make([(4, None)])).collect()] == [(4, 0, 4)]


def test_tree_equals_comparison():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for _ in range(40):
        sets = []
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(60) < rng.choice([0.7, 0.9, 0.97, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 6)).astype(np.uint64)])))
        probe = sets[0]
        want = [k for k, s in enumerate(sets) if 9 * len(np.intersect1d(s, probe)) >= 4 * (len(s) + len(probe))]
        assert sorted(jaccard.tree_links(probe, sets)) == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (100, 90)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(links.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, toxic = docs.columns, {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.pinned(stage(spark, docs, folder))
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, kept))
        assert kept.columns == columns and set(after) <= set(before)
        if name == "near_duplicates":
            want = {c for _, _, c in classes(list(before.items()))}
            assert set(after) == want
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(after) == {doc for doc, _, hit, _ in leaks_fast(before, items) if not hit}
        if name == "toxicity":
            gone = set(before) - set(after)
            assert gone and len(gone - toxic) <= len(gone) * 0.7 and len(gone) < 0.3 * len(before)
        if name == "pii":
            assert all(len(before[d]) == len(after[d]) for d in after) and any(before[d] != after[d] for d in after)
        docs = kept
        counts.append(kept.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    import hashlib

    assert {(r.doc_id, r.decoded_sha256) for r in last.collect()} == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert all(a >= b for a, b in zip(counts, counts[1:]))


def leaks_fast(docs, items):
    windows = {tuple(w[s : s + 10]) for _, t in items for w in [words_of(t)] for s in range(max(len(w) - 9, min(len(w), 1)))}
    sizes = {len(w) for w in windows}
    for doc, text in docs.items():
        w = words_of(text)
        yield doc, len(w), any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1)), None


def test_queries_equal_their_twins(spark):
    from compare import check
    from oracle import connect

    from canopy.catalog import Catalog

    catalog = Catalog()
    register(catalog)
    con = connect("/root/testdata/sf0.001")
    for name in catalog.oracle:
        assert check(spark, con, name, catalog, "/root/testdata/sf0.001") is None
