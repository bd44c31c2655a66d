import collections
import random

import numpy as np
import pytest

from graphloom.llm import op05_simhash as O
from tests.llm.common import awkward, docs_of


def brute(fp, budget):
    return {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(np.bitwise_count(fp[i] ^ fp[j]).sum()) <= budget}


def family(seed, n=40, each=5, most=60):
    rng = np.random.default_rng(seed)
    fp = np.repeat(rng.integers(0, 2**63, (n, 4), dtype=np.uint64), each, axis=0)
    for r in range(len(fp)):
        for b in rng.choice(256, rng.integers(0, most), replace=False):
            fp[r, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.unique(fp, axis=0)


def pairs(found):
    found = list(found)
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
    return list(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))


@pytest.mark.parametrize(("leaf", "levels", "errors"), [(1, 16, 3), (4, 12, 2), (8, 12, 12), (8, 60, 9), (1, 4, 1)])
def test_trie_join_is_exact_within_its_budgets(leaf, levels, errors):
    fp = family(3)
    word = (fp[:, 0] >> np.uint64(64 - levels)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    fp, word = fp[order], word[order]
    seen = O.Counter()
    got = pairs(O.trie_join(fp, word, np.zeros(len(fp), np.int64), 42, levels, errors, leaf, seen))
    want = {(i, j) for i, j in brute(fp, 42) if bin(int(word[i] ^ word[j])).count("1") <= errors}
    assert want and set(got) == want and len(got) == len(want)
    assert (seen["pruned"] > 0) == (errors < 9)


def test_trie_prunes_most_node_pairs_of_unlike_fingerprints():
    fp = np.random.default_rng(1).integers(0, 2**63, (4096, 4), dtype=np.uint64)
    word = np.sort((fp[:, 0] % 4096).astype(np.int64))
    seen = O.Counter()
    list(O.trie_join(fp, word, np.zeros(len(fp), np.int64), seen=seen))
    assert seen["pruned"] > 0.3 * seen["visited"] and seen["visited"] < (4096 / O.LEAF) ** 2 / 3


def test_roots_keep_apart():
    fp = np.zeros((4, 4), np.uint64)
    assert sorted(pairs(O.trie_join(fp, np.zeros(4, np.int64), np.array([1, 1, 2, 2]), 0, leaf=1))) == [(0, 1), (2, 3)]


def found_by_rule(fp, width, tables, budget):
    """Of all pairs within the budget those that some table finds, from the two rules alone."""
    bits = O._bits(fp)
    out = set()
    for where in O.samples(width, tables):
        key, level = bits[:, where[:width]], bits[:, where[width:]]
        out |= {(i, j) for i, j in brute(fp, budget) if (key[i] == key[j]).all() and (level[i] != level[j]).sum() <= O.ERRORS}
    return out


@pytest.mark.parametrize("hot", [10**6, 9])
def test_edges_and_links_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(O, "BUCKET", 64)
    monkeypatch.setattr(O, "HOT", hot)
    fp = family(7, 60, 6, 40)
    near = brute(fp, O.BUDGET)
    rows = [(1000 + k, *map(int, f)) for k, f in enumerate(fp.view(np.int64))]
    frame = spark.createDataFrame(rows, f"{O.ID} long, " + ", ".join(f"{c} long" for c in O.FP)).repartition(3)
    found = O.near_edges(frame, len(fp)).collect()
    want = found_by_rule(fp, *O.layout(len(fp)), O.BUDGET)
    assert len(want) > 100 and len(want) >= 0.95 * len(near)
    links = collections.Counter()
    for r in found:
        links[r["u"] - 1000] += r["links"]
    assert +links == collections.Counter(k for p in want for k in p)
    up = union_find(range(len(fp)), [(r["u"] - 1000, r["v"] - 1000) for r in found if not r["links"]])
    assert up == union_find(range(len(fp)), want)


def far_apart_family(seed, n=30, each=4):
    """Fingerprints whose pairs differ in BUDGET bits exactly, or in one more, spread evenly: what bit samples find least."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        base = rng.integers(0, 2**63, 4, dtype=np.uint64)
        out.append(base)
        for e in range(each):
            fp = base.copy()
            for b in rng.choice(256, O.BUDGET + e % 2, replace=False):
                fp[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            out.append(fp)
    return np.unique(np.array(out), axis=0)


@pytest.mark.parametrize(("hot", "budget"), [(10**6, O.BUDGET), (600, O.BUDGET), (40, O.BUDGET), (10**6, 10), (10**6, 60)])
def test_no_pair_within_the_budget_is_lost(spark, monkeypatch, hot, budget):
    """All pairs by brute force, though many of them differ in the whole budget; chunks of all sizes, and other budgets."""
    monkeypatch.setattr(O, "HOT", hot)
    fp = np.concatenate([far_apart_family(3, 300 if hot >= 600 and budget == O.BUDGET else 30), family(5, 20, 5, 40), np.random.default_rng(2).integers(0, 2**63, (200, 4), dtype=np.uint64)])
    near = brute(fp, budget)
    assert len(near) > (10 if budget < O.BUDGET else 100)
    rows = [(1000 + k, *map(int, f)) for k, f in enumerate(fp.view(np.int64))]
    found = O.near_edges(spark.createDataFrame(rows, f"{O.ID} long, " + ", ".join(f"{c} long" for c in O.FP)).repartition(3), len(fp), budget).collect()
    links = collections.Counter()
    for r in found:
        links[r["u"] - 1000] += r["links"]
    assert +links == collections.Counter(k for p in near for k in p)
    assert union_find(range(len(fp)), [(r["u"] - 1000, r["v"] - 1000) for r in found if not r["links"]]) == union_find(range(len(fp)), near)


def test_several_pairs_of_chunks_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(O, "MOST_TASKS", 3)
    test_no_pair_within_the_budget_is_lost(spark, monkeypatch, 40, O.BUDGET)


def union_find(nodes, edges):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_forest():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(1, 60)
        ids = rng.sample(range(1000), n)
        e = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 50))]
        forest = O.Forest(np.array(ids))
        for piece in (e[:7], e[7:]):
            forest.add(np.array([a for a, _ in piece], int), np.array([b for _, b in piece], int))
        got = forest.roots()
        want = union_find(ids, [(ids[a], ids[b]) for a, b in e])
        assert {ids[k]: ids[int(got[k])] for k in range(n)} == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in O.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v}


def corpus(rng, n=300):
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(40, 300))) for _ in range(n)]
    for k in range(60):
        w = texts[k].split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    return texts + [texts[0]] * 5


def test_recall_against_brute_force_and_clean_documents_alone(spark):
    texts = corpus(random.Random(11))
    rows = O.near_duplicates(docs_of(spark, texts)).collect()
    group = {r["doc_id"]: r["group_id"] for r in rows}
    caught = sum(group.get(k, -1) == group.get(300 + k, -2) for k in range(60))
    assert caught >= 57
    assert {group[k] for k in (0, 300, 360, 361, 364)} == {0}
    assert not set(group) & set(range(60, 300))
    sizes = collections.Counter(group.values())
    assert all(r["group_size"] == sizes[r["group_id"]] for r in rows)
    assert sum(r["keep"] for r in rows) == len(sizes)


def test_whole_query_equals_brute_force(spark):
    texts = [t.upper() if k % 7 == 0 else t for k, t in enumerate(corpus(random.Random(13), 120))]
    data, starts = O.S.bytes_of(O.pa.array([t.lower() for t in texts]))
    fp = O.fingerprints(data, starts)[0]
    first = {}
    of = [first.setdefault(tuple(f), k) for k, f in enumerate(fp.tolist())]
    near = brute(fp, O.BUDGET)  # so few texts share one bucket, where only the trie's budget can lose a pair
    group = union_find(range(len(texts)), near)
    size = collections.Counter(group.values())
    want = [(k, group[k], size[group[k]], len({of[j] for p in near for j in p if k in p} - {of[k]}), group[k] == k) for k in range(len(texts)) if size[group[k]] > 1]
    assert sorted(map(tuple, O.near_duplicates(docs_of(spark, texts)).collect())) == want


def test_drop_keeps_one_of_each_group(spark):
    texts = corpus(random.Random(12), 80)
    docs = docs_of(spark, texts, extra=["group_id", "keep", "rn"])
    out = O.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    gone = {r["doc_id"] for r in O.near_duplicates(docs).where("not keep").collect()}
    assert kept == set(range(len(texts))) - gone


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert [(r["doc_id"], r["group_size"], r["keep"]) for r in O.near_duplicates(docs).orderBy("keep").collect()] == [(5, 2, False), (5, 2, True)]
    out = O.drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == docs.count() - 1
    empty = docs.where("false")
    assert O.near_duplicates(empty).count() == 0 and O.drop_near_duplicates(empty).count() == 0
