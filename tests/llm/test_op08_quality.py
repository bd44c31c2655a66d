import random

import numpy as np
import pyarrow as pa

from graphloom.llm import op08_quality as O
from tests.llm.common import awkward, docs_of


def corpus(rng, n=600):
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts, good = [], []
    for k in range(n):
        w = rng.choices(vocab, k=rng.randint(15, 300))
        kind = k % 24
        if kind == 0:
            w = [x + rng.choice(["###", "%%%", "$$$"]) for x in w]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        elif kind == 2:
            w = [x for x in w[:20] for _ in range(15)]
        elif kind == 3:
            w = " | ".join(w).split()
        texts.append(" ".join(w))
        good.append(kind > 3)
    return texts, good


def slow_path(f, t, x):
    node = 0
    while f.feature[t, node] >= 0:
        node = f.left[t, node] + (x[f.feature[t, node]] >= f.split[t, node])
    return f.length[t, node]


def test_scores_equal_the_walk_tree_by_tree():
    x = np.random.default_rng(1).normal(size=(400, 4))
    f = O.grow(x, trees=20, group=64)
    want = [2 ** (-np.mean([slow_path(f, t, r) for t in range(20)]) / float(O.expected(64))) for r in x[:50]]
    assert np.allclose(f.score(x[:50]), want)
    assert f.score(np.full((1, 4), 9.0))[0] > f.score(x).max() - 0.05


def test_statistics():
    t = ["a a a b|c\na a a b|c\n", "", "UP up!! 12 #x"]
    x, n = O.statistics(*O.S.bytes_of(pa.array(t)))
    assert n.tolist() == [8, 0, 4]
    low = n + O.SHRINK
    assert x[0].tolist() == [0, 2 / low[0], 0, 0, 4 / low[0], 6 / low[0], 4 / low[0]]
    assert not x[1].any() and x[2, 0] == 1 / low[2] and x[2, 2] == 2 / low[2]


def test_held_out_accuracy(spark):
    texts, good = corpus(random.Random(4), 1500)
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good) if k < 900], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in O.quality(docs_of(spark, texts, extra=["score", "keep"]), labels).collect()}
    kept_good = np.mean([rows[k]["keep"] for k in range(900, 1500) if good[k]])
    caught = np.mean([not rows[k]["keep"] for k in range(900, 1500) if not good[k]])
    assert kept_good >= 0.98 and caught >= 0.85


def plain_threshold(score, good):
    best, at = -1.0, np.inf
    for cut in np.unique(score):
        hit, wrong = ((score >= cut) & ~good).sum(), ((score >= cut) & good).sum()
        if wrong <= O.FALSE_ALARM * good.sum() and (f1 := 2 * hit / (hit + wrong + (~good).sum())) > best:
            best, at = f1, float(cut)
    return at


def test_threshold_equals_trying_every_cut(spark):
    rng = np.random.default_rng(8)
    for n, steps in ((3000, 10**6), (3000, 40), (5, 3), (0, 1)):
        good = rng.random(n) < 0.9
        score = np.round(np.where(good, rng.normal(0.4, 0.04, n), rng.normal(0.5, 0.05, n)) * steps) / steps
        frame = spark.createDataFrame(list(zip(score.tolist(), good.astype(int).tolist(), strict=True)), "score double, label int")
        assert O.threshold(frame) == plain_threshold(score, good)


def test_every_labelled_row_takes_part(spark):
    """12,000 labelled rows, whose bad ones are none of the 10,000 that come first by the hash of the sample that was once taken."""
    n, rng = 12000, random.Random(3)
    late = spark.range(n).selectExpr("cast(id as long) id").orderBy(O.F.xxhash64("id", O.F.lit(17))).toArrow().column(0).to_pylist()[10000:]
    bad = set(late[:120])
    texts = [" ".join(f"w{rng.randrange(900)}{'###' if k in bad else ''}" for _ in range(20)) for k in range(n)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(k, int(k not in bad), 0) for k in range(n)], "doc_id long, quality int, toxic int")
    rows = O.numbered(O.measured(docs), labels).orderBy("at").toArrow()
    assert rows.column("at").to_pylist() == list(range(n)) and sum(rows.column("label").to_pylist()) == n - 120
    out = O.quality(docs, labels).collect()
    assert all(r["score"] is not None for r in out)
    forest = O.fit(O.numbered(O.measured(docs), labels))
    score, good = forest.score(O._matrix(rows)), rows.column("label").to_numpy() == 1
    assert forest.threshold == plain_threshold(score, good)
    assert sum(not r["keep"] for r in out if r["doc_id"] in bad) >= 60 and sum(not r["keep"] for r in out if r["doc_id"] not in bad) <= 60


def test_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, 9, 0)], "doc_id long, quality int, toxic int")
    out = O.quality(docs, none).collect()
    assert len(out) == docs.count() and all(r["score"] is None for r in out)
    assert sorted(str(r["doc_id"]) for r in out if r["empty"]) == ["1", "2", "7"] and all(r["keep"] != r["empty"] for r in out)
    assert O.quality(docs.where("false"), none).count() == 0 and O.quality(docs, none.where("false")).count() == docs.count()
