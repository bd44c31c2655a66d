import random

import numpy as np
import pytest

from graphloom.llm import op06_substring as O
from tests.llm.common import awkward, docs_of


def brute(texts, least):
    """Words of each text that lie in a run of `least` words that occurs twice or more."""
    where = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), []).append((d, k))
    covered = {}
    for places in where.values():
        if len(places) > 1:
            for d, k in places:
                covered.setdefault(d, set()).update(range(k, k + least))
    out = set()
    for d, at in covered.items():
        at = sorted(at)
        begin = at[0]
        for a, b in zip(at, [*at[1:], None]):
            if b != a + 1:
                out.add((d, begin, a + 1))
                begin = b
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passages = [rng.choices(vocab, k=rng.randint(8, 60)) for _ in range(12)]
    texts = []
    for k in range(n):
        w = rng.choices(vocab, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        texts.append(" ".join(w))
    for k in range(15):  # near copies
        w = texts[k].split()
        for _ in range(2):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    return texts + [texts[5], texts[5], "la " * 70, "la " * 45 + "end", " ".join(passages[0] * 3)]


@pytest.mark.parametrize(("seed", "least", "prefix", "memory"), [(1, 12, 5, 10**6), (2, 12, 5, 2), (3, 20, 19, 10**6), (4, 20, 8, 6), (5, 50, 24, 10**6)])
def test_equals_brute_force(spark, seed, least, prefix, memory):
    texts = corpus(seed)
    got = O.repeats(docs_of(spark, texts, extra=["lo", "hi", "leaves"]), least, prefix, memory).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == brute(texts, least)
    assert len(got) == len({(r["doc_id"], r["start_word"]) for r in got})


@pytest.mark.parametrize(("least", "prefix"), [(12, 5), (20, 8)])
def test_leaves_are_counted_at_any_memory(spark, least, prefix):
    texts = corpus(9) + [f"a{k} " + " ".join(f"w{j}" for j in range(30)) + f" z{k}" for k in range(9)]
    own = list(dict.fromkeys(texts))
    count = {}
    for t in own:
        w = t.split()
        for k in range(len(w) - least + 1):
            count[tuple(w[k : k + least])] = count.get(tuple(w[k : k + least]), 0) + 1
    for memory in (10**6, 2, 5):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if memory == 2 else 10000)
        try:
            got = O.repeats(docs_of(spark, texts), least, prefix, memory).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert max(r["leaves"] for r in got) >= 9
        for r in got:
            w = texts[r["doc_id"]].split()
            want = texts.count(texts[r["doc_id"]])
            if want == 1:
                want = max(count[tuple(w[k : k + least])] for k in range(r["start_word"], r["end_word"] - least + 1))
            assert r["leaves"] == want, (memory, r)


def test_partners_share_the_words(spark):
    texts = corpus(7)
    for r in O.repeats(docs_of(spark, texts), 12, 5).collect():
        a, b = texts[r["doc_id"]].split(), texts[r["partner"]].split()
        windows = {tuple(b[k : k + 12]) for k in range(len(b) - 11)}
        assert any(tuple(a[k : k + 12]) in windows for k in range(r["start_word"], r["end_word"] - 11))


def test_small_batches_of_groups(spark, monkeypatch):
    texts = corpus(8)
    monkeypatch.setattr(O._trees, "__defaults__", (7,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for memory in (10**6, 3):
            got = O.repeats(docs_of(spark, texts), 12, 5, memory).collect()
            assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == brute(texts, 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_least_of_windows():
    x = np.random.default_rng(1).integers(0, 100, 60)
    for size in range(1, 20):
        assert O.least_of(x, size).tolist() == [x[k : k + size].min() for k in range(60 - size + 1)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["partner"]) for r in O.repeats(docs).collect()}
    assert got == {(4, 0, 100000, 4)}  # one text that repeats its own words
    got = O.repeats(docs, 5, 3).where("doc_id = 5").collect()
    assert [(r["start_word"], r["end_word"], r["partner"]) for r in got] == [(0, 9, 5)] * 2
    assert O.repeats(docs.where("false")).count() == 0
