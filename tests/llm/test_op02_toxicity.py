import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom.llm import op02_toxicity as O
from tests.llm.common import awkward, docs_of

MEAN = ["vile", "scum", "worthless", "hateful", "idiot"]


def corpus(rng, n=400):
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    texts, toxic = [], []
    for k in range(n):
        w = rng.choices(vocab, k=rng.randint(20, 120))
        bad = k % 5 == 0
        if bad:
            for _ in range(len(w) // 6 + 2):
                w[rng.randrange(len(w))] = rng.choice(MEAN)
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


WORD = re.compile(r"[0-9A-Za-z_\u00c0-\u1fff\u2070-\u2fff\u3040-\U0010ffff]+")


def index_of(texts, toxic):
    words, counts, edge = O.counted(pa.array(texts))
    examples = [O.Example(k, y, words[a:b], counts[a:b]) for k, (y, a, b) in enumerate(zip(toxic, edge[:-1], edge[1:], strict=True))]
    known = O.vocabulary(examples)
    df = np.bincount(np.searchsorted(known, words), minlength=len(known))
    return O.build(examples, list(range(len(texts))), known, df, len(texts))


def dense_nearest(index, texts):
    """Cosines of a text with all others over every word, without the index's lists: only the factor of each word is looked up in it."""
    tf = [Counter(WORD.findall(t.lower())) for t in texts]
    df = Counter(w for c in tf for w in c)
    at = {w: int(np.searchsorted(index.words, O.counted(pa.array([w]))[0][0])) for w in df}
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    factor = {w: round(float(index.gain[at[w]]) / idf[w], 3) for w in df}
    assert set(factor.values()) <= set(O.OTHERS) | {1.0}
    vec = lambda c: {w: (1 + math.log(n)) * idf[w] * factor[w] for w, n in c.items() if w in idf}
    size = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
    all_ = [(k, v, size(v)) for k, v in enumerate(map(vec, tf))]

    def nearest(asked):
        q = vec(Counter(WORD.findall(asked.lower())))
        sims = [(sum(x * v.get(w, 0) for w, x in q.items()) / size(q) / n, k) for k, v, n in all_]
        return sorted(((s, k) for s, k in sims if s > 1e-9), key=lambda p: -p[0])

    return nearest


def test_nearest_is_exact_cosine_over_all_words():
    texts, toxic = corpus(random.Random(1))
    texts = [f"{t} rare{k % 37} only{k}" for k, t in enumerate(texts)]  # words of few examples beside those of many
    texts = [*texts, "", "caf\u00e9 \u201cna\u00efve\u201d \u65e5\u672c\u8a9e", texts[3], texts[3] + " scum"]
    index = index_of(texts, [*toxic, 0, 0, toxic[3], 1])
    assert len(index.block_max) > 5 and len(index.dense) > 10 and len(index.example) > 400
    dense = dense_nearest(index, texts)
    asked = [*texts[:40], *texts[-4:], "vile scum", "vile", "nothing here", "", "vile vile idiot " + texts[3], " ".join(texts[:50])]
    for text, (_, sims, found) in zip(asked, index.judged(pa.array(asked)), strict=True):
        want = dense(text)
        assert np.allclose(sims, [s for s, _ in want[: O.K]], atol=1e-5), text
        least = sims[-1] if len(sims) else 1
        assert {k for s, k in want if s > least + 1e-5} <= set(index.ids[found]) <= {k for s, k in want if s > least - 1e-5}


def test_a_copy_of_an_unlikely_example_finds_it():
    texts, toxic = corpus(random.Random(4))
    index = index_of(texts, toxic)
    for k in (0, 7, 123):
        _, sims, found = index.judge(texts[k])
        assert index.ids[found[0]] == k and abs(sims[0] - 1) < 1e-5 and sims[1] < 0.999


def test_words():
    w, n, edge = O.counted(pa.array(["B\u00e9 b\u00e9, a_1 \u00abx\u00bb\u2026x", "", None, "x"]))
    assert list(np.diff(edge)) == [3, 0, 0, 1] and sorted(n[:3]) == [1, 2, 2] and w[-1] in w[:3]


def test_isotonic_never_falls():
    x, y = np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1])
    steps, levels = O.isotonic(x, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(steps) >= 0).all() and abs(np.interp(x, steps, levels).sum() - y.sum()) < 1e-9


def test_held_out_accuracy_and_drop(spark):
    texts, toxic = corpus(random.Random(2), 900)
    docs = docs_of(spark, texts, extra=["label", "score", "toxic"])
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic) if k < 500] + [(None, 1, 1), (3, None, None), (4, 1, 7)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in O.toxicity(docs, labels).collect()}
    assert len(rows) == len(texts)
    wrong = [k for k in range(500, 900) if rows[k]["toxic"] != bool(toxic[k])]
    assert len(wrong) <= 8
    assert all(len(r["evidence"]) <= O.K for r in rows.values())
    kept = O.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if not r["toxic"]}


def test_awkward_rows(spark):
    texts, toxic = corpus(random.Random(3), 200)
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = O.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(r["score"] is None and not r["toxic"] for r in out)
    assert O.drop_toxic(docs, labels.where("false")).count() == docs.count()
    base = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    both = base.unionByName(docs.select(base.columns).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    out = O.toxicity(both, labels).where("doc_id is null or doc_id >= 1000").collect()
    assert len(out) == docs.count() and not any(r["toxic"] for r in out) and all(r["score"] is not None for r in out)
    assert O.toxicity(docs.where("false"), labels).count() == 0
