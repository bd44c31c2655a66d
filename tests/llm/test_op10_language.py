import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import op10_language as O
from tests.llm.common import awkward, docs_of

PARTS = {"en": "th er ing the and on of".split(), "fr": "eau ou é è aux le que".split(), "de": "sch ung ü ei zu der ß".split(), "es": "ción ar os ñ el que ado".split()}


def texts(rng, n):
    out = []
    for _ in range(n):
        lang = rng.choice(list(PARTS))
        out.append((lang, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60)))))
    return out


@pytest.mark.parametrize("languages", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(languages):
    code = O.codewords(languages)
    near = min(int((code[a] != code[b]).sum()) for a in range(languages) for b in range(a))
    assert near >= (1 if languages == 2 else 2 if languages < 4 else 4) and (np.abs(code.sum(0)) < languages).all()


def test_margins_equal_counting():
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(2 * O.WIDTH, 3)), rng.normal(size=3)
    data, starts = O.S.bytes_of(pa.array(["hello there", "ab", "", "é日本 naïve text", "xyz" * 5000]))
    got, ok = O.margins(data, starts, w, b)
    assert ok.tolist() == [True, False, False, True, True]
    assert np.allclose(got[ok], (O.shares(data, starts).astype(float) @ w + b)[ok], atol=1e-4)


def test_decoding_is_the_nearest_by_weighted_loss():
    d = O.Decoder(list("abcd"), O.codewords(4), np.zeros((1, 7)), np.zeros(7), np.arange(1.0, 8.0))
    m = np.random.default_rng(2).normal(size=(50, 7))
    best, loss, gap = d.decide(m)
    for k in range(50):
        each = sorted((sum(w * np.log1p(np.exp(-c * v)) for w, c, v in zip(d.trust, code, m[k])) / d.trust.sum(), n) for n, code in enumerate(d.code))
        assert best[k] == each[0][1] and np.isclose(loss[k], each[0][0]) and np.isclose(gap[k], each[1][0] - each[0][0])


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = texts(rng, 900)
    docs = spark.createDataFrame([(k, t, lang if k < 500 else None) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr("*", "'x' as language", "1 as rn")
    got = {r["doc_id"]: r for r in O.language(docs).collect()}
    assert len(got) == 900
    sure = [k for k in range(500, 900) if not got[k]["ambiguous"]]
    assert np.mean([got[k]["language"] == rows[k][0] for k in sure]) >= 0.99 and len(sure) >= 320


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = O.language(docs).collect()
    assert len(out) == docs.count() and all(r["language"] is None and r["ambiguous"] for r in out)
    more = docs_of(spark, [t for _, t in texts(random.Random(4), 80)]).selectExpr("doc_id + 100 as doc_id", "text", "case when doc_id % 2 = 0 then 'aa' else 'bb' end as lang", "source", "n_chars")
    out = O.language(docs.select(more.columns).union(more)).where("doc_id < 100 or doc_id is null").collect()
    assert len(out) == docs.count() and {r["doc_id"] for r in out if r["language"] is None} == {1, 2}
    assert O.language(docs.where("false")).count() == 0
