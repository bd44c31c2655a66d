import collections
import hashlib

import duckdb
import pytest

from graphloom.llm import op07_mixing as O
from tests.llm.common import awkward, docs_of


def fill(sizes, weights, total, most):
    """Clamp, redistribute, until no source is over its cap."""
    clamped = {}
    while True:
        rest = {s: weights[s] for s in sizes if s not in clamped and weights[s] > 0 and sizes[s] > 0}
        left = total - sum(clamped.values())
        over = {s: sizes[s] * most for s, w in rest.items() if left * w / sum(rest.values()) >= sizes[s] * most}
        if not over:
            return clamped | {s: left * w / sum(rest.values()) for s, w in rest.items()}
        clamped |= over


@pytest.mark.parametrize("budget", [0.3, 1.5, 3.9, 50.0])
def test_water_filling_equals_the_iteration(spark, budget):
    sizes = {"a": 1000, "b": 30, "c": 200, "d": 7, "e": 90}
    weights = {"a": 1.0, "b": 2.0, "c": 0.5, "d": 5.0, "e": 0.0}
    docs = spark.createDataFrame([(k, s, "x" * n) for k, (s, n) in enumerate(sizes.items())], "doc_id long, source string, text string")
    got = {r["source"]: r for r in O.water_fill(docs, weights, budget, 4.0).collect()}
    want = fill(sizes, weights, budget * sum(sizes.values()), 4.0)
    for s in sizes:
        assert got[s]["allocated"] == pytest.approx(want.get(s, 0.0))
        assert got[s]["epochs"] == pytest.approx(want.get(s, 0.0) / sizes[s])


def test_repetitions_are_seeded(spark):
    docs = docs_of(spark, [f"text {k} " * (1 + k % 7) for k in range(600)], extra=["copy", "epochs", "weight"])
    epochs = {r["source"]: r["epochs"] for r in O.water_fill(docs, {"src0": 1.0, "src1": 3.0, "src2": 0.2}).collect()}
    out = O.mixed(docs, {"src0": 1.0, "src1": 3.0, "src2": 0.2})
    assert out.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in out.collect())
    for k in range(600):
        e = epochs[f"src{k % 3}"]
        u = int(hashlib.md5(f"17|{k}".encode()).hexdigest()[:8], 16) / 2**32
        assert times[k] == int(e) + (u < e - int(e))


def test_sql(spark, tmp_path):
    docs = docs_of(spark, [f"text {k} é " * (1 + k % 9) for k in range(400)])
    got = sorted(map(tuple, O.mixed(docs.select("doc_id", "source", "text"), copy="copy").collect()))
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got == sorted(con.sql(O.SQL).fetchall())


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = O.mixed(docs)
    assert out.columns == docs.columns
    assert O.mixed(docs.where("false")).count() == 0
    size = {r["source"]: r["epochs"] for r in O.water_fill(docs).collect()}
    assert set(size) == {"a", "b", "c", "", None} and size["a"] == 1.0
    zero = docs.where("doc_id in (1, 2)")
    assert O.mixed(zero).count() == 2
