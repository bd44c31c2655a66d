import duckdb
import numpy as np
import pytest

from graphloom.llm import op09_ego as O


def vectors(seed, n=500, dim=16, copies=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.linspace(2, 0.5, dim)
    near = x[rng.integers(0, n, copies)] + rng.normal(size=(copies, dim)) * 0.12
    return np.vstack([x, near]).astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + list(extra), "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as no", "2 as lo", "'x' as ids")


def classes_of(x):
    first = {}
    return [first.setdefault(tuple(map(float, v)), k) for k, v in enumerate(x)]


@pytest.mark.parametrize(("seed", "cosine", "interval", "group"), [(1, 0.95, 64, 8), (2, 0.8, 100, 2), (3, 0.99, 1024, 8), (4, 0.9, 7, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, cosine, interval, group):
    monkeypatch.setattr(O, "GROUP", group)
    x = vectors(seed)
    x = np.vstack([x, x[5:6].repeat(40, 0), x[9:12]])
    of, u = classes_of(x), O.unit(x.astype(float))
    g = u @ u.T
    want = {(of[i], of[j]) for i, j in zip(*np.nonzero(np.triu(g >= cosine, 1)), strict=True) if of[i] != of[j]}
    want = {(min(p), max(p)) for p in want}
    got = O.near_pairs(frame(spark, x), cosine, interval=interval).collect()
    assert want and {(r["vec_id_a"], r["vec_id_b"]) for r in got} == want and len(got) == len(want)
    rows = O.linked(frame(spark, x), cosine, interval=interval).collect()
    assert sorted(map(tuple, rows)) == [(k, of[k], of.count(of[k]), sum(of[k] in p for p in want)) for k in range(len(x))]


def test_double_precision_vectors(spark):
    x = vectors(7).astype(float) + 1e-9
    u = O.unit(x)
    got = O.near_pairs(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.count() == np.triu(u @ u.T >= O.COSINE, 1).sum()


def test_sql(spark, tmp_path):
    f = frame(spark, np.vstack([vectors(5), vectors(5)[3:9]]), [(3, [float(v) for v in vectors(5)[3]], 1)])
    f.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = con.sql(O.SQL)
    assert want.columns == O.linked(f).columns
    assert sum(r[3] for r in want.fetchall()) > 10 and sorted(map(tuple, O.linked(f).collect())) == sorted(con.sql(O.SQL).fetchall())


def test_recursive_join_skips_far_blocks_and_loses_nothing():
    x = O.unit(vectors(6, 800, 4).astype(float))
    x = x[np.lexsort(np.floor(x / 0.3).T[::-1])]
    i, j = O.join(x, x, 0.3, 4, True, leaf=8)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(d <= 0.3, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(int(a), int(b)) for a, b in want}
    y = x[::3] * 1.0
    i, j = O.join(x, y, 0.3, 4, False, leaf=8)
    assert len(i) == (np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) <= 0.3).sum()


def test_awkward_rows(spark):
    odd = [(None, [1.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (10, [1.0, 1.0], None), (11, [2.0, 2.0], None), (11, [2.0, 2.0], None), (12, [-1.0, 1.0], 1)]
    f = spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")
    assert [(r["vec_id_a"], r["vec_id_b"], r["cosine"]) for r in O.near_pairs(f).collect()] == [(10, 11, 1.0)]
    assert sorted(map(tuple, O.linked(f).collect())) == [(10, 10, 1, 1), (11, 11, 1, 1), (12, 12, 1, 0)]
    assert O.linked(f.where("false")).count() == 0 and O.linked(f.where("vec_id = 10")).count() == 1
    assert O.near_pairs(f.where("false")).count() == 0
    assert O.near_pairs(f.where("vec_id = 10")).count() == 0
