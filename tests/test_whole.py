"""Queries over whole tables: what a subset or a prefix would miss."""

import importlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.operators import graph, retrieve
from graphloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_vector_is_met(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ASKED", 70)
    monkeypatch.setattr(retrieve, "BLOCK", 30)
    x = np.round(np.random.default_rng(3).normal(size=(200, 4)), 1)
    x[50:60] = x[10]
    df = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "id long, v array<double>").repartition(3)
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    score = np.round(unit @ unit.T, 12)
    want = [(q, i, k + 1) for q in range(200) for k, i in enumerate(sorted(range(200), key=lambda i: (-score[q, i], i))[:5])]
    got = retrieve.vector_topk(df.withColumnRenamed("id", "q_id"), df)
    assert sorted((r["q_id"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)
    ids = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    rows = registry.queries()["vector_topk"](spark, SF).groupBy("q_id").count().collect()
    assert {r["q_id"] for r in rows} == ids and all(r["count"] == 5 for r in rows)


def test_few_rows_are_kept_in_between(monkeypatch):
    run = retrieve._nearest(2, most=6)
    x = np.random.default_rng(1).normal(size=(40, 3))
    batch = lambda q, v: pa.RecordBatch.from_pylist([{"qids": np.arange(5).tobytes(), "q": q.tobytes(), "ids": np.arange(k, k + 4).tobytes(), "x": v[k : k + 4].tobytes(), "dim": 3} for k in range(0, 40, 4)])
    (out,) = run(iter([batch(x[:5], x), batch(x[:5][:0], x)][:1]))
    score = np.round(x[:5] @ x.T, 12)
    assert sorted(zip(out["q_id"].to_pylist(), out["id"].to_pylist(), strict=True)) == sorted((q, int(i)) for q in range(5) for i in np.argsort(-score[q])[:2])


def test_second_search_fills_up(spark):
    hits = "q_id long, id long, rank int"
    first = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1), (2, 9, 2), (2, 5, 3)], hits)
    second = spark.createDataFrame([(1, 9, 1), (1, 6, 2), (2, 6, 1)], hits)
    contents = spark.createDataFrame([(5, "e"), (6, "f"), (7, "g"), (8, "g"), (9, "i")], "id long, content string")
    assert sorted(map(tuple, retrieve.merged(first, second, contents).collect())) == [(1, 6, 3), (1, 7, 1), (1, 9, 2), (2, 5, 3), (2, 7, 1), (2, 9, 2)]


def test_texts_of_equal_words_are_scored_once(spark, monkeypatch):
    asked = [(1, ["red", "blue"]), (2, ["blue", "blue"])]
    rows = [(k, f"{'red' if k % 3 else 'blue'} {k}", "blue") for k in range(999, 0, -1)]
    batch = pa.RecordBatch.from_pylist([dict(zip("ido", r, strict=True)) for r in rows])
    want = [(q, i, s) for q, ws in asked for s, i in [(-x, i) for x, i in sorted((-sum(2 * (w in d) + (w in o) for w in ws), i) for i, d, o in rows)[:5]]]
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: calls.append(1) or count(*a))
    (out,) = retrieve._scores(asked, 5)(iter([batch]))
    assert sorted(zip(*(out[c].to_pylist() for c in ("q_id", "id", "score")), strict=True)) == sorted(want) and len(calls) < 10
    monkeypatch.setattr(retrieve, "HELD", 1)
    (out,) = retrieve._scores(asked, 5)(iter([batch]))
    assert sorted(zip(*(out[c].to_pylist() for c in ("q_id", "id", "score")), strict=True)) == sorted(want)


def test_labels_of_every_length_are_found(spark):
    asked = [(1, "abcdefghijkl ABCDEFGX"), (2, "ab"), (3, None), (4, "xabcdefghy")]
    labels = ["", "a", "AB", "abc", "abcdefg", "abcdefgh", "abcdefghi", "bcdefghijkl", "abcdefgX", "abcdefghz", "l a", "Zabc"]
    q = spark.createDataFrame(asked, "q_id long, question string")
    got = {r["q_id"]: r["query"] for r in retrieve.expanded(q, spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, seq long")).collect()}
    assert got == {k: f"{x or ''} " + " ".join(y for y in labels if y.lower() in (x or "").lower()) for k, x in asked}


def agree(spark, *names):
    """Rows of the queries, which equal those of their SQL."""
    duckdb = importlib.import_module("duckdb")
    con, found = duckdb.connect(), {}
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in names:
        df, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
        found[name] = [r.asDict() for r in df.collect()]
        assert sorted(repr(sorted(r.items())) for r in found[name]) == sorted(repr(sorted(zip(want.columns, r, strict=True))) for r in want.fetchall()), name
    return found


def test_edges_of_all_parts(spark):
    got = agree(spark, "edges_resolved", "edges_dangling", "nodes_isolated", "relation_chunk_text")
    parts = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert sum(r["predicate"] == "supplies" for r in got["edges_resolved"]) == parts.count()
    supplied = {f"p_{r[0]}" for r in parts.select("l_partkey").distinct().collect()}
    assert not supplied & {r["id"] for r in got["nodes_isolated"]}
    assert not [r for r in got["edges_dangling"] if r["object_id"] in supplied] and not [r for r in got["relation_chunk_text"] if r["text"].endswith("supplies ")]


def test_dangling_and_isolated_in_a_fixture(spark):
    e = spark.createDataFrame([("a", ["A"], 1), ("b", ["B"], 2), ("c", ["C"], 3)], "id string, label array<string>, seq long")
    t = spark.createDataFrame([("a", "is", "b", 1), ("a", "is", "x", 2), ("y", "is", "z", 3)], "subject_id string, predicate string, object_id string, seq long")
    assert [r["id"] for r in graph.isolated(t, e).collect()] == ["c"]
    assert sorted(map(tuple, graph.dangling(t, e).collect())) == [("a", "is", "x", False, True), ("y", "is", "z", True, True)]
    assert sorted(r["text"] for r in graph.relation_texts(t, graph.entity_index(e)).collect()) == [" is ", "A is ", "A is B"]


def test_dangling_edges_shuffle_distinct_ends_alone(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        e = spark.range(20000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"))
        end = lambda n: F.concat(F.lit("e"), (F.col("id") % n).cast("string"))
        t = spark.range(60000).select(end(20003).alias("subject_id"), F.lit("is").alias("predicate"), F.when(F.col("id") % 20001 > 0, end(20002)).alias("object_id"))
        got = graph.dangling(t, e)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        name = lambda k, n: f"e{k % n}"
        want = [(name(k, 20003), "is", name(k, 20002) if k % 20001 else None, k % 20003 >= 20000, not k % 20001 or k % 20002 >= 20000) for k in range(60000)]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(w) for w in want if w[3] or w[4])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_texts_count_to_their_end(spark):
    got = agree(spark, "option_argmax", "lexical_topk", "lexical_context", "clean_options")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(r["answer"] != "A" for r in got["option_argmax"])
    assert all(len(r["option"]) > 30 for r in got["clean_options"] if len("_".join(docs[r["doc_id"]].split())) > 40)
    asked = {r["item_id"]: [w for w in r["text"].lower().split() if len(w) > 2] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert all(r["score"] == sum(3 * (w in docs[r["id"]].lower()) for w in asked[r["q_id"]]) for r in got["lexical_topk"])
