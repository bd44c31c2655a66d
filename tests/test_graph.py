import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate, graph, ingest, retrieve
from graphloom.sources import files, sinks
from graphloom.streaming import incremental

#: A large graph to read, for those who have one: its path, and how many entities and triplets it has.
GOLDEN, SIZES = Path(os.environ.get("GRAPHLOOM_TURTLE", "/none")), os.environ.get("GRAPHLOOM_TURTLE_SIZES", "0 0")
E = "id string, label array<string>, type string, description string, original_text string, properties map<string,string>, metadata map<string,string>, seq long"
TR = "subject_id string, predicate string, object_id string, properties map<string,string>, metadata map<string,string>, seq long"


def entities(spark):
    rows = [
        ("a", ["A", "Alpha"], "T1", "short", "one", {"k": "1", "l": "1"}, {}, 1),
        ("a", ["Alpha", "Al"], "T2", "longer text", "one two", {"k": "2"}, None, 3),
        ("a", None, "T3", "same length", " one ", None, {"m": "x"}, 2),
        ("b", ["B", "a"], None, None, None, None, None, 4),
    ]
    return spark.createDataFrame(rows, E).repartition(3)


def triplets(spark):
    rows = [("a", "is", "b", {"p": "2"}, None, 2), ("a", "is", "b", {"p": "1"}, None, 1), ("a", "is", "zz", None, None, 3), ("b", "of it", "a", None, None, 4)]
    return spark.createDataFrame(rows, TR)


def test_merge_folds_in_order(spark):
    got = {r["id"]: r for r in graph.merge_entities(entities(spark)).collect()}
    a = got["a"]
    assert (a["label"], a["type"], a["description"], a["original_text"]) == (["A", "Alpha", "Al"], "T1", "same length", "one\n\none two")
    assert (a["properties"], a["metadata"]) == ({"k": "2", "l": "1"}, {"m": "x"})
    assert (got["b"]["type"], got["b"]["description"], got["b"]["original_text"]) == (None, "", "")


def test_merge_twice_changes_nothing(spark):
    once = graph.merge_entities(entities(spark))
    assert sorted(map(repr, once.collect())) == sorted(map(repr, graph.merge_entities(once).collect()))


def test_triplets(spark):
    t = graph.dedup_triplets(triplets(spark))
    assert {r["seq"] for r in t.collect()} == {1, 3, 4}
    e = graph.merge_entities(entities(spark))
    assert graph.resolved(t, e).count() == 2
    assert [tuple(r) for r in graph.dangling(t, e).collect()] == [("a", "is", "zz", False, True)]
    assert graph.isolated(t.where("seq = 3"), e).select("id").collect()[0]["id"] == "b"
    index = graph.entity_index(e)
    assert {r["key"]: r["entity_id"] for r in index.collect()} == {"a": "b", "alpha": "a", "al": "a", "b": "b"}
    assert {r["text"] for r in graph.relation_texts(t, index).collect()} == {"B is B", "B is ", "B of it B"}


def test_files_round_trip(spark, tmp_path):
    g = graph.KnowledgeGraph(graph.merge_entities(entities(spark)), graph.dedup_triplets(triplets(spark)))
    sinks.graph_json(g, f"{tmp_path}/kg")
    back = files.graph_json(spark, f"{tmp_path}/kg")
    assert {r["id"]: (r["label"], r["properties"]) for r in back.entities.collect()} == {r["id"]: (r["label"], r["properties"]) for r in g.entities.collect()}
    assert back.triplets.count() == 3
    none = files.graph_json(spark, f"{tmp_path}/none", strict=False)
    assert none.entities.count() == none.triplets.count() == 0
    sinks.turtle(g, f"{tmp_path}/ttl")
    back = files.turtle(spark, f"{tmp_path}/ttl")
    assert sorted((r["id"], r["type"], r["description"]) for r in back.entities.collect()) == [("a", "T1", "same length"), ("b", "", "")]
    assert back.triplets.count() == 3
    sinks.property_graph(g, f"{tmp_path}/pg")
    assert spark.read.parquet(f"{tmp_path}/pg/edges").select("rel_type").distinct().count() == 2
    odd = graph.KnowledgeGraph(g.entities.union(spark.createDataFrame([(None, ["x"], None, None, None, None, None, 9)], E)), g.triplets.union(spark.createDataFrame([("a", None, "b", None, None, 9)], TR)))
    sinks.property_graph(odd, f"{tmp_path}/odd")
    assert sorted(r["kind"] for r in spark.read.parquet(f"{tmp_path}/odd/rejected").collect()) == ["edge", "node"]
    assert sorted(r["name"] for r in spark.read.parquet(f"{tmp_path}/odd/nodes").collect()) == ["a", "b"]


def test_node_properties(spark):
    df = spark.range(1).select(F.create_map(F.lit("a b"), F.lit("1"), F.lit("a-b"), F.lit("2"), F.lit("?"), F.lit("3"), F.lit("c"), F.lit("4")).alias("m"))
    assert df.select(graph.node_properties(F.col("m")).alias("p")).first()["p"] == {"a_b": "2", "c": "4"}


def test_lexical_scores_equal_a_loop(spark):
    docs = [(1, "Red fox", "the red fox runs"), (2, "blue", "a red sky redder"), (3, None, None), (4, "fox", "nothing"), (5, "x", "red red")]
    asked = [(7, "red fox RED"), (8, "a b"), (9, "runs sky")]
    want = []
    for q, text in asked:
        score = [(sum(2 * (w in (d or "").lower()) + (w in (o or "").lower()) for w in text.lower().split() if len(w) > 2), i) for i, d, o in docs]
        top = sorted(((-s, i) for s, i in score if s))[:2]
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(top)]
    d = spark.createDataFrame(docs, "id long, description string, original_text string").repartition(3)
    q = spark.createDataFrame(asked, "q_id long, question string")
    got = retrieve.lexical_topk(q, d, 2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    contexts = {r["q_id"]: r["context"] for r in retrieve.lexical_context(got, d, q).collect()}
    assert contexts[8] == retrieve.T.NOTHING_FOUND and contexts[7].startswith("the red fox runs\n\n")


def test_vector_topk(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>").repartition(3)
    got = retrieve.vector_topk(v.where("id = 1").withColumnRenamed("id", "q_id"), v, 3).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    odd = spark.createDataFrame([(5, None), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 0.0])], "id long, v array<double>")
    asked = v.union(odd).where("id in (1, 5, 7)").withColumnRenamed("id", "q_id")
    got = retrieve.vector_topk(asked, v.union(odd), 2)
    assert sorted((r["q_id"], r["id"]) for r in got.collect()) == [(1, 1), (1, 3), (7, 7)]
    assert retrieve.vector_topk(asked.where("false"), v).count() == 0 and retrieve.vector_topk(asked, v.where("false")).count() == 0


def test_lexical_awkward(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "Red fox"), (2, "", "Red fox")], "id long, description string, original_text string")
    q = spark.createDataFrame([(1, None), (2, ""), (3, "fox")], "q_id long, question string")
    assert sorted(map(tuple, retrieve.lexical_topk(q, d).collect())) == [(3, 2, 1, 1), (3, 2, 1, 2)]
    assert retrieve.lexical_topk(q.where("false"), d).count() == retrieve.lexical_topk(q, d.where("false")).count() == 0


def test_expansion_equals_a_loop(spark):
    labels = ["Hà Nội", "hà", "nội thất", "", "x", "Nội", "ội l", None, "hà"]
    asked = ["Thủ đô Hà Nội là gì", "x", "", None, "nội"]
    got = {r["q_id"]: r["query"] for r in retrieve.expanded(spark.createDataFrame(list(enumerate(asked)), "q_id long, question string"), spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, seq long")).collect()}
    assert got == {k: (q or "") + " " + " ".join(x for x in labels if x is not None and x.lower() in (q or "").lower()) for k, q in enumerate(asked)}


def test_grading(spark):
    rows = spark.createDataFrame([(k, "mc", p, c) for k, (p, c) in enumerate([("A", "A"), ("B", "A"), (None, "A"), ("", "B"), ("B", "B"), ("A", None)])], "id long, q_type string, predicted string, correct string")
    r = evaluate.graded(rows)
    assert [x["status"] for x in r.orderBy("id").collect()] == ["correct", "wrong", "no-answer", "no-answer", "correct", "wrong"]
    s = {x["q_type"]: x for x in evaluate.statistics(r).collect()}
    assert (s["overall"]["total"], s["mc"]["correct"], s["mc"]["wrong"], s["mc"]["no_prediction"]) == (6, 2, 2, 2)


def test_parse_and_salvage(spark):
    good = '```json\n{"entities": [{"id": "x", "type": "T", "description": "d", "extra": 1}], "triplets": [{"subject_id": "x", "predicate": "p", "object_id": "y"}, {"subject_id": "x"}],}\n```'
    cut = '{"entities": [{"id": "y", "type": "T", "description": "d"}], "triplets": [{"subject_id": "q", "pred'
    rows = spark.createDataFrame([(1, good), (2, cut + "}"), (3, "no json"), (4, ""), (5, None)], "id long, response string")
    got = {r["id"]: r for r in ingest.parsed(rows).collect()}
    assert got[1]["ok"] and got[1]["entities"][0]["label"] == ["x"] and got[1]["entities"][0]["original_text"] == "d" and len(got[1]["triplets"]) == 1
    assert got[2]["ok"] and [e["id"] for e in got[2]["entities"]] == ["y"]
    assert not got[3]["ok"] and not got[4]["ok"]


def capitals(chunks):
    one = F.concat(F.lit('{"entities": [{"id": "'), F.lower(F.regexp_extract("text", r"(\w+)", 1)), F.lit('", "type": "W", "description": "'), F.length("text").cast("string"), F.lit('"}], "triplets": []}'))
    return chunks.select("id", one.alias("response"))


def test_single_labels_and_attempts(spark):
    one = lambda label: f'{{"entities": [{{"id": "x", "type": "T", "description": "d"{label}}}], "triplets": []}}'
    rows = spark.createDataFrame([(1, one(', "label": "Lab"')), (2, one(', "label": ["a", "b"]')), (3, one(', "label": []')), (4, one("")), (5, one(', "label": 7'))], "id long, response string")
    assert {r["id"]: r["entities"][0]["label"] for r in ingest.parsed(rows).collect()} == {1: ["Lab"], 2: ["a", "b"], 3: [], 4: ["x"], 5: ["7"]}
    tries = spark.createDataFrame([(1, 1, "none"), (1, 2, one("")), (1, 3, one(', "label": "later"')), (2, 1, "none"), (2, 2, None)], "id long, attempt long, response string")
    found, failed = ingest.first_success(tries)
    assert [(r["id"], r["attempt"], r["entities"][0]["label"], r["attempts"]) for r in found.collect()] == [(1, 2, ["x"], 3)]
    assert [tuple(r) for r in failed.collect()] == [(2, 2)]
    waits = spark.createDataFrame([("please retry in 2.5 s",), ("no",), (None,)], "m string").select(ingest.retry_seconds(F.col("m")).alias("s"))
    assert [r["s"] for r in waits.collect()] == [3.5, 10.0, 10.0]


def test_merging_keeps_the_order_of_graphs(spark):
    one = lambda kind, seq: graph.KnowledgeGraph(spark.createDataFrame([("a", ["A"], kind, "d", "", {"k": kind}, {}, seq)], E), spark.createDataFrame([("a", "is", "b", {"k": kind}, {}, seq)], TR))
    got = graph.merge_graphs(one("old", 1 << 59), one("new", 1 << 50), one("newest", 1))
    e, t = got.entities.first(), got.triplets.first()
    assert (e["type"], e["properties"], t["properties"]) == ("old", {"k": "newest"}, {"k": "old"})
    again = graph.merge_graphs(got, one("last", 0)).entities.first()
    assert (again["type"], again["properties"]) == ("old", {"k": "last"})


def test_files_of_one_name(spark, tmp_path):
    for d in ("a b", "c+d%"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.txt").write_text(f"text of {d}")
    paths = [f"{tmp_path}/c+d%/x.txt", f"{tmp_path}/a b/x.txt", f"{tmp_path}/c+d%/x.txt"]
    assert sorted(map(tuple, files.texts(spark, paths).collect())) == [(0, paths[0], "text of c+d%"), (1, paths[1], "text of a b"), (2, paths[0], "text of c+d%")]


def test_turtle_lines_as_typed_by_hand(spark):
    g = graph.KnowledgeGraph(spark.createDataFrame([("việt nam", ["VN"], "Quốc gia", 'một "nước"', "", None, None, 1)], E), spark.createDataFrame([("việt nam", "thuộc về", "châu á", None, None, 1)], TR))
    got = [r["value"] for r in graph.turtle_lines(g).orderBy("part", "seq", "k").collect()]
    assert got == [":việt_nam a :Quốc gia ;", '  :label "việt nam"@vi ;', '  :description "một "nước""@vi .', "", ":việt_nam :thuộc_về :châu_á ."]


TURTLE = """@prefix : <http://example.org/kg#> .

:chiến_dịch a :Sự kiện ;
  :label "chiến dịch"@vi ;
  :description "Một "trận" lớn; kết thúc . rồi thôi."@vi .

:a/b,c a :Khái niệm ;
  :label "a/b,c"@vi ;
  :description "x"@vi .

:x a :T ;
    :label "x" ;
    :description "without tags" .

:chiến_dịch :thuộc_về :a/b,c .
:a/b,c :là :không_có .
:x :là :x .
"""


def check_turtle(spark, path, n_entities, n_triplets):
    g = files.turtle(spark, str(path))
    e, t = g.entities.collect(), g.triplets.collect()
    assert (len(e), len({r["id"] for r in e}), len(t)) == (n_entities, n_entities, n_triplets) and all(r["id"] and r["type"] and r["description"] for r in e)
    heads = [x.split(" a :", 1)[0][1:] for x in path.read_text().split("\n") if " a :" in x and x.endswith(" ;")]
    assert [r["id"].replace(" ", "_") for r in sorted(e, key=lambda r: r["seq"])] == heads
    return e, g


def test_turtle_typed_by_hand(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TURTLE)
    e, g = check_turtle(spark, tmp_path / "g.ttl", 3, 3)
    assert [(r["id"], r["type"], r["description"]) for r in sorted(e, key=lambda r: r["seq"])] == [("chiến dịch", "Sự kiện", 'Một "trận" lớn; kết thúc . rồi thôi.'), ("a/b,c", "Khái niệm", "x"), ("x", "T", "without tags")]
    assert [(r["subject_id"], r["predicate"], r["object_id"]) for r in g.triplets.orderBy("seq").collect()] == [("chiến_dịch", "thuộc_về", "a/b,c"), ("a/b,c", "là", "không_có"), ("x", "là", "x")]


@pytest.mark.skipif(not GOLDEN.exists(), reason="no large graph named")
def test_large_turtle(spark):
    check_turtle(spark, GOLDEN, *map(int, SIZES.split()))


def test_chunks_are_shuffled_for_their_names_and_order_alone(spark):
    e = spark.createDataFrame([("a", ["A"], "d", "", 1), ("a", ["A"], "e", "", 2), (None, ["N"], "n", "", 3)], "id string, label array<string>, description string, original_text string, seq long")
    t = spark.createDataFrame([("a", "is", "a", 5), ("a", "is", "a", 6), (None, "is", "a", 7), ("a", "is", None, 7)], "subject_id string, predicate string, object_id string, seq long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.retrieval_chunks(graph.KnowledgeGraph(e, t))
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        rows = [(r["id"], r["text"], r["entity_id"], r["subject_id"], r["object_id"]) for r in got.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert rows == [(0, "d ", "a", None, None), (1, "e ", "a", None, None), (2, "n ", None, None, None), (3, "A is A", None, "a", "a"), (4, "A is A", None, "a", "a"), (5, "A is ", None, "a", None), (6, " is A", None, None, "a")]


def test_retrieval_chunks(spark):
    e = entities(spark).where("seq <> 3 and seq <> 2")
    got = graph.retrieval_chunks(graph.KnowledgeGraph(e, graph.dedup_triplets(triplets(spark)))).orderBy("id").collect()
    assert [(r["id"], r["type"], r["text"]) for r in got] == [(0, "entity", "short one"), (1, "entity", " "), (2, "relation", "B is B"), (3, "relation", "B is "), (4, "relation", "B of it B")]


def test_streamed_build_equals_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, t in enumerate(["Alpha one\n\nBeta two", "Alpha three"]):
        (tmp_path / f"in/{k}.txt").write_text(t)
    incremental.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), capitals, 12)
    assert {r["id"] for r in incremental.stored(spark, str(tmp_path / "out"), 0).entities.collect()} == {"alpha", "beta"}
    (tmp_path / "in/2.txt").write_text("Gamma")
    incremental.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), capitals, 12)
    got = incremental.stored(spark, str(tmp_path / "out"), 1).entities
    batch = incremental.extracted(spark.read.text(str(tmp_path / "in"), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), capitals, 12)
    rows = lambda df: sorted((r["id"], r["label"], r["type"], r["description"], r["original_text"]) for r in df.collect())
    assert rows(got) == rows(graph.merge_entities(batch.entities)) and len(rows(got)) == 3


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, t in enumerate(["Alpha one\n\nBeta two\n\nGamma", "Alpha three"]):
        (tmp_path / f"in/{k}.txt").write_text(t)
        incremental.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), capitals, 12)
    wrote = lambda v: {int(p.name.split("=")[1]) for p in (tmp_path / f"out/entities/v{v}").glob("bucket=*")}
    assert len(wrote(0)) >= 2 and len(wrote(1)) == 1 and wrote(1) < wrote(0)
    assert {r["id"] for r in incremental.stored(spark, str(tmp_path / "out"), 1).entities.collect()} == {"alpha", "beta", "gamma"}
    assert {r["id"]: r["description"] for r in incremental.stored(spark, str(tmp_path / "out"), 1).entities.collect()}["alpha"] == "11"
    (tmp_path / "in/9.txt").write_text("")  # a file without a chunk changes nothing
    incremental.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), capitals, 12)
    assert incremental.stored(spark, str(tmp_path / "out"), 2).entities.count() == 3


def test_stream_whose_files_share_ids_equals_the_files_in_order(spark, tmp_path):
    def told(chunks):
        return chunks.select("id", F.concat(F.lit('{"entities": [{"id": "e", "label": ["'), "text", F.lit('"], "type": "'), "text", F.lit('", "description": "same", "original_text": "'), "text", F.lit('", "properties": {"k": "'), "text", F.lit('"}}], "triplets": [{"subject_id": "e", "predicate": "p", "object_id": "f", "properties": {"k": "'), "text", F.lit('"}}]}')).alias("response"))

    (tmp_path / "in").mkdir()
    for k, names in enumerate((("m", "z"), ("a", "q"), ("b",))):
        for n in names:
            (tmp_path / f"in/{n}.txt").write_text(f"{n}{k} first\n\n{n}{k} second")
        incremental.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), told, 14)
    g = incremental.stored(spark, str(tmp_path / "out"), 2)
    e, t = g.entities.first(), g.triplets.first()
    order = [f"{n} {w}" for n in ("m0", "z0", "a1", "q1", "b2") for w in ("first", "second")]
    assert (e["label"], e["type"], e["original_text"], e["properties"], t["properties"]) == (order, order[0], "\n\n".join(order), {"k": order[-1]}, {"k": order[0]})


def test_chunks_one_after_another(spark):
    def make():
        def model(text, known):
            return json.dumps({"entities": [{"id": text.split()[0], "type": "T", "label": [text], "description": known or "none"}], "triplets": []}) if "bad" not in text else "no graph"

        return model

    texts = spark.createDataFrame([("p|1", "one a\n\ntwo b\n\nbad\n\nthree c"), ("q", "four d")], "path string, text string")
    got = incremental.extracted(texts, incremental.sequentially(make, 2), 7).entities.orderBy("seq").collect()
    assert [(r["seq"]["path"], r["seq"]["chunk"], r["id"], r["description"]) for r in got] == [("p|1", 0, "one", "none"), ("p|1", 1, "two", "- one (T): one a"), ("p|1", 3, "three", "- one (T): one a\n- two (T): two b"), ("q", 0, "four", "none")]


def test_question_set(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"multiple_choice": [{"question": "q", "options": [{"answer": "a", "isCorrect": True}]}], "true_false": []}))
    assert [(r["q_type"], r["id"]) for r in files.questions_json(spark, str(tmp_path / "q.json")).collect()] == [("multiple_choice", 1)]
