"""Writing graphs and reports. Tables go to Parquet; single documents are for results that one file can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.graph import KnowledgeGraph, node_properties, turtle_lines


def tables(graph: KnowledgeGraph, folder: str) -> None:
    graph.entities.write.mode("overwrite").parquet(f"{folder}/entities")
    graph.triplets.write.mode("overwrite").parquet(f"{folder}/triplets")


def graph_json(graph: KnowledgeGraph, path: str) -> None:
    """One JSON document {entities, triplets}, in order of seq."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*[c for c in df.columns if c != "seq"]), {"ignoreNullFields": "false"}).alias("j"))))
        return df.agg(F.array_join(F.transform(rows, lambda r: r["j"]), ",\n").alias(name))

    both = listed(graph.entities, "e").crossJoin(listed(graph.triplets, "t"))
    both.select(F.concat(F.lit('{"entities": ['), "e", F.lit('],\n"triplets": ['), "t", F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def turtle(graph: KnowledgeGraph, path: str, strict: bool = False) -> None:
    lines = turtle_lines(graph, strict)
    head = lines.sparkSession.createDataFrame([(0, 0, "@prefix : <http://example.org/kg#> ."), (0, 1, "")], "part int, k int, value string")
    head.withColumn("seq", F.lit(None).cast(lines.schema["seq"].dataType)).unionByName(lines).orderBy("part", "seq", "k").select("value").coalesce(1).write.mode("overwrite").text(path)


def property_graph(graph: KnowledgeGraph, folder: str, raw_types: bool = False) -> None:
    """Node and edge tables: labels from aliases, name = id unless given, sanitised property keys; edges whose ends are both there. Rows that can be neither, as they lack an id, a predicate or an end, go to the table `rejected`."""
    labels = F.filter(F.transform(F.filter("label", lambda x: F.coalesce(x, F.lit("")) != ""), T.sanitized), lambda x: x != "")
    empty = F.create_map().cast("map<string,string>")
    props = node_properties(F.coalesce("properties", empty))
    bad = lambda df, what, *needed: df.where(" or ".join(f"{c} is null" for c in needed)).select(F.lit(what).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "seq"])).alias("row"))
    bad(graph.entities, "node", "id").union(bad(graph.triplets, "edge", "subject_id", "predicate", "object_id")).write.mode("overwrite").parquet(f"{folder}/rejected")
    nodes = graph.entities.where("id is not null").select(labels.alias("labels"), "id", F.coalesce(F.try_element_at(props, F.lit("name")), F.col("id")).alias("name"), "description", "original_text", props.alias("properties"), F.to_json("metadata").alias("metadata"))
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    ids = graph.entities.select("id")
    kind = F.col("predicate") if raw_types else T.relation_type(F.col("predicate"))
    edges = graph.triplets.join(ids.withColumnRenamed("id", "subject_id"), "subject_id").join(ids.withColumnRenamed("id", "object_id"), "object_id")
    edges.select("subject_id", "object_id", kind.alias("rel_type"), F.coalesce("properties", empty).alias("properties"), F.to_json("metadata").alias("metadata")).write.mode("overwrite").parquet(f"{folder}/edges")


def questions_json(multiple_choice: DataFrame, true_false: DataFrame, path: str) -> None:
    """A converted question set as one JSON document; both tables: question, options, and the columns `order` sorts by."""

    def listed(df: DataFrame, name: str, *order: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct("question", "options")).alias("j"))))
        return df.agg(F.array_join(F.transform(rows, lambda r: r["j"]), ",\n").alias(name))

    both = listed(multiple_choice, "m", "id").crossJoin(listed(true_false, "t", "id", "k"))
    both.select(F.concat(F.lit('{"multiple_choice": ['), "m", F.lit('],\n"true_false": ['), "t", F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def summary(stats: DataFrame) -> str:
    """The figures of an evaluation as a few lines of text; stats has a row a question type and one over all."""
    rows = sorted((r.asDict() for r in stats.collect()), key=lambda r: (r["q_type"] == "overall", r["q_type"]))
    return "\n".join(f"{r['q_type']}: {r['correct']} of {r['total']} right ({r['accuracy']:.1f} %), {r['wrong']} wrong, {r['no_prediction']} without an answer" for r in rows)


def html_report(cards: DataFrame, stats: DataFrame, path: str) -> None:
    """One page: the figures, then a card a question, in order. Cards may be `evaluate.cards` or `evaluate.full_cards`."""
    rows = "".join(
        f"<tr><td>{r['q_type']}</td><td>{r['correct']} / {r['total']}</td><td>{r['accuracy']:.1f} %</td><td>{r['no_prediction']}</td><td>{r['prediction_rate']:.1f} %</td></tr>"
        for r in sorted(stats.collect(), key=lambda r: (r["q_type"] == "overall", r["q_type"]))  # a few rows
    )
    style = "body{font-family:sans-serif}.card{border-left:4px solid #999;margin:8px;padding:4px 8px}.correct{border-color:#2a2}.wrong{border-color:#c22}.badge{border-radius:3px;padding:0 4px;background:#eee}.answer{font-weight:bold}"
    names = "".join(f"<th>{n}</th>" for n in ("type", "right", "accuracy", "no answer", "answered"))
    head = F.lit(f"<!DOCTYPE html><meta charset='utf-8'><title>Report</title><style>{style}</style><table><tr>{names}</tr>{rows}</table>")
    spark = cards.sparkSession
    first = spark.range(1).select(F.lit("").alias("q_type"), F.lit(0).cast("long").alias("id"), head.alias("value"))
    body = cards.select("q_type", F.col("id").cast("long").alias("id"), F.col("card").alias("value"))
    first.unionByName(body).orderBy("q_type", "id").select("value").coalesce(1).write.mode("overwrite").text(path)
