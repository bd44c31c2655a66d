"""Knowledge-graph tables: entities(id, label, type, description, original_text, properties, metadata, seq) and triplets(subject_id, predicate, object_id, properties, metadata, seq).

Order decides merges and ties, so every table carries seq, of any type that can be compared.

Defined results: null labels, texts and maps count as empty; a null id is an id of its own when merging and no end of an edge; repeated rows merge into one; rows of equal seq come in any order;
empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.lineage import written


@dataclass
class KnowledgeGraph:
    entities: DataFrame
    triplets: DataFrame


def merged_map(rows: Column, name: str) -> Column:
    """Later maps win, key by key; needs no session setting."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(rows, empty, lambda acc, r: F.map_concat(F.map_filter(acc, lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(r[name], empty)), k)), F.coalesce(r[name], empty)))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row an id, folded in order of seq: labels united, texts appended unless contained, maps updated, the longer description, the first type."""
    row = F.struct("seq", "label", "type", "description", "original_text", "properties", "metadata")
    rows = F.array_sort(F.collect_list(row), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    new = lambda r: T.strip(F.coalesce(r["original_text"], F.lit("")))
    text = F.aggregate("rows", F.lit(""), lambda acc, r: F.when((new(r) == "") | F.contains(acc, new(r)), acc).when(acc == "", new(r)).otherwise(F.concat(acc, F.lit("\n\n"), new(r))))
    longest = F.aggregate("rows", F.lit(""), lambda acc, r: F.when(F.length(F.coalesce(r["description"], F.lit(""))) > F.length(acc), r["description"]).otherwise(acc))
    return (
        entities.groupBy("id")
        .agg(rows.alias("rows"))
        .select(
            "id",
            F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["label"], F.array().cast("array<string>"))))).alias("label"),
            F.col("rows")[0]["type"].alias("type"),
            longest.alias("description"),
            text.alias("original_text"),
            merged_map(F.col("rows"), "properties").alias("properties"),
            merged_map(F.col("rows"), "metadata").alias("metadata"),
            F.col("rows")[0]["seq"].alias("seq"),
        )
    )


def dedup_triplets(triplets: DataFrame) -> DataFrame:
    """The first of each (subject_id, predicate, object_id), with its payload; each task keeps its first before anything is shuffled."""
    keys = ["subject_id", "predicate", "object_id"]
    if set(triplets.columns) == {*keys, "seq"}:  # no payload: counted in a hash table, nothing is sorted
        return triplets.groupBy(*keys).agg(F.min("seq").alias("seq")).select(*triplets.columns)
    first = triplets.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in triplets.columns if c not in keys]), "seq").alias("r"))
    return first.select(*keys, "r.*").select(*triplets.columns)


def merge_graphs(*graphs: KnowledgeGraph, ordered: bool = False) -> KnowledgeGraph:
    """Graphs one after another; seq becomes (graph, seq), as an array. ordered: seq already tells the order over all of them, and stays."""

    def order(df: DataFrame, k: int) -> DataFrame:
        if ordered:
            return df
        own = F.col("seq") if df.schema["seq"].dataType.typeName() == "array" else F.array(F.col("seq").cast("long"))
        return df.withColumn("seq", F.concat(F.array(F.lit(k).cast("long")), own))

    entities, triplets = (order(getattr(graphs[0], x), 0) for x in ("entities", "triplets"))
    for k, g in enumerate(graphs[1:], 1):
        entities, triplets = entities.unionByName(order(g.entities, k)), triplets.unionByName(order(g.triplets, k))
    return KnowledgeGraph(merge_entities(entities), dedup_triplets(triplets))


def entity_index(entities: DataFrame) -> DataFrame:
    """key -> entity: ids and lower-cased labels share one name space; the last writer wins, of one entity its id first, then its labels."""
    keys = F.concat(F.array(F.col("id")), F.transform(F.coalesce("label", F.array().cast("array<string>")), F.lower))
    spread = entities.select(F.posexplode(keys).alias("pos", "key"), F.col("id").alias("entity_id"), F.get("label", F.lit(0)).alias("name"), "seq").where("key is not null")
    return spread.groupBy("key").agg(F.max_by(F.struct("entity_id", "name"), F.struct("seq", "pos")).alias("e")).select("key", "e.entity_id", "e.name")


def resolved(triplets: DataFrame, entities: DataFrame) -> DataFrame:
    """Triplets both of whose ends are entities (repeated ids multiply)."""
    a, b = entities.select(F.col("id").alias("subject_id")), entities.select(F.col("id").alias("object_id"))
    return triplets.join(a, "subject_id").join(b, "object_id")


def _ends(triplets: DataFrame) -> DataFrame:
    """Each id at an end of a triplet once, without null; each task keeps an id once before anything is shuffled."""
    return triplets.select(F.col("subject_id").alias("id")).union(triplets.select(F.col("object_id").alias("id"))).where("id is not null").distinct()


def dangling(triplets: DataFrame, entities: DataFrame) -> DataFrame:
    """Triplets an end of which is no entity, repeated ones too. Only the distinct ends meet the entities; those that none has are written, so that the triplets themselves are shuffled only where these are too many to broadcast."""
    missing = written(_ends(triplets).join(entities.select("id"), "id", "left_anti"), "missing")
    a, b = missing.select(F.col("id").alias("subject_id"), F.lit(True).alias("no_s")), missing.select(F.col("id").alias("object_id"), F.lit(True).alias("no_o"))
    t = triplets.select("subject_id", "predicate", "object_id").join(a, "subject_id", "left").join(b, "object_id", "left")
    no_subject, no_object = F.col("subject_id").isNull() | F.col("no_s").isNotNull(), F.col("object_id").isNull() | F.col("no_o").isNotNull()
    return t.where(no_subject | no_object).select("subject_id", "predicate", "object_id", no_subject.alias("no_subject"), no_object.alias("no_object"))


def isolated(triplets: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(_ends(triplets), "id", "left_anti")


def relation_texts(triplets: DataFrame, index: DataFrame, *also: str) -> DataFrame:
    """'<subject label> <predicate> <object label>' with '' for ends that aren't there. also: further columns of the triplets that stay."""
    s, o = index.select(F.col("key").alias("subject_id"), F.col("name").alias("s_name")), index.select(F.col("key").alias("object_id"), F.col("name").alias("o_name"))
    named = triplets.join(s, "subject_id", "left").join(o, "object_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return named.select("subject_id", "predicate", "object_id", F.concat(blank("s_name"), F.lit(" "), "predicate", F.lit(" "), blank("o_name")).alias("text"), *also)


def entity_texts(entities: DataFrame, most: int = 500, *also: str) -> DataFrame:
    """also: further columns of the entities that stay."""
    t = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("original_text", F.lit("")))
    return entities.select(F.col("id").alias("entity_id"), F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t).alias("text"), *also)


def type_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def ratio(graph: KnowledgeGraph) -> DataFrame:
    e, t = graph.entities.agg(F.count(F.lit(1)).alias("entities")), graph.triplets.agg(F.count(F.lit(1)).alias("triplets"))
    return e.crossJoin(t).withColumn("ratio", F.coalesce(F.try_divide("triplets", "entities"), F.lit(0.0))).withColumn("sparse", F.col("ratio") < 1.0)


def summary_of_last(entities: DataFrame, most: int = 100) -> DataFrame:
    """One line for each of the last entities, in order."""
    line = F.concat(F.lit("- "), "id", F.lit(" ("), "type", F.lit("): "), F.array_join(F.slice("label", 1, 3), ", "))
    return entities.orderBy(F.desc("seq")).limit(most).select("seq", line.alias("line")).orderBy("seq")


def turtle_lines(graph: KnowledgeGraph, strict: bool = False, language: str = "vi") -> DataFrame:
    """(part, seq, k, value): the lines of a Turtle file, three and an empty one an entity, one a triplet. A null type or description is an empty one; strict escapes what isn't a valid local name or string."""
    name = (lambda c: F.replace(c, F.lit(" "), F.lit("_"))) if not strict else (lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_"))
    kind = (lambda c: c) if not strict else name
    quoted = (lambda c: c) if not strict else (lambda c: F.regexp_replace(c, r'(["\\])', r"\\$1"))
    c, known = F.col, lambda x: F.coalesce(F.col(x), F.lit(""))
    of_entity = F.array(
        F.concat(F.lit(":"), name(c("id")), F.lit(" a :"), kind(known("type")), F.lit(" ;")),
        F.concat(F.lit('  :label "'), quoted(c("id")), F.lit(f'"@{language} ;')),
        F.concat(F.lit('  :description "'), quoted(known("description")), F.lit(f'"@{language} .')),
        F.lit(""),
    )
    e = graph.entities.where("id is not null").select(F.lit(1).alias("part"), "seq", F.posexplode(of_entity).alias("k", "value"))
    t = graph.triplets.where("subject_id is not null and predicate is not null and object_id is not null").select(F.lit(2).alias("part"), "seq", F.lit(0).alias("k"), F.concat(F.lit(":"), name(c("subject_id")), F.lit(" :"), name(c("predicate")), F.lit(" :"), name(c("object_id")), F.lit(" .")).alias("value"))
    return e.unionByName(t)


def retrieval_chunks(graph: KnowledgeGraph, index: DataFrame | None = None) -> DataFrame:
    """id (from 0: entities by seq, then relations by seq), type, text, entity_id, subject_id, predicate, object_id. One chunk a row of the graph, also where an id is null or repeated."""
    e = entity_texts(graph.entities, 500, "seq")
    r = relation_texts(graph.triplets, entity_index(graph.entities) if index is None else index, "seq")
    both = e.select(F.lit(0).alias("part"), "seq", F.lit("entity").alias("type"), "text", "entity_id").unionByName(r.select(F.lit(1).alias("part"), "seq", F.lit("relation").alias("type"), "text", "subject_id", "predicate", "object_id"), allowMissingColumns=True)
    return numbered(both, "part", "seq", "subject_id", "object_id", "predicate", "entity_id").drop("part", "seq")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with id, from 0 in this order, nulls last: a distributed sort, then each partition counts on from those before it. Written in between, so that both steps see one order."""
    ordered = written(df.orderBy(*[F.asc_nulls_last(c) for c in order]).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_at", 33))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_p").withColumn("id", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_before")


def node_properties(keys: Column) -> Column:
    """A property map with sanitised keys; empty keys go, of keys that become alike the last wins."""
    pairs = F.filter(F.transform(F.map_entries(keys), lambda e: F.struct(T.property_key(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")
    last = F.filter(pairs, lambda e, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)
