"""Every named query over the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import evaluate, graph, ingest, models, retrieve
from graphloom.plans import star
from graphloom.plans.star import ENTITIES, TRIPLETS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("text").alias("original_text"))


TOP = r"""
w AS (SELECT item_id AS q_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2)) AS w FROM benchmark),
counted AS (SELECT q_id, w, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT doc_id AS id, lower(text) AS de, lower(text) AS o, text FROM documents),
scored AS (
  SELECT q_id, id, CAST(sum(n * (2 * CAST(contains(de, w) AS INT) + CAST(contains(o, w) AS INT))) AS INT) AS score
  FROM counted, d WHERE contains(o, w) GROUP BY q_id, id
),
top AS (SELECT q_id, id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS INT) AS rank FROM scored QUALIFY rank <= 5)
"""


@query(f"WITH {TOP} SELECT * FROM top")
def lexical_topk(spark, sf):
    return retrieve.lexical_topk(questions(spark, sf), documents(spark, sf))


@query(f"""WITH {TOP} SELECT b.item_id AS q_id, coalesce(string_agg(substr(d.text, 1, 500), chr(10) || chr(10) ORDER BY rank), '{T.NOTHING_FOUND}') AS context
FROM benchmark b LEFT JOIN top ON top.q_id = b.item_id LEFT JOIN d ON d.id = top.id GROUP BY 1""")
def lexical_context(spark, sf):
    q, d = questions(spark, sf), documents(spark, sf)
    return retrieve.lexical_context(retrieve.lexical_topk(q, d), d, q)


@query(r"""WITH labels AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS l FROM documents)
SELECT b.item_id AS q_id, any_value(b.text) || ' ' || coalesce(string_agg(l, ' ' ORDER BY l), '') AS query FROM benchmark b LEFT JOIN labels ON l <> '' AND contains(lower(b.text), lower(l)) GROUP BY 1""")
def query_expand(spark, sf):
    labels = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("label")).distinct().withColumn("seq", F.col("label"))
    return retrieve.expanded(questions(spark, sf), labels)


UNITS = r"""
p AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
u AS (
  SELECT doc_id, CASE WHEN length(t) > 1200 THEN list_filter(list_transform(regexp_split_to_array(t, '[.!?;]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') ELSE [t] END AS s,
         CASE WHEN length(t) > 1200 THEN '. ' ELSE chr(10) || chr(10) END AS tail FROM p WHERE t <> ''
)"""
PACKED = rf"""WITH RECURSIVE {UNITS},
r AS (
  SELECT doc_id, s, tail, 0 AS i, '' AS cur, '' AS emit, false AS out FROM u
  UNION ALL
  SELECT doc_id, s, tail, i + 1, CASE WHEN i >= len(s) THEN '' WHEN length(cur) + length(s[i + 1]) + 2 > 1200 THEN s[i + 1] || tail ELSE cur || s[i + 1] || tail END,
         regexp_replace(cur, '^\s+|\s+$', '', 'g'), cur <> '' AND (i >= len(s) OR length(cur) + length(s[i + 1]) + 2 > 1200)
  FROM r WHERE i <= len(s)
),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_no, emit AS text FROM r WHERE out)
"""


@query(f"{PACKED} SELECT * FROM chunks")
def chunk_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "text"))


@query(f"{PACKED} SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(max(length(text)) AS INT) AS longest, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks")
def chunk_stats(spark, sf):
    return chunk_documents(spark, sf).agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(r"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower('Là gì của ' || text || ' và'), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1 AND NOT list_contains(string_split('các của gì hoặc là những trong từ và vào với đến', ' '), w))[1:5], ' ') AS keywords FROM benchmark""")
def keywords(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.keywords(F.concat(F.lit("Là gì của "), "text", F.lit(" và"))).alias("keywords"))


@query("""WITH x AS (SELECT conv_id, turn, lower(translate(text, 'aA', 'eE') || (['', ' Ai', ' cái gì', ' ở đâu', ' Khi nào', ' tại sao, khi nào'])[CAST(turn % 6 AS INT) + 1]) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'ai') THEN 'person' WHEN contains(t, 'cái gì') THEN 'thing' WHEN contains(t, 'ở đâu') THEN 'location'
WHEN contains(t, 'khi nào') THEN 'time' WHEN contains(t, 'tại sao') THEN 'reason' ELSE '' END AS category FROM x""")
def question_category(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p in ("", " Ai", " cái gì", " ở đâu", " Khi nào", " tại sao, khi nào")]), (F.col("turn") % 6 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.category(F.concat(F.translate("text", "aA", "eE"), phrase)).alias("category"))


@query(f"WITH {TRIPLETS} SELECT subject_id, predicate, object_id, min(seq) AS seq FROM t GROUP BY ALL")
def triplet_dedup(spark, sf):
    return graph.dedup_triplets(star.triplets(spark, sf))


@query("""WITH x AS (SELECT user_id, event_id, event_type, event_type || ' ' || (event_id % 97) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
kv AS (SELECT user_id, event_id, 'k' || (event_id % 5) AS k, CAST(value AS VARCHAR) AS raw, event_id AS v FROM events),
last AS (SELECT user_id, k, arg_max(v, event_id) AS v FROM kv GROUP BY ALL),
meta AS (SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS metadata FROM (SELECT user_id, 'm' || (event_id % 3) AS k, max(event_id) AS v FROM events GROUP BY ALL) GROUP BY 1),
texts AS (SELECT user_id, string_agg(event_type, chr(10) || chr(10) ORDER BY f) AS original_text FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY 1),
props AS (SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM last GROUP BY 1),
labels AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS label FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1)
SELECT CAST(x.user_id AS VARCHAR) AS id, any_value(labels.label) AS label, arg_min(event_type, event_id) AS type, arg_min(d, (-length(d)) * 1000000000000 + event_id) AS description,
  any_value(props.properties) AS properties, any_value(meta.metadata) AS metadata, any_value(texts.original_text) AS original_text, min(event_id) AS seq
FROM x JOIN props USING (user_id) JOIN labels USING (user_id) JOIN meta USING (user_id) JOIN texts USING (user_id) GROUP BY x.user_id""")
def entity_merge_events(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("id"),
        F.array("event_type").alias("label"),
        F.col("event_type").alias("type"),
        F.concat("event_type", F.lit(" "), (F.col("event_id") % 97).cast("string")).alias("description"),
        F.concat(F.lit(" "), "event_type").alias("original_text"),
        F.create_map(F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string")), F.col("event_id").cast("string")).alias("properties"),
        F.create_map(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")), F.col("event_id").cast("string")).alias("metadata"),
        F.col("event_id").alias("seq"),
    )
    m = graph.merge_entities(rows)
    pairs = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda p: F.concat(p["key"], F.lit("="), p["value"]))), ",").alias(c)
    return m.select("id", F.array_join(F.array_sort("label"), ",").alias("label"), "type", "description", pairs("properties"), pairs("metadata"), "original_text", "seq")


@query(f"""WITH {ENTITIES}, keys AS (SELECT id AS key, id, seq, 0 AS pos FROM e UNION ALL SELECT lower(name), id, seq, 1 FROM e)
SELECT key, arg_max(id, seq * 2 + pos) AS entity_id FROM keys GROUP BY key""")
def entity_index_lww(spark, sf):
    return graph.entity_index(star.entities(spark, sf)).select("key", "entity_id")


@query(f"WITH {ENTITIES}, {TRIPLETS} SELECT subject_id, predicate, object_id, t.seq FROM t JOIN e a ON a.id = subject_id JOIN e b ON b.id = object_id")
def edges_resolved(spark, sf):
    return graph.resolved(star.triplets(spark, sf), star.entities(spark, sf)).select("subject_id", "predicate", "object_id", "seq")


@query(f"""WITH {ENTITIES}, {TRIPLETS}, d AS (SELECT DISTINCT subject_id, predicate, object_id FROM t)
SELECT d.*, a.id IS NULL AS no_subject, b.id IS NULL AS no_object FROM d LEFT JOIN e a ON a.id = subject_id LEFT JOIN e b ON b.id = object_id WHERE a.id IS NULL OR b.id IS NULL""")
def edges_dangling(spark, sf):
    return graph.dangling(star.triplets(spark, sf), star.entities(spark, sf)).distinct()


@query(f"WITH {ENTITIES}, {TRIPLETS} SELECT id, type FROM e WHERE id NOT IN (SELECT subject_id FROM t) AND id NOT IN (SELECT object_id FROM t)")
def nodes_isolated(spark, sf):
    g = star.graph(spark, sf)
    return graph.isolated(g.triplets, g.entities).select("id", "type")


RELATIONS = f"""WITH {ENTITIES}, {TRIPLETS}, d AS (SELECT subject_id, predicate, object_id, min(seq) AS seq FROM t GROUP BY ALL),
r AS (SELECT subject_id, predicate, object_id, d.seq, coalesce(a.name, '') || ' ' || predicate || ' ' || coalesce(b.name, '') AS text FROM d LEFT JOIN e a ON a.id = subject_id LEFT JOIN e b ON b.id = object_id)"""


@query(f"{RELATIONS} SELECT subject_id, predicate, object_id, text FROM r")
def relation_chunk_text(spark, sf):
    return graph.relation_texts(graph.dedup_triplets(star.triplets(spark, sf)), graph.entity_index(star.entities(spark, sf)))


@query(f"""{RELATIONS}, both_ AS (SELECT 0 AS part, seq, 'entity' AS type, description || ' ' || name AS text, id AS entity_id, NULL AS subject_id, NULL AS predicate, NULL AS object_id FROM e
UNION ALL SELECT 1, seq, 'relation', text, NULL, subject_id, predicate, object_id FROM r)
SELECT row_number() OVER (ORDER BY part, seq, subject_id, object_id) - 1 AS id, type, text, entity_id, subject_id, predicate, object_id FROM both_""")
def retrieval_chunks(spark, sf):
    g = star.graph(spark, sf)
    return graph.retrieval_chunks(graph.KnowledgeGraph(g.entities, graph.dedup_triplets(g.triplets)))


@query("SELECT doc_id AS entity_id, CASE WHEN length(source || ' ' || text) > 500 THEN substr(source || ' ' || text, 1, 500) || '...' ELSE source || ' ' || text END AS text FROM documents")
def entity_chunk_text(spark, sf):
    return graph.entity_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("description"), F.col("text").alias("original_text")))


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n, min(seq) AS first_seq FROM e GROUP BY type")
def type_histogram(spark, sf):
    return graph.type_histogram(star.entities(spark, sf))


@query(f"WITH {ENTITIES}, {TRIPLETS}, n AS (SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM t) AS triplets) SELECT *, triplets / entities AS ratio, triplets / entities < 1 AS sparse FROM n")
def kg_ratio(spark, sf):
    return graph.ratio(star.graph(spark, sf))


@query(f"WITH {ENTITIES} SELECT seq, '- ' || id || ' (' || type || '): ' || name AS line FROM e ORDER BY seq DESC LIMIT 100")
def last_100_summary(spark, sf):
    return graph.summary_of_last(star.entities(spark, sf))


NEAR = """
q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q_id, id, round(list_cosine_similarity(q.v, a.v), 12) AS score FROM q, a),
near AS (SELECT q_id, id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 5)
"""
#: Components of a vector that stand for the key words of its question in the second search.
KEY = 8


def vectors(spark, sf):
    """Every vector whose id is divisible by 20 is a query, against all vectors."""
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"WITH {NEAR} SELECT q_id, id, round(score, 6) AS score, rank FROM near")
def vector_topk(spark, sf):
    return retrieve.vector_topk(*vectors(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {NEAR}, twice AS (SELECT q_id, id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 6) SELECT q_id, id, round(score, 6) AS score, rank FROM twice WHERE rank <= 3")
def vector_overfetch_cut(spark, sf):
    return models.semantic_search(*vectors(spark, sf), 3).withColumn("score", F.round("score", 6))


SEARCHES = f"""{NEAR},
q2 AS (SELECT q_id, list_transform(v, lambda x: CASE WHEN abs(x) >= list_reverse_sort(list_transform(v, lambda y: abs(y)))[{KEY}] THEN x ELSE 0 END) AS v FROM q),
s2 AS (SELECT q_id, id, round(list_cosine_similarity(q2.v, a.v), 12) AS score FROM q2, a),
near2 AS (SELECT q_id, id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS INT) AS rank FROM s2 QUALIFY rank <= 2),
both_ AS (SELECT q_id, id, rank FROM near WHERE rank <= 3 UNION ALL SELECT q_id, id, 10 + rank FROM near2),
texts AS (SELECT vec_id AS id, 'class ' || label || ' of ' || (vec_id % 7) AS text FROM embeddings),
first AS (SELECT q_id, text, arg_min(id, rank) AS id, min(rank) AS place FROM both_ JOIN texts USING (id) GROUP BY q_id, text),
few AS (SELECT q_id, id, text, CAST(row_number() OVER (PARTITION BY q_id ORDER BY place) AS INT) AS rank FROM first QUALIFY rank <= 3)"""


@query(f"WITH {SEARCHES} SELECT q_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM few GROUP BY q_id")
def hybrid_context(spark, sf):
    """Question search, top 3, then key-word search, top 2, each text once, 3 in all."""
    q, v = vectors(spark, sf)
    least = F.element_at(F.sort_array(F.transform("v", F.abs), asc=False), KEY)
    key = q.select("q_id", F.transform("v", lambda x: F.when(F.abs(x) >= least, x).otherwise(F.lit(0).cast("float"))).alias("v"))
    texts = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("class "), F.col("label").cast("string"), F.lit(" of "), (F.col("vec_id") % 7).cast("string")).alias("text"))
    return models.two_searches(q, models.semantic_search(q, v, 3), models.semantic_search(key, v, 2), texts)


@query(r"""WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 4) AS INT) AS n FROM documents),
o AS (SELECT doc_id, [substr(text, 1, n), substr(text, 1 + n, n), substr(text, 1 + 2 * n, n), substr(text, 1 + 3 * n, n)] AS options, lower(text) AS c FROM n),
s AS (SELECT doc_id, list_transform(options, lambda x: len(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: length(w) > 3 AND contains(c, w)))) AS s FROM o)
SELECT doc_id, CASE WHEN list_max(s) > 0 THEN chr(CAST(64 + list_position(s, list_max(s)) AS INT)) ELSE 'A' END AS answer FROM s""")
def option_argmax(spark, sf):
    """Each text in four equal slices as options, with the whole text as context."""
    n = F.ceil(F.length("text") / 4).cast("int")
    part = lambda k: F.substring("text", 1 + n * k, n)
    o = table(spark, sf, "documents").select("doc_id", F.array(*[part(k) for k in range(4)]).alias("options"), F.col("text").alias("context"))
    return o.select("doc_id", evaluate.best_option(evaluate.option_scores(F.col("options"), F.col("context"))).alias("answer"))


ALONE = r"regexp_extract(u, '(^|[^\p{L}\p{N}_])([ABCD])($|[^\p{L}\p{N}_])', 2)"


@query(rf"""WITH x AS (SELECT conv_id, turn, regexp_replace(upper(text), '^\s+|\s+$', '', 'g') AS u FROM conversations)
SELECT conv_id, turn, CASE WHEN u IN ('A','B','C','D') THEN u WHEN {ALONE} <> '' THEN {ALONE} ELSE '{T.NO_ANSWER}' END AS letter,
CASE WHEN u IN ('A','B','C','D') THEN 1.0::DOUBLE WHEN {ALONE} <> '' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM x""")
def extract_answer(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", T.answer_letter(F.col("text")).alias("a"))
    return a.select("conv_id", "turn", "a.letter", "a.confidence")


def _first_alone(letter: str) -> str:
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){letter}($|[^\p{{L}}\p{{N}}_])')"


@query(f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN (['B', 'D', NULL])[CAST(turn % 3 AS INT) + 1] {' '.join(f"WHEN {_first_alone(x)} THEN '{x}'" for x in 'ABCD')} END AS letter FROM conversations""")
def extract_answer_regex(spark, sf):
    """A third of the responses name a letter behind the answer mark, some of them one that no option has."""
    mark = F.element_at(F.array(F.lit(" Đáp án: B"), F.lit(" đáp ÁN :d, A"), F.lit(" Đáp án:A")), (F.col("turn") % 3 + 1).cast("int"))
    said = F.when(F.col("conv_id") % 3 == 0, F.concat("text", mark)).otherwise(F.col("text"))
    few = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 3 == 2), F.lit(None)).otherwise(T.answer_option(said)["letter"])
    return table(spark, sf, "conversations").select("conv_id", "turn", few.alias("letter"))


@query("SELECT item_id, substr(text, 1, 40) AS context, substr(text, 41) AS statement FROM (SELECT item_id, regexp_replace(text, '\\s+', '_', 'g') AS text FROM benchmark)")
def tf_statement(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", "_").alias("t"))
    made = F.concat(F.lit('Đọc đoạn tư liệu sau đây: "'), F.substring("t", 1, 40), F.lit('" Phát biểu sau: "'), F.expr("substring(t, 41)"), F.lit('"'))
    s = b.select("item_id", T.statement(made).alias("s"))
    return s.select("item_id", "s.context", "s.statement")


GRADED = """g AS (SELECT l.doc_id AS id, CASE WHEN l.doc_id % 2 = 0 THEN 'multiple_choice' ELSE 'true_false' END AS q_type,
  CASE WHEN d.n_chars % 7 = 0 THEN '[NO PREDICTION]' WHEN d.n_chars > 800 THEN 'A' ELSE 'B' END AS predicted, CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS correct
  FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT *, predicted = correct AS is_correct, CASE WHEN predicted = correct THEN 'correct' WHEN predicted = '[NO PREDICTION]' THEN 'no-answer' ELSE 'wrong' END AS status FROM g)"""


@query(f"WITH {GRADED} SELECT * FROM r")
def eval_results(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "multiple_choice").otherwise("true_false").alias("q_type"),
        F.when(F.col("n_chars") % 7 == 0, F.lit("")).when(F.col("n_chars") > 800, "A").otherwise("B").alias("predicted"),
        F.when(F.col("quality") == 1, "A").otherwise("B").alias("correct"),
    )
    return evaluate.graded(rows)


@query(f"""WITH {GRADED} SELECT coalesce(q_type, 'overall') AS q_type, count(*) AS total, CAST(sum(is_correct::INT) AS BIGINT) AS correct, CAST(sum((status = 'wrong')::INT) AS BIGINT) AS wrong,
CAST(sum((status = 'no-answer')::INT) AS BIGINT) AS no_prediction, round(sum(is_correct::INT) / count(*) * 100, 6) AS accuracy, round((count(*) - sum((status = 'no-answer')::INT)) / count(*) * 100, 6) AS prediction_rate FROM r GROUP BY ROLLUP (q_type)""")
def eval_stats(spark, sf):
    return evaluate.statistics(eval_results(spark, sf))


@query(f"""WITH {GRADED} SELECT q_type, id, CAST(row_number() OVER w AS INT) AS n, round(avg(is_correct::INT) OVER (PARTITION BY q_type ORDER BY id ROWS UNBOUNDED PRECEDING) * 100, 6) AS accuracy
FROM r WINDOW w AS (PARTITION BY q_type ORDER BY id) QUALIFY n % 5 = 0""")
def running_accuracy(spark, sf):
    return evaluate.running_accuracy(eval_results(spark, sf))


@query(f"""WITH {GRADED} SELECT id, q_type, '<div class="card ' || status || '"><b>#' || id || '</b> ' || predicted || ' / ' || correct || '</div>' AS card FROM r""")
def report_cards(spark, sf):
    return evaluate.cards(eval_results(spark, sf))


SANE = r"regexp_replace(regexp_replace(x, '[^\p{L}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {SANE} AS id FROM (SELECT page_id, url AS x FROM pages)")
def sanitize_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.sanitized(F.col("url")).alias("id"))


@query(rf"SELECT p_partkey, coalesce(nullif(upper(regexp_replace({SANE}, '[\s-]+', '_', 'g')), ''), 'RELATED_TO') AS rel_type FROM (SELECT p_partkey, p_type AS x FROM part)")
def rel_types(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.relation_type(F.col("p_type")).alias("rel_type"))


@query("SELECT event_id, 'a_b=' || event_type || ',k=' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS properties FROM events")
def flatten_props(spark, sf):
    e = table(spark, sf, "events")
    m = F.map_concat(F.create_map(F.lit("a b"), F.lit("first"), F.lit("a-b"), F.col("event_type"), F.lit("!?"), F.lit("gone")), F.from_json("props", "map<string,string>"))
    flat = F.array_sort(F.transform(F.map_entries(graph.node_properties(m)), lambda p: F.concat(p["key"], F.lit("="), p["value"])))
    return e.select("event_id", F.array_join(flat, ",").alias("properties"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, sf):
    e = table(spark, sf, "events")
    broken = F.concat(F.lit("Here it is:\n```json\n{\"a\": "), F.expr("substring(props, 1, length(props) - 1)"), F.lit(",},\n}\n```"))
    return e.select("event_id", F.get_json_object(T.repaired_json(T.json_span(broken)), "$.a.k").cast("long").alias("k"))


@query('''SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'e' || doc_id END AS id, CASE WHEN doc_id % 4 < 3 THEN source END AS description, CASE WHEN doc_id % 4 = 0 THEN 'e' || doc_id WHEN doc_id % 4 = 1 THEN 'Lab' WHEN doc_id % 4 = 2 THEN 'x,y' END AS label,
CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END AS entities, CASE WHEN doc_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS triplets, doc_id % 4 < 3 AS ok FROM documents''')
def parse_responses(spark, sf):
    '''Responses with trailing commas, without a label, with a single one and with a list; with a graph that breaks off behind its entities; and without any graph.'''
    d = table(spark, sf, "documents")
    label = F.element_at(F.array(F.lit(""), F.lit(', "label": "Lab"'), F.lit(', "label": ["x", "y"]'), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    one = F.concat(F.lit('{"id": "e'), F.col("doc_id").cast("string"), F.lit('", "type": "T", "description": "'), "source", F.lit('"'), label, F.lit('}, {"id": "", "type": "T", "description": "x"}'))
    triplet = F.lit('], "triplets": [{"subject_id": "a", "predicate": "p", "object_id": "b"}, {"subject_id": "", "predicate": "p", "object_id": "b"}],}\n```')
    response = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("nothing found in "), "source")).otherwise(F.concat(F.lit('```json\n{"entities": ['), one, F.when(F.col("doc_id") % 4 == 2, F.lit('], "triplets": []}')).otherwise(triplet)))
    p = ingest.parsed(d.select(F.col("doc_id").alias("id"), response.alias("response")))
    e = F.get("entities", F.lit(0))
    return p.select(F.col("id").alias("doc_id"), e["id"].alias("id"), e["description"].alias("description"), F.array_join(e["label"], ",").alias("label"), F.size("entities").alias("entities"), F.size("triplets").alias("triplets"), "ok")


@query("SELECT doc_id AS id, doc_id % 5 AS attempt, CAST(5 AS BIGINT) AS attempts FROM documents WHERE doc_id % 5 < 4")
def retry_ladder(spark, sf):
    '''Five recorded attempts a chunk, of which those from doc_id % 5 on give an entity, if that is below 4: the first of them counts.'''
    good = F.concat(F.lit('{"entities": [{"id": "e", "type": "T", "description": "d'), F.col("attempt").cast("string"), F.lit('"}], "triplets": []}'))
    tries = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("attempt"))
    ok = (F.col("id") % 5 < 4) & (F.col("attempt") >= F.col("id") % 5)
    found, _ = ingest.first_success(tries.withColumn("response", F.when(ok, good).otherwise("retry in 2.5 s")))
    return found.select("id", "attempt", "attempts")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', '_', 'g'), '^\s+|\s+$', '', 'g') AS option FROM documents")
def clean_options(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "_").alias("t"))
    mark = F.element_at(F.array(*[F.lit(m) for m in ("(A) ", "b. ", "C) ", "D: ", "A - ")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", T.option_text(F.concat(mark, "t")).alias("option"))


@query("SELECT o_orderkey, o_orderpriority LIKE '1%' AS truth FROM orders")
def truth_tokens(spark, sf):
    token = F.when(F.col("o_orderpriority").startswith("1"), F.element_at(F.array(F.lit(" yes"), F.lit("Đ"), F.lit("true"), F.lit("Tx")), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", T.truth(token).alias("truth"))


@query("SELECT o_orderkey, array_to_string((['T','F','T','F','F'])[1:CAST(o_orderkey % 5 + 1 AS INT)], '') AS v FROM orders")
def answer_vector(spark, sf):
    given = F.element_at(F.array(F.lit("T,F, T"), F.lit("t f t"), F.lit("TFT")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(T.answer_vector(given, (F.col("o_orderkey") % 5 + 1).cast("int")), "").alias("v"))


@query("""SELECT doc_id AS id, array_to_string(list_transform(range(1, CAST(2 + doc_id % 4 AS INT) + 1), lambda k: 'o' || k || '=' || CASE WHEN k = 2 THEN 'true' ELSE 'false' END), ',') AS options FROM documents WHERE 2 + doc_id % 4 BETWEEN 3 AND 4""")
def mc_filter(spark, sf):
    n = (F.col("doc_id") % 4 + 2).cast("int")
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.char(k + 64), F.lit(". o"), k.cast("string"))).alias("options"), F.lit("b").alias("correct"))
    pairs = F.transform("options", lambda o: F.concat(o["answer"], F.lit("="), o["isCorrect"].cast("string")))
    return ingest.multiple_choice(items).select("id", F.array_join(pairs, ",").alias("options"))


@query(r'''WITH b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS m FROM benchmark)
SELECT item_id AS id, CAST(k AS INT) AS k, CASE WHEN m <> '' AND k < 3 THEN m || ' Phát biểu sau: "s' || k || '" là đúng hay sai' WHEN m <> '' THEN m || ' là đúng hay sai' WHEN k < 3 THEN 'Phát biểu sau: "s' || k || '" là đúng hay sai' ELSE 'Phát biểu sau là đúng hay sai' END AS question,
k % 2 = 0 AND k < 3 AS is_true, 'Đúng=' || (k % 2 = 0 AND k < 3) || ',Sai=' || (NOT (k % 2 = 0 AND k < 3)) AS options FROM b, range(0, 4) t(k)''')
def tf_explode(spark, sf):
    '''With and without a main question, with and without a statement; statements begin with a letter mark, and name the textbook.'''
    main = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" (theo Sách giáo khoa)"))).otherwise("")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), main.alias("main"), F.array(*[F.lit(f"{'abc'[k]}) s{k} (sach giao khoa)") for k in range(3)], F.lit(" d. ")).alias("subs"), F.lit("T,F,T").alias("corrects"))
    return ingest.true_false(b).withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["answer"], F.lit("="), o["isCorrect"].cast("string"))), ","))


@query(f"""WITH {ENTITIES}, {TRIPLETS}, d AS (SELECT subject_id, predicate, object_id, min(seq) AS seq FROM t GROUP BY ALL)
SELECT ':' || replace(id, ' ', '_') || ' a :' || type || ' ;' AS value FROM e UNION ALL SELECT '  :label "' || id || '"@vi ;' FROM e UNION ALL SELECT '  :description "' || description || '"@vi .' FROM e UNION ALL SELECT '' FROM e
UNION ALL SELECT ':' || replace(subject_id, ' ', '_') || ' :' || replace(predicate, ' ', '_') || ' :' || replace(object_id, ' ', '_') || ' .' FROM d""")
def ttl_lines(spark, sf):
    g = star.graph(spark, sf)
    return graph.turtle_lines(graph.KnowledgeGraph(g.entities, graph.dedup_triplets(g.triplets))).select("value")


def question_set(spark, sf):
    '''A multiple-choice and a true-or-false question about a nation for each benchmark item; of five multiple-choice questions one has no right option.'''
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("i"), "text")
    nation = lambda k: F.concat(F.lit("NATION_"), ((F.col("i") + k) % 25).cast("string"))
    options = F.array(*[F.struct(nation(k).alias("answer"), (F.col("i") % 5 == k).alias("isCorrect")) for k in range(4)])
    mc = b.select(F.lit("multiple_choice").alias("q_type"), (F.col("i") + 1).alias("id"), F.concat(F.lit("Where is "), nation(1), F.lit(" of "), "text").alias("question"), options.alias("options"))
    tf = ingest.true_false(b.select(F.col("i").alias("id"), F.col("text").alias("main"), F.array(nation(0)).alias("subs"), F.when(F.col("i") % 2 == 0, "T").otherwise("F").alias("corrects")))
    return mc.union(tf.select(F.lit("true_false"), F.col("id") + 1, "question", "options"))


def evaluation(spark, sf):
    return evaluate.evaluated(question_set(spark, sf), star.entities(spark, sf))


EVALUATED = rf'''{ENTITIES},
b AS (SELECT item_id AS i, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS main FROM benchmark),
asked AS (
  SELECT 'multiple_choice' AS q_type, i + 1 AS id, 'Where is NATION_' || (i + 1) % 25 || ' of ' || text AS question, 'Where is NATION_' || (i + 1) % 25 || ' of ' || text AS asked,
    list_transform(range(0, 4), lambda k: 'NATION_' || (i + k) % 25) AS options, CASE WHEN i % 5 < 4 THEN i % 5 + 1 ELSE 0 END AS spot FROM b
  UNION ALL SELECT 'true_false', i + 1, main || ' Phát biểu sau: "NATION_' || i % 25 || '" là đúng hay sai', 'NATION_' || i % 25 || '"', ['Đúng', 'Sai'], CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END FROM b
),
query AS (SELECT q_type, a.id, any_value(asked) || ' ' || coalesce(string_agg(name, ' ' ORDER BY seq), '') AS query FROM asked a LEFT JOIN e ON contains(lower(asked), lower(name)) WHERE spot > 0 GROUP BY ALL),
w AS (SELECT q_type, id, unnest(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: length(x) > 2)) AS w FROM query),
counted AS (SELECT q_type, id, w, count(*) AS n FROM w GROUP BY ALL),
scored AS (SELECT q_type, c.id, e.seq, e.name, sum(n * (2 * CAST(contains(lower(description), w) AS INT) + CAST(contains(lower(name), w) AS INT))) AS score FROM counted c, e WHERE contains(lower(description), w) OR contains(lower(name), w) GROUP BY ALL),
top AS (SELECT q_type, id, name, row_number() OVER (PARTITION BY q_type, id ORDER BY score DESC, seq) AS rank FROM scored QUALIFY rank <= 5),
context AS (SELECT a.q_type, a.id, coalesce(string_agg(name, chr(10) || chr(10) ORDER BY rank), '{T.NOTHING_FOUND}') AS context FROM asked a LEFT JOIN top USING (q_type, id) WHERE spot > 0 GROUP BY ALL),
said AS (SELECT a.*, context, list_transform(options, lambda o: len(list_filter(regexp_split_to_array(lower(o), '\s+'), lambda w: length(w) > 3 AND contains(lower(context), w)))) AS s FROM asked a JOIN context USING (q_type, id)),
r AS (SELECT *, CASE WHEN list_max(s) > 0 THEN chr(CAST(64 + list_position(s, list_max(s)) AS INT)) ELSE 'A' END AS predicted, CASE WHEN q_type = 'true_false' AND spot > 1 THEN 'B' ELSE chr(CAST(64 + spot AS INT)) END AS correct FROM said),
marks AS (SELECT *, array_to_string(list_transform(range(1, len(options) + 1), lambda k: chr(CAST(64 + k AS INT)) || '. ' || options[k] || CASE WHEN k = spot AND chr(CAST(64 + k AS INT)) = predicted THEN '(correct, predicted)' WHEN k = spot THEN '(correct)' WHEN chr(CAST(64 + k AS INT)) = predicted THEN '(predicted)' ELSE '' END), '|') AS options_ FROM r)'''
ONE = "SELECT id, question, options_ AS options, predicted, correct, predicted = correct AS is_correct, CASE WHEN predicted = correct THEN 'correct' ELSE 'wrong' END AS status, context, CAST(length(context) AS INT) AS context_length, predicted AS response, 'direct_match' AS method, 1.0::DOUBLE AS confidence FROM marks"


def of_type(results, q_type):
    options = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(". "), o["text"], o["marker"])), "|")
    return results.where(F.col("q_type") == q_type).select("id", "question", options.alias("options"), "predicted", "correct", "is_correct", "status", "context", "context_length", "response", "method", "confidence")


@query(f"WITH {EVALUATED} {ONE} WHERE q_type = 'multiple_choice'")
def evaluate_mc(spark, sf):
    return of_type(evaluation(spark, sf)[0], "multiple_choice")


@query(f"WITH {EVALUATED} {ONE} WHERE q_type = 'true_false'")
def evaluate_tf(spark, sf):
    return of_type(evaluation(spark, sf)[0], "true_false")


@query(f'''WITH {EVALUATED}, x AS (SELECT a.q_type, coalesce(predicted = correct, false) AS good, predicted IS NOT NULL AND predicted <> correct AS bad FROM asked a LEFT JOIN r USING (q_type, id))
SELECT coalesce(q_type, 'overall') AS q_type, count(*) AS total, CAST(sum(good::INT) AS BIGINT) AS correct, CAST(sum(bad::INT) AS BIGINT) AS wrong, 0::BIGINT AS no_prediction, round(sum(good::INT) / count(*) * 100, 6) AS accuracy, 100.0::DOUBLE AS prediction_rate FROM x GROUP BY ROLLUP (q_type)''')
def evaluate_overall(spark, sf):
    return evaluate.totals(*evaluation(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
