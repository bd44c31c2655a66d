import functools
import hashlib
import random

import pyarrow as pa

import corpus_pipeline as P
from graphloom.llm import op02_toxicity, op03_bpe, op05_simhash, op07_mixing
from tests.llm.common import awkward, docs_of
from tests.llm.test_op02_toxicity import corpus
from tests.llm.test_op05_simhash import brute, far_apart_family, union_find


def test_stages_keep_the_columns_and_run_over_all_rows(spark, tmp_path):
    texts, toxic = corpus(random.Random(6), 300)
    texts += texts[100:110] + ["mail me at jo@example.org or call +49 170 1234567 " + texts[121]]
    docs = docs_of(spark, texts).drop("extra")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    # stage by stage over collected rows, by brute force where the operators don't: all pairs of fingerprints, clamps one after another, masks by hand
    index = op02_toxicity.fit(docs, labels)
    rows = docs.collect()
    scored = list(index.judged(pa.array([r["text"] or "" for r in rows])))
    rows = [r for r, (p, _, _) in zip(rows, scored, strict=True) if p is None or p < op02_toxicity.CUT]
    assert 230 <= len(rows) <= 255 and sum(toxic[r["doc_id"]] for r in rows if r["doc_id"] < 300) <= 3
    fp = op05_simhash.fingerprints(*op05_simhash.S.bytes_of(pa.array([r["text"].lower() for r in rows])))[0]
    group = union_find(range(len(rows)), brute(fp, op05_simhash.BUDGET))
    first = {g: min(rows[k]["doc_id"] for k in group if group[k] == g) for g in set(group.values())}
    gone = {rows[k]["doc_id"] for k, g in group.items() if rows[k]["doc_id"] != first[g]}
    assert gone >= {300 + k for k in range(10) if not toxic[100 + k]}
    masks = [("jo@example.org", "[EMAIL]"), ("+49 170 1234567", "[PHONE]")]
    rows = [(r["doc_id"], functools.reduce(lambda t, m: t.replace(*m), masks, r["text"]), r["source"]) for r in rows if r["doc_id"] not in gone]
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t)
    open_, left, epochs = dict.fromkeys(size), op07_mixing.BUDGET * sum(size.values()), {}
    while open_:  # clamp whoever passes the cap, give the rest to the others, again
        total = sum(size[s] ** op07_mixing.ALPHA for s in open_)
        over = [s for s in open_ if left * size[s] ** op07_mixing.ALPHA / total >= op07_mixing.MOST_EPOCHS * size[s]]
        if not over:
            epochs |= {s: left * size[s] ** op07_mixing.ALPHA / total / size[s] for s in open_}
            break
        for s in over:
            epochs[s] = op07_mixing.MOST_EPOCHS
            left -= op07_mixing.MOST_EPOCHS * size[s]
            del open_[s]
    want = []
    for i, t, s in rows:
        u = int(hashlib.md5(f"{op07_mixing.SEED}|{i}".encode()).hexdigest()[:8], 16) / 2**32
        want += [(i, t)] * (int(epochs[s]) + (u < epochs[s] % 1))
    out = P.run(spark, str(tmp_path))
    assert sorted(map(tuple, op03_bpe.decoded(out).collect())) == sorted(want)
    assert out.where("not round_trip").isEmpty()
    assert not any("jo@example.org" in t for _, t in map(tuple, op03_bpe.decoded(out).collect()))


def test_near_duplicate_stage_loses_no_pair(spark, monkeypatch):
    """Many pairs differ in the whole budget; of each group by brute force the row with the least doc_id stays, and no other goes."""
    fp = far_apart_family(3, 300)
    docs = docs_of(spark, [f"text {k}" for k in range(len(fp))])
    by_id = spark.createDataFrame([(k, *map(int, f)) for k, f in enumerate(fp.view("int64"))], f"{op05_simhash.ID} long, " + ", ".join(f"{c} long" for c in op05_simhash.FP))
    text = docs.selectExpr(f"doc_id as {op05_simhash.ID}", f"xxhash64(text) as {op05_simhash.TH}")
    monkeypatch.setattr(op05_simhash, "signatures", lambda _: text.join(by_id, op05_simhash.ID))
    group = union_find(range(len(fp)), brute(fp, op05_simhash.BUDGET))
    assert len(set(group.values())) == 900
    kept = [r["doc_id"] for r in P.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(group.values()))


def test_near_duplicate_stage_takes_rows_that_no_id_names(spark):
    """Rows without doc_id are near duplicates of others and of each other; unlike texts of one doc_id are none."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcd")
    rows = [(7, a), (None, a), (None, a.replace("a5 ", "other ")), (3, a.upper()), (None, b), (None, b), (None, b + " more"), (5, c), (5, d), (6, d + " more"), (None, "  "), (None, "  "), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    kept = {r["n_chars"] for r in out.collect()}
    assert len(kept & {4, 5, 6}) == 1 and kept - {4, 5, 6} == {3, 7, 8, 10, 11, 12}


def test_stages_one_by_one_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.where("false")):
        for name, stage in P.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert name == P.STAGES[-1][0] or out.columns == docs.columns
            assert (out.count() == 0) == rows.isEmpty()
    assert [len(P.STAGES), P.ORACLE_SQL] == [5, None]
