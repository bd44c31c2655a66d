"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Space: every word of the examples is a coordinate (words that no example has aren't, as is usual); a document's weight in it is (1 + ln tf) * idf, the document
frequency counted over the whole table, and vectors have unit length. Words whose presence goes with the label (chi-square at least CHI2, in at least LEAST_DF
examples; of near copies by SimHash one counts, or a text copied often would make its rare words look telling) keep that weight; all others are multiplied by
the one of OTHERS that gives held-out examples the least log loss. 1.0, plain TF-IDF, is among those that are tried; see the README for what it gives.

Fit, on a bounded sample of labelled documents (SAMPLE rows of `labels`, the least by a seeded hash of doc_id): one distinct example in HOLD, HELD at most,
is held out to choose the factor and to calibrate; then every example is indexed.

Search: examples are ordered so that alike ones share a block of BLOCK. A word of few examples has a plain posting list, a word of many (over a COMMON-th of them) has its weights
by block and the largest of each block. A query adds up its plain lists, bounds each block by its best sum so far plus the block maxima of the common
words, takes blocks by falling bound, and passes over those whose bound is below its K-th best similarity, so the K nearest are exact (ties: the example that is
first in the index). Queries of a batch that want the same block are multiplied with it together.

Vote: sum of similarities of toxic neighbours over the sum of all, with PRIOR_WEIGHT of the base rate added; isotonic regression on the
held-out examples turns the vote into a probability; `toxic` is a probability of at least 0.5. The evidence lists the neighbours.

Defined results: a null or empty text, or one without any word of the examples, has no neighbours, an empty evidence list and the calibrated base rate; a null doc_id stays; repeated
rows are scored each; without usable labels every score is null and nothing is toxic; labels with a null doc_id or a label
other than 0 and 1 are passed over, and of contradicting labels of one document 1 counts; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _shared as S
from graphloom.llm.op05_simhash import BUDGET, fingerprints

SAMPLE, HOLD, HELD, LEAST_DF, CHI2 = 10000, 4, 1000, 5, 30.0
K, BLOCK, COMMON, PRIOR_WEIGHT, CUT, SEED = 10, 32, 24, 0.1, 0.5, 17
OTHERS = (1.0, 0.3, 0.1)
#: Queries that are worked off together; how many blocks, by falling bound, each has seen after each round; what rounding may do to a sum.
TOGETHER, ROUNDS, SLACK = 128, (4, 16, 64), 4e-6

_LETTER = np.zeros(256, bool)
_LETTER[[*b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of word characters: ASCII letters, digits, _, and all beyond ASCII but U+0080-00BF, U+2000-206F and U+3000-303F (signs and spaces)."""
    ok, n = _LETTER[data], len(data)
    at = np.flatnonzero(data == 0xC2)
    ok[at], ok[np.minimum(at + 1, n - 1)] = False, False
    at = np.flatnonzero((data == 0xE2) | (data == 0xE3))
    at = at[at + 2 < n]
    a, b, c = data[at], data[at + 1], data[at + 2]
    at = at[(a == 0xE2) & ((b == 0x80) | (b == 0x81) & (c <= 0xAF)) | (a == 0xE3) & (b == 0x80)]
    for k in range(3):
        ok[at + k] = False
    return ok


def counted(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: their hashes (48 bits) and counts, row by row in order of hash, and where each row begins (one more entry at the end)."""
    words, counts, rows, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    low = pc.utf8_lower(text)
    while at < len(low):
        n = max(1, int(np.searchsorted(np.cumsum(S.lengths(low.slice(at, 4096))), 500_000, side="right")))  # what stays in cache
        data, starts = S.bytes_of(low.slice(at, n))
        if len(data):
            begin, end, row = S.words(data, starts, letters(data))
            key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (S.word_hashes(data, begin, end) >> np.uint64(16)))
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            words.append(key[new] & np.uint64((1 << 48) - 1))
            counts.append(np.diff(np.append(new, len(key))))
            rows.append((key[new] >> np.uint64(48)).astype(np.int64) + at)
        at += n
    return np.concatenate(words), np.concatenate(counts).astype(np.int32), np.searchsorted(np.concatenate(rows), np.arange(len(text) + 1))


def chi2(df1: np.ndarray, df: np.ndarray, n1: int, n: int) -> np.ndarray:
    """Chi-square of presence against label; df1: toxic examples with the word."""
    a, b = df1.astype(float), (df - df1).astype(float)
    c, d = n1 - a, (n - n1) - b
    low = (a + b) * (c + d) * n1 * (n - n1)
    return np.where(low > 0, n * (a * d - b * c) ** 2 / np.maximum(low, 1), 0.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: both ends of each pool, and its value at each; between pools one goes straight."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, y) / weight
    pools: list[list[float]] = []
    for at, w, v in zip(xs, weight, value, strict=True):
        pools.append([at, at, w, v])
        while len(pools) > 1 and pools[-2][3] >= pools[-1][3]:
            _, end, w2, v2 = pools.pop()
            pools[-1][3] = (pools[-1][3] * pools[-1][2] + v2 * w2) / (pools[-1][2] + w2)
            pools[-1][1], pools[-1][2] = end, pools[-1][2] + w2
    return np.array([e for p in pools for e in p[:2]]), np.array([p[3] for p in pools for _ in range(2)])


@dataclass
class Example:
    doc_id: int
    label: int
    words: np.ndarray
    counts: np.ndarray


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., one run of `size` after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def alike_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in an order that keeps alike ones together: halved along the widest axis, down to `leaf` rows."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf or not x.shape[1]:
            out.append(rows)
            continue
        rows = rows[np.argsort(x[rows, np.argmax(np.ptp(x[rows], axis=0))], kind="stable")]
        half = -(-len(rows) // leaf // 2) * leaf  # a whole number of leaves
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Block-max inverted index over the examples' unit vectors."""

    words: np.ndarray  # hashes, in order
    gain: np.ndarray  # idf, by what the word tells
    ids: np.ndarray
    labels: np.ndarray
    first: np.ndarray  # (words + 1): where each word's plain postings begin
    example: np.ndarray
    weight: np.ndarray
    common: np.ndarray  # number of a common word, or -1
    dense: np.ndarray  # (blocks, common words, BLOCK)
    block_max: np.ndarray  # (common words, blocks)
    rate: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and unit-length weights of a text's distinct words."""
        if not len(self.words) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0)
        t = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[t] == words
        t, w = t[known], (1 + np.log(counts[known])) * self.gain[t[known]]
        norm = float(np.sqrt((w * w).sum()))
        return (t, w / norm) if norm > 0 else (t[:0], w[:0])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query vector the similarities and examples of the k nearest with a similarity above 0: exact; ties to the first example."""
        for at in range(0, len(queries), TOGETHER):
            yield from self._nearest(queries[at : at + TOGETHER], k)

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, blocks = len(queries), len(self.dense)
        plain, q = np.zeros((n, blocks * BLOCK)), np.zeros((n, self.block_max.shape[0]), np.float32)
        for i, (t, w) in enumerate(queries):
            c = self.common[t]
            rare = c < 0
            size = self.first[t[rare] + 1] - self.first[t[rare]]
            at = gather(self.first[t[rare]], size)
            plain[i] = np.bincount(self.example[at], self.weight[at] * np.repeat(w[rare], size), blocks * BLOCK)
            q[i, c[~rare]] = w[~rare]
        score = plain.astype(np.float32).reshape(n, blocks, BLOCK)
        bound = score.max(2, initial=0) + q @ self.block_max
        order = np.argsort(-bound, 1, kind="stable")
        place = np.argsort(order, 1, kind="stable")
        least, seen, done = np.zeros(n, np.float32), 0, np.zeros((n, blocks), bool)
        for most in (*ROUNDS, blocks):
            todo = (place >= seen) & (place < most) & (bound >= least[:, None] - SLACK) & (bound > 0)
            for b in np.flatnonzero(todo.any(0)):
                rows = np.flatnonzero(todo[:, b])
                score[rows, b] += q[rows] @ self.dense[b]
            done |= todo
            seen = most
            if most < blocks and most * BLOCK >= k:
                own = score[np.arange(n)[:, None], order[:, :most]].reshape(n, -1)
                least = np.maximum(least, np.partition(own, -k, axis=1)[:, -k])
        for i, (t, w) in enumerate(queries):
            near = np.flatnonzero((score[i] >= max(least[i] - SLACK, 1e-12)) & done[i, :, None])
            if len(near) > k:
                flat = score[i].ravel()[near]
                near = near[flat >= np.partition(flat, -k)[-k] - SLACK]
            c = self.common[t]
            sims = np.round(plain[i, near] + self.dense[near // BLOCK, :, near % BLOCK][:, c[c >= 0]] @ w[c >= 0], 9)
            best = np.lexsort((near, -sims))[:k]
            yield sims[best], near[best]

    def vote(self, sims: np.ndarray, found: np.ndarray) -> float:
        return float((PRIOR_WEIGHT * self.rate + sims @ self.labels[found]) / (PRIOR_WEIGHT + sims.sum()))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.steps, self.levels))

    def judged(self, text: pa.Array) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """(score, similarities, examples) of each text."""
        words, counts, edge = counted(text)
        for sims, found in self.nearest([self.vector(words[a:b], counts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]):
            yield self.calibrated(self.vote(sims, found)) if len(self.levels) else None, sims, found

    def judge(self, text: str | None) -> tuple[float | None, np.ndarray, np.ndarray]:
        return next(self.judged(pa.array([text or ""])))


def vocabulary(examples: list[Example]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(e.words for e in examples)]))


def telling(examples: list[Example], words: np.ndarray) -> np.ndarray:
    """Which words' presence goes with the label."""
    n, n1 = len(examples), sum(e.label for e in examples)
    df, df1 = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for e in examples:
        at = np.searchsorted(words, e.words)
        df[at] += 1
        df1[at] += e.label
    return (df >= LEAST_DF) & (chi2(df1, df, n1, n) >= CHI2)


def indexed(examples: list[Example], words: np.ndarray, gain: np.ndarray) -> Index:
    none = np.zeros(0, np.int64)
    index = Index(words, gain, none, none, np.zeros(len(words) + 1, np.int64), none, np.zeros(0), np.full(len(words), -1, np.int32), np.zeros((0, 0, BLOCK), np.float32), np.zeros((0, 0), np.float32))
    rows, of, parts = [], [], []
    for e in examples:
        t, w = index.vector(e.words, e.counts)
        if len(t):
            rows.append(e)
            of.append(t.astype(np.int32))
            parts.append(w.astype(np.float32))
    n = len(rows)
    e = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in of])
    t, w = np.concatenate([np.zeros(0, np.int32), *of]), np.concatenate([np.zeros(0, np.float32), *parts])
    del of, parts
    many = np.flatnonzero(np.bincount(t, minlength=len(words)) > max(BLOCK, n // COMMON))
    index.common[many] = np.arange(len(many))
    is_common = index.common[t] >= 0
    flat = np.zeros((len(many), n), np.float32)
    flat[index.common[t[is_common]], e[is_common]] = w[is_common]
    axis = np.linalg.eigh(flat @ flat.T)[1][:, ::-1][:, :8] if len(many) else np.zeros((0, 0), np.float32)
    order = alike_order(flat.T @ axis, BLOCK)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    blocks = -(-n // BLOCK)
    index.dense = np.zeros((blocks, len(many), BLOCK), np.float32)
    for b in range(blocks):
        own = flat[:, order[b * BLOCK : (b + 1) * BLOCK]]
        index.dense[b, :, : own.shape[1]] = own
    del flat
    index.block_max = np.ascontiguousarray(index.dense.max(2).T)
    t, e, w = t[~is_common], place[e[~is_common]], w[~is_common]
    by = np.argsort(t.astype(np.int64) * max(1, n) + e)
    index.first, index.example, index.weight = np.searchsorted(t[by], np.arange(len(words) + 1)), e[by], w[by]
    index.ids, index.labels = np.array([rows[k].doc_id for k in order], np.int64), np.array([rows[k].label for k in order], float)
    index.rate = sum(x.label for x in examples) / max(1, len(examples))
    return index


def build(examples: list[Example], distinct: list[int], words: np.ndarray, df: np.ndarray, n_docs: int) -> Index:
    """The index over all examples, its factor and its votes calibrated on some of the distinct ones that it then didn't hold."""
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    own = [examples[k] for k in distinct]
    if len(own) < HOLD or not 0 < sum(e.label for e in own) < len(own):
        return indexed([], words, idf)
    tells = telling(own, words)
    held = own[HOLD - 1 :: HOLD][:HELD]
    rest = [e for k, e in enumerate(own) if k % HOLD != HOLD - 1 or k // HOLD >= HELD]
    truth, best = np.array([e.label for e in held], float), (np.inf,)
    for other in OTHERS:
        trial = indexed(rest, words, np.where(tells, idf, np.float32(other) * idf))
        votes = np.array([trial.vote(*found) for found in trial.nearest([trial.vector(e.words, e.counts) for e in held])])
        trial.steps, trial.levels = isotonic(votes, truth)
        sure = np.clip([trial.calibrated(v) for v in votes], 1e-3, 1 - 1e-3)
        loss = float(-(truth * np.log(sure) + (1 - truth) * np.log(1 - sure)).mean())
        if loss < best[0]:
            best = loss, trial.gain, trial.steps, trial.levels
        del trial  # one index at a time
    index = indexed(examples, words, best[1])
    index.steps, index.levels = best[2:]
    return index


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in S.slices(batches, "text", 8_000_000):
        words, counts, edge = counted(b.column(2))
        fp = fingerprints(*S.bytes_of(pc.utf8_lower(b.column(2))))[0].view(np.int64)
        packed = [pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in range(b.num_rows)], pa.binary()) for x in (words, counts)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(fp), pa.list_(pa.int64())), *packed], names=["doc_id", "label", "fp", "words", "counts"])


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(doc_id, label, text) of the documents that the sampled labels name; at most `most` labels, so it is broadcast."""
    clean = labels.select(F.col("doc_id").cast("long").alias(f"{S.OWN}id"), F.col(label).cast("int").alias(f"{S.OWN}y")).where(f"{S.OWN}id is not null and {S.OWN}y in (0, 1)")
    few = clean.groupBy(f"{S.OWN}id").agg(F.max(f"{S.OWN}y").alias(f"{S.OWN}y")).orderBy(F.xxhash64(f"{S.OWN}id", F.lit(SEED)), f"{S.OWN}id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias(f"{S.OWN}id"), F.col("text").alias("text")).where("text is not null")
    return own.join(F.broadcast(few), f"{S.OWN}id").select(F.col(f"{S.OWN}id").alias("doc_id"), F.col(f"{S.OWN}y").alias("label"), "text")


def distinct(fp: np.ndarray) -> list[int]:
    """The first row of each set of near copies; the sample is bounded, so pairs are compared here."""
    kept, at = np.zeros_like(fp), []
    for k in range(len(fp)):
        if not at or (np.bitwise_count(kept[: len(at)] ^ fp[k]).sum(1) > BUDGET).all():
            kept[len(at)] = fp[k]
            at.append(k)
    return at


def frequencies(docs: DataFrame, words: np.ndarray, piece: int = 8192) -> tuple[np.ndarray, int]:
    """Document frequency of each of the words, and the number of documents, over the whole table. Each task adds up its own in an array; pieces of those arrays are added up by Spark."""
    pieces = max(1, -(-len(words) // piece))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(pieces * piece, np.int64), 0
        for b in S.slices(batches, "text", 8_000_000):
            n += b.num_rows
            h = counted(b.column(0))[0]
            if len(words) and len(h):
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                df += np.bincount(at[words[at] == h], minlength=len(df))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces)), pa.array([x.tobytes() for x in df.reshape(pieces, -1).astype(np.int32)], pa.binary()), pa.array(np.where(np.arange(pieces) == 0, n, 0))], names=["piece", "df", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for k, x, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                own = total.setdefault(k, [np.zeros(piece, np.int64), 0])
                own[0] += np.frombuffer(x, np.int32)
                own[1] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x, _ in total.values()], pa.binary()), pa.array([n for _, n in total.values()], pa.int64())], names=["piece", "df", "n"])

    schema = "piece long, df binary, n long"
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, schema).repartition("piece").mapInArrow(add, schema).toArrow().to_pylist()
    df = np.zeros(pieces * piece, np.int64)
    for r in found:
        df[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["df"], np.int64)
    return df[: len(words)], sum(r["n"] for r in found)


def distinct(fp: np.ndarray) -> list[int]:
    """The first row of each set of near copies; the sample is bounded, so pairs are compared here."""
    kept, at = np.zeros_like(fp), []
    for k in range(len(fp)):
        if not at or (np.bitwise_count(kept[: len(at)] ^ fp[k]).sum(1) > BUDGET).all():
            kept[len(at)] = fp[k]
            at.append(k)
    return at


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Index:
    S.ship(docs.sparkSession)
    rows = sample(docs, labels, "toxic", most).mapInArrow(_examples, "doc_id long, label int, fp array<long>, words binary, counts binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["fp"]))
    rows = [rows[k] for k in np.random.default_rng(SEED).permutation(len(rows))]
    examples = [Example(r["doc_id"], r["label"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in rows]
    once = distinct(np.array([r["fp"] for r in rows], np.int64).reshape(-1, 4).view(np.uint64))
    words = vocabulary(examples)
    return build(examples, once, words, *frequencies(docs, words))


EVIDENCE = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))


def _scorer(sent: Broadcast[Index]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in S.slices(batches, "text"):
            scores, sims, found = zip(*index.judged(b.column(1)), strict=True)
            edge = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            at = np.concatenate(found)
            inner = pa.StructArray.from_arrays([pa.array(index.ids[at]), pa.array(np.concatenate(sims)), pa.array(index.labels[at].astype(np.int32))], fields=list(EVIDENCE.value_type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([p is not None and p >= CUT for p in scores]), pa.ListArray.from_arrays(edge, inner)], names=["doc_id", "score", "toxic", "evidence"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, score, toxic, evidence (the nearest examples with similarity and label)."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # as large as SAMPLE texts at most; a worker holds it once, and not as part of the code
    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return skinny.mapInArrow(_scorer(index), "doc_id long, score double, toxic boolean, evidence array<struct<example: long, similarity: double, label: int>>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones; columns as they came. One pass after the fit, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in S.slices(batches, "text"):
            clean = [p is None or p < CUT for p, _, _ in index.judged(pc.fill_null(b.column(b.schema.get_field_index("text")), ""))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"))
