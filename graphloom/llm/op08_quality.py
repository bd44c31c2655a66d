"""Quality rules by an isolation forest: path lengths over random splits of rule statistics, thresholds from labelled rows.

Statistics (all shares, so that long texts are no anomaly by length): see RULES. Counts are shrunk toward 0 by SHRINK words, so that
a few odd words in a short text weigh little. Digits are no rule: numbers are rare without being bad, and would use up the short paths.

Fit, on every labelled document: they are numbered, and each of TREES trees is grown over GROUP rows (that is the method: a tree sees so few, and
no labels) drawn by number from all of them, none a second time while there are others; it is split at random between the least and the largest value of a random statistic that varies.
The score is 2^(-mean path / c(GROUP)). The threshold is the one with the best F1 for the label 0 among those that reject at most FALSE_ALARM of the rows labelled 1, over all
labelled rows and each of their scores as a cut; scores are added up by bins of their value, so no task has them all. Every document is scored by its whole text, and each text is
read once: the statistics are written.

Defined results: null, empty and white-space-only texts have no score and are not kept (empty = true); a null doc_id stays; repeated rows are scored each;
without usable labels of both kinds every score is null and every text with words is kept; labels with a null doc_id or other than 0 and 1
are passed over, and of contradicting labels of one document 1 counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

TREES, GROUP, SEED, FALSE_ALARM, SHRINK = 200, 256, 23, 0.003, 6.0
#: Parts in which rows are numbered, and bins of scores.
BINS = 4096
RULES = ["symbols_per_word", "bars_per_word", "shouts_per_word", "upper_share", "repeat_share", "top_word_share", "repeated_line_share"]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _BAR, _SHOUT = _table(b"#$%&*@^~_=+<>{}[]\\"), _table(b"|"), _table(b"!?")
_UPPER, _LOWER = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))


def statistics(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rules) and the number of words of each row."""
    rows = len(starts) - 1
    begin, end, row = S.words(data, starts)
    n = np.bincount(row, minlength=rows)
    out = np.zeros((rows, len(RULES)))
    if not len(begin):
        return out, n

    def count(table: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(table[data])])
        return (run[starts[1:]] - run[starts[:-1]]).astype(float)

    low = n + SHRINK
    letters = count(_UPPER) + count(_LOWER)
    out[:, 0], out[:, 1], out[:, 2] = count(_SYMBOL) / low, count(_BAR) / low, count(_SHOUT) / low
    out[:, 3] = count(_UPPER) / (letters + 5 * SHRINK)
    h = S.word_hashes(data, begin, end)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])
    out[:, 4] = np.bincount(row, same, rows) / low
    edge = np.concatenate([[0], np.cumsum(n)])
    # lines: a hash for each run of words up to a line end
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[begin]
    turn = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
    with np.errstate(over="ignore"):
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(turn, np.diff(np.append(turn, len(h)))).astype(np.uint64)
        lines = np.add.reduceat(S.mix(h + place), turn)
    words_of = np.diff(np.append(turn, len(h)))
    line_edge = np.searchsorted(turn, edge)
    for i in np.flatnonzero(n):
        _, c = np.unique(h[edge[i] : edge[i + 1]], return_counts=True)
        out[i, 5] = c.max() / low[i]
        a, b = line_edge[i], line_edge[i + 1]
        if b - a > 1:
            _, first = np.unique(lines[a:b], return_index=True)
            out[i, 6] = (words_of[a:b].sum() - words_of[a:b][first].sum()) / low[i]
    return out, n


def expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # (trees, nodes); -1 at leaves
    split: np.ndarray
    left: np.ndarray  # right child: left + 1
    length: np.ndarray  # path length at leaves, with what is expected below
    group: int
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, s, child, length in zip(self.feature, self.split, self.left, self.length, strict=True):
            at = np.zeros(len(x), np.int64)
            moving = np.arange(len(x))
            while len(moving):
                node = at[moving]
                inner = f[node] >= 0
                moving, node = moving[inner], node[inner]
                at[moving] = child[node] + (x[moving, f[node]] >= s[node])
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / float(expected(self.group)))


def grow(x: np.ndarray, trees: int = TREES, group: int = GROUP, seed: int = SEED, drawn: list[np.ndarray] | None = None) -> Forest:
    """drawn: the rows of each tree; where absent, they are drawn from x."""
    rng = np.random.default_rng(seed)
    group = min(group, len(x)) if drawn is None else len(drawn[0])
    deepest = int(np.ceil(np.log2(max(group, 2))))
    most = 2 ** (deepest + 1)
    feature, split, left, length = np.full((trees, most), -1), np.zeros((trees, most)), np.zeros((trees, most), np.int64), np.zeros((trees, most))
    for t in range(trees):
        todo, used = [(0, rng.choice(len(x), group, replace=False) if drawn is None else drawn[t], 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            low, high = part.min(0), part.max(0)
            varied = np.flatnonzero(high > low)
            if depth == deepest or len(rows) < 2 or not len(varied):
                length[t, node] = depth + float(expected(len(rows)))
                continue
            k = rng.choice(varied)
            at = rng.uniform(low[k], high[k])
            at = at if at > low[k] else high[k]
            feature[t, node], split[t, node], left[t, node] = k, at, used
            right = part[:, k] >= at
            todo += [(used, rows[~right], depth + 1), (used + 1, rows[right], depth + 1)]
            used += 2
    return Forest(feature, split, left, length, group)


def threshold(scored: DataFrame, false_alarm: float = FALSE_ALARM) -> float:
    """Least rejected score: best F1 for bad rows among cuts that reject at most false_alarm of the good ones (the least of equal ones); scored: (score, label)."""
    each = S.written(scored.groupBy("score").agg(F.sum(F.col("label")).alias("good"), F.sum(1 - F.col("label")).alias("bad")).withColumn("bin", F.floor(F.col("score") * BINS)), "quality-scores")
    total = each.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if total["good"] is None:
        return np.inf
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    bins = each.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select("bin", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in "gb"))
    down = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cuts = each.join(F.broadcast(bins), "bin").select("score", (F.sum("good").over(down) + F.col("g")).alias("wrong"), (F.sum("bad").over(down) + F.col("b")).alias("hit"))
    allowed = cuts.where(F.col("wrong") <= F.lit(false_alarm * total["good"])).withColumn("f1", 2 * F.col("hit") / (F.col("hit") + F.col("wrong") + F.lit(total["bad"])))
    best = allowed.orderBy(F.desc("f1"), "score").first()
    return float(best["score"]) if best else np.inf


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, number of words n, and the statistics of each document. Written."""
    S.ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "text", 8_000_000):
            x, n = statistics(*S.bytes_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x[:, k]) for k in range(len(RULES)))], names=["doc_id", "n", *RULES])

    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return S.written(skinny.mapInArrow(measure, "doc_id long, n long, " + ", ".join(f"{r} double" for r in RULES)), "quality-statistics")


def numbered(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, at, statistics) of every labelled row with words; `at` numbers them from 0 without gaps, in order of doc_id and statistics. Written."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = stats.where("n > 0").join(clean.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
    rows = S.written(rows, "quality-labelled")
    # ranges of doc_id are numbered side by side
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    rows = rows.withColumn("part", F.coalesce(F.width_bucket(F.col("doc_id").cast("double"), F.lit(float(low or 0)), F.lit(float(high or 0) + 1), F.lit(BINS)), F.lit(0)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", *RULES))
    return S.written(rows.withColumn("nth", nth).join(F.broadcast(parts), "part").select("label", (F.col("base") + F.col("nth") - 1).alias("at"), *RULES), "quality-numbered")


def _matrix(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column(r).to_numpy() for r in RULES], 1) if b.num_rows else np.zeros((0, len(RULES)))


def dealt(n: int, trees: int = TREES, group: int = GROUP, seed: int = SEED) -> list[np.ndarray]:
    """The numbers of each tree's rows, of n: no row is drawn a second time as long as there are enough others for a tree."""
    rng, group, out = np.random.default_rng(seed), min(group, n), []
    while len(out) < trees:
        k = min(n // group, trees - len(out))
        out += list(rng.choice(n, k * group, replace=False).reshape(k, group))
    return out


def fit(rows: DataFrame) -> Forest | None:
    """The forest and its threshold; rows: numbered()."""
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if n < 6 or good in (0, n):
        return None
    drawn = dealt(n)
    wanted = np.unique(np.concatenate(drawn))
    numbers = rows.sparkSession.createDataFrame(pa.table({"at": wanted}))
    found = rows.join(F.broadcast(numbers), "at").toArrow().sort_by("at")  # TREES * GROUP rows at most
    forest = grow(_matrix(found), drawn=[np.searchsorted(wanted, d) for d in drawn])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(b)), pa.float64()), b.column(0)], names=["score", "label"])

    forest.threshold = threshold(rows.select("label", *RULES).mapInArrow(score, "score double, label int"))
    return forest


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the rule statistics, score (higher: more anomalous), empty, keep."""
    stats = measured(docs)
    forest = fit(numbered(stats, labels))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            score = forest.score(_matrix(b)) if forest else np.full(len(n), np.nan)
            none = (n == 0) | np.isnan(score)
            keep = (n > 0) & (none | (score < (forest.threshold if forest else np.inf)))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(score, mask=none), pa.array(n == 0), pa.array(keep)], names=["doc_id", *RULES, "score", "empty", "keep"])

    return stats.mapInArrow(judge, "doc_id long, " + ", ".join(f"{r} double" for r in RULES) + ", score double, empty boolean, keep boolean")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "labels"))
