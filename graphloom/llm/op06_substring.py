"""Repeated passages by prefix-partitioned suffix trees over words.

A word is a run of non-white-space; a passage is a run of at least LEAST words that occurs more than once, across or within documents.

Suffixes: not every word begins one. Of every WINDOW = LEAST - PREFIX + 1 consecutive word PREFIX-grams the one of least hash (the last, if
several) begins a suffix; each run of LEAST words holds at least one of those, at the same place in all its occurrences, so no passage is missed.
Suffixes whose first PREFIX words occur once are dropped; the others are sent, with the words around them, to the group of their prefix.

Skew: prefixes are counted after each task has added up its own, and meet their suffixes by a join that adaptive execution splits where a prefix is in a third of all texts; equal
texts are told by their hash, and count as one.

Groups: a group of up to MEMORY suffixes is one subtree: suffixes sorted by their words, internal nodes as intervals of the longest-common-prefix array.
A node whose depth, with the words its leaves share to the left, comes to LEAST or more is a deep node, and a maximal repeat lies around it. A larger
group gets longer prefixes: the LEAST-word windows whose suffix it is, each of which is a deep node as soon as it holds two suffixes; they are spread evenly and counted
in two steps, so a passage in any number of texts is no one task's. Both ways cover
exactly the words of the repeated LEAST-word windows; spans that overlap or touch are one.

Texts that are equal as a whole are one text for the tree, and are repeats from end to end.

Texts of any length are read whole, a text at a time.

Defined results: null texts and texts of fewer than LEAST words have no passage; rows with a null doc_id take no part (nothing names them); repeated rows are
copies of each other; white space between words doesn't count; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

LEAST, PREFIX = 50, 24
#: Most suffixes of a subtree that is built at once; a suffix takes about 500 bytes while it is.
MEMORY = 100_000
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_FACTOR, len(h)), dtype=np.uint64)])
        return S.mix((total[size:] - total[:-size]) * _powers(_INVERSE, n))


def least_of(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each window, by doubling."""
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chosen(gram: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` grams the one that begins a suffix: the least, of equal hashes the last."""
    low = np.uint64((1 << 30) - 1)
    best = least_of((gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64)), window)
    return (low - (best & low)).astype(np.int64)


def starts_of_suffixes(h: np.ndarray, row: np.ndarray, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which suffixes begin, and the hashes of their prefixes; h, row: hash and row of each word."""
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = runs(h, prefix)
    best = chosen(gram, least - prefix + 1)
    at = np.unique(best[row[: len(best)] == row[least - 1 : least - 1 + len(best)]])
    return at, gram[at]


def _first(least: int, prefix: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, f"{S.OWN}text"):
            data, starts = S.bytes_of(b.column(2))
            begin, end, row = S.words(data, starts)
            h = S.word_hashes(data, begin, end)
            at, gram = starts_of_suffixes(h, row, least, prefix)
            edge = np.searchsorted(row, np.arange(b.num_rows))
            r = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array((at - edge[r]).astype(np.int32))], names=["h", "id", "th", "pos"])

    return find


def _counts(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, f"{S.OWN}text", 8_000_000):
            n = np.bincount(S.words(*S.bytes_of(b.column(2)))[2], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int32))], names=["id", "th", "n"]).filter(pa.array(n >= least))

    return count


def _around(least: int, prefix: int):
    """Rows (id, th, text, places: [(pos, h, hot)]) -> suffixes with the words around them; for hot groups one row for each window."""
    side = least - prefix

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, f"{S.OWN}text"):
            data, starts = S.bytes_of(b.column(2))
            begin, end, row = S.words(data, starts)
            h = S.word_hashes(data, begin, end)
            edge = np.searchsorted(row, np.arange(b.num_rows + 1))
            places = b.column(3)
            flat, per = places.flatten(), np.diff(places.offsets.to_numpy())
            r = np.repeat(np.arange(b.num_rows), per)
            at = flat.field("pos").to_numpy().astype(np.int64) + edge[r]
            key, hot = flat.field("h").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            short = (h ^ (h >> np.uint64(32))).astype(np.uint32)
            short[short == 0] = 1
            for k in range(0, len(at), 20_000):
                p, q, f = at[k : k + 20_000], r[k : k + 20_000], hot[k : k + 20_000]
                p, q, keys = p[~f], q[~f], key[k : k + 20_000][~f]
                if len(p):
                    nl, nr = np.minimum(side, p - edge[q]), np.minimum(side, edge[q + 1] - p - prefix)
                    step = np.arange(side)
                    left = np.where(step < nl[:, None], short[np.maximum(p[:, None] - 1 - step, 0)], 0)
                    right = np.where(step < nr[:, None], short[np.minimum(p[:, None] + prefix + step, len(short) - 1)], 0)
                    packed = np.ascontiguousarray(np.concatenate([right, left], 1).astype(np.uint32))
                    width = packed.shape[1] * 4
                    words = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(np.arange(len(p) + 1, dtype=np.int32) * width), pa.py_buffer(packed)])
                    yield _out(keys, b, q, p - edge[q], nl, nr, words)
            p, q = at[hot], r[hot]
            if len(p):
                whole, first = runs(h, least), chosen(runs(h, prefix), side + 1)
                for back in range(side + 1):
                    w = p - back
                    ok = (w >= edge[q]) & (w + least <= edge[q + 1])
                    ok[ok] = first[w[ok]] == p[ok]  # a window is given out by its own suffix alone, so once
                    if ok.any():
                        yield _out(whole[w[ok]].view(np.int64), b, q[ok], w[ok] - edge[q[ok]], np.zeros(ok.sum()), np.zeros(ok.sum()), pa.nulls(int(ok.sum()), pa.binary()))

    return expand


def _out(key: np.ndarray, b: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, nl: np.ndarray, nr: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(row), b.column(1).take(row), *(pa.array(x.astype(np.int32)) for x in (pos, nl, nr)), words], names=["h", "id", "th", "pos", "nl", "nr", "words"])


def shared(x: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Number of leading words that each row, in this order, has in common with the one before it; 0 for the first. n: words of each row."""
    out = np.zeros(len(order), np.int64)
    for k in range(0, len(order) - 1, 50_000):
        a, b = order[k : k + 50_000 + 1][:-1], order[k + 1 : k + 50_000 + 1]
        a = a[: len(b)]
        unlike = x[a] != x[b]
        first = np.where(unlike.any(1), unlike.argmax(1), x.shape[1])
        out[k + 1 : k + 1 + len(b)] = np.minimum(first, np.minimum(n[a], n[b]))
    return out


def subtrees(key: np.ndarray, right: np.ndarray, left: np.ndarray, nr: np.ndarray, nl: np.ndarray, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words to the left, words to the right, leaves, partner) of the repeats around each suffix; words are -1 where there is none.

    The rows of one key are the leaves of a subtree. right: the words after the prefix; left: those before it, nearest first.
    """
    n, side = len(key), least - prefix
    order = np.lexsort([*right.T[::-1], key])
    depth = shared(right, nr, order)
    depth[np.concatenate([[True], key[order][1:] != key[order][:-1]])] = -1
    rank = np.empty(n, np.int64)
    rank[np.lexsort(left.T[::-1])] = np.arange(n)
    out_left, out_right, leaves, partner = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
    longest = np.zeros(n, np.int64)
    for d in range(side, -1, -1):
        # the nodes of depth d or more are runs of leaves between drops below d
        node = np.cumsum(depth < d)
        size = np.bincount(node)
        inside = size[node] > 1
        rows, of = order[inside], node[inside]
        if not len(rows):
            continue
        by = np.lexsort([rank[rows], of])
        rows, of = rows[by], of[by]
        with_last = shared(left, nl, rows)
        with_last[np.concatenate([[True], of[1:] != of[:-1]])] = -1
        with_next = np.append(with_last[1:], -1)
        best = np.maximum(with_last, with_next)
        deep = best + prefix + d >= least
        r = rows[deep]
        out_left[r] = np.maximum(out_left[r], best[deep])
        out_right[r] = np.maximum(out_right[r], d)
        along = np.cumsum(with_last < side - d)  # those that share the words to the left too
        leaves[r] = np.maximum(leaves[r], np.bincount(along)[along][deep])
        total = best[deep] + d
        more = total > longest[r]
        other = np.where(with_last >= with_next, np.concatenate([[0], rows[:-1]]), np.append(rows[1:], 0))[deep]
        longest[r[more]], partner[r[more]] = total[more], other[more]
    return out_left, out_right, leaves, partner


SPANS = "id long, th long, lo int, hi int, leaves long, partner long"


def _trees(least: int, prefix: int, together: int = 50_000):
    side = least - prefix

    def spans(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        if t.num_rows < 2:
            return
        key, ids, th, pos, nl, nr = (t.column(c).to_numpy() for c in range(6))
        words = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.uint32) for c in t.column(6).chunks]).reshape(t.num_rows, 2 * side)
        left, right, leaves, partner = subtrees(key, words[:, :side], words[:, side:], nr, nl, least, prefix)
        ok = right >= 0
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(th[ok]), pa.array((pos - left)[ok].astype(np.int32)), pa.array((pos + prefix + right)[ok].astype(np.int32)), pa.array(leaves[ok]), pa.array(ids[partner[ok]])], names=["id", "th", "lo", "hi", "leaves", "partner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key: whole groups are gathered until there are enough; a group that may go on in the next batch waits for it."""
        rest: list[pa.RecordBatch] = []
        for b in batches:
            for k in range(0, b.num_rows, together):
                part = b.slice(k, together)
                rest.append(part)
                if sum(x.num_rows for x in rest) < together:
                    continue
                key = part.column(0).to_numpy()
                at = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if at:
                    yield from spans([*rest[:-1], part.slice(0, at)])
                    rest = [part.slice(at)]
                elif len(rest) > 1 and rest[-2].column(0)[-1].as_py() != int(key[0]):
                    yield from spans(rest[:-1])
                    rest = [part]
        if rest:
            yield from spans(rest)

    return run


def repeats(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX, memory: int = MEMORY) -> DataFrame:
    """One row for each repeated passage of a document: doc_id, start_word, end_word (words from 0, end exclusive), n_words, leaves (most suffixes
    that share a deep node of it: the most places, equal texts once, that one of its runs of `least` words has; or whole copies of the text), partner (a doc_id that has the same words; the text's own where it repeats itself)."""
    S.ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias(f"{S.OWN}text")).where(f"{S.OWN}text is not null and id is not null")
    suffixes = S.written(own.mapInArrow(_first(least, prefix), "h long, id long, th long, pos int"), "suffixes")
    place = F.xxhash64("th", "pos")
    repeated = suffixes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h", "n")
    once = suffixes.join(repeated, "h").groupBy("h", "th", "pos").agg(F.min("id").alias("id"), F.max("n").alias("n"))  # equal texts are one
    places = S.written(once.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "h", (F.col("n") > memory).alias("hot"))).alias("places")), "suffix-places")
    texts = own.dropDuplicates(["id", "th"]) if _repeated_ids(own) else own
    around = texts.join(places.hint("shuffle_hash"), ["id", "th"]).select("id", "th", f"{S.OWN}text", "places").mapInArrow(_around(least, prefix), "h long, id long, th long, pos int, nl int, nr int, words binary")
    if places.where(F.exists("places", lambda p: p["hot"])).isEmpty():
        spans = around.repartition("h").sortWithinPartitions("h").mapInArrow(_trees(least, prefix), SPANS)
    else:
        around = S.written(around, "suffixes-around")
        trees = around.where("words is not null").repartition("h").sortWithinPartitions("h").mapInArrow(_trees(least, prefix), SPANS)
        windows = around.where("words is null").select("h", "id", "th", "pos")
        twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("leaves"), F.min("id").alias("low"), F.max("id").alias("high")).where("leaves > 1")
        other = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
        spans = trees.union(windows.join(twice, "h").select("id", "th", F.col("pos").alias("lo"), (F.col("pos") + least).alias("hi"), "leaves", other.alias("partner")))
    by = Window.partitionBy("id", "th").orderBy("lo", "hi")
    broken = spans.withColumn("begins", F.when(F.col("lo") <= F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)).withColumn("island", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = broken.groupBy("id", "th", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("leaves").alias("leaves"), F.coalesce(F.min(F.when(F.col("partner") != F.col("id"), F.col("partner"))), F.min("partner")).alias("partner"))
    sized = S.written(own.mapInArrow(_counts(least), "id long, th long, n int"), "text-words")
    alike = sized.groupBy("th").agg(F.count(F.lit(1)).alias("leaves"), F.min("id").alias("low"), F.max("id").alias("high")).where("leaves > 1")
    copies = sized.join(alike, "th")
    whole = copies.select("id", "th", F.lit(0).alias("lo"), F.col("n").alias("hi"), "leaves", F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("partner"))
    found = merged.join(copies.select("id", "th").distinct(), ["id", "th"], "left_anti").select("id", "th", "lo", "hi", "leaves", "partner").union(whole)
    return found.select(F.col("id").alias("doc_id"), F.col("lo").alias("start_word"), F.col("hi").alias("end_word"), (F.col("hi") - F.col("lo")).alias("n_words"), "leaves", "partner")


def _repeated_ids(own: DataFrame) -> bool:
    return not own.groupBy("id", "th").count().where("count > 1").isEmpty()


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(S.table(spark, sf_dir, "documents"))
