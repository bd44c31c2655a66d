"""Language identification by error-correcting output codes: binary byte n-gram classifiers predict the bits of a language's codeword.

Codewords: up to 5 languages get the exhaustive code (2^(L-1) - 1 bits); more get the best of TRIES seeded random codes by least distance.
Each bit has a logistic classifier over the shares of hashed byte bigrams and trigrams of the lower-cased text; as it is linear,
a text's margin is a mean of table entries, one look-up a position, over the whole text.

Fit, on a bounded sample: at most PER_LANGUAGE documents of each `lang`, fewer where there are so many languages that they would be more than SAMPLE in all (but LEAST), the least by a
seeded hash of doc_id; three quarters train, the rest
calibrates: a bit weighs the log-odds of its held-out accuracy, and GAP is the largest difference of losses (LEAST_GAP at least) below which
held-out decisions are right at a rate of no more than DOUBTFUL. Decoding is loss-weighted: the codeword with the least weighted logistic loss of the margins is nearest. A text
is ambiguous where the second nearest is closer than GAP.

Defined results: null and empty texts, and texts of fewer than 3 bytes, have no language and are ambiguous; a null doc_id stays; of languages that are equally near the first by name is given, and such a text is ambiguous; texts of any length are read whole; repeated rows are scored each; null `lang`
values train nothing; with fewer than two languages of LEAST documents nothing is decided; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

PER_LANGUAGE, SAMPLE, LEAST, SEED, TRIES, DOUBTFUL, LEAST_GAP, STEPS, RATE, DECAY = 700, 10_000, 5, 29, 200, 0.75, 0.25, 150, 0.05, 1e-4
WIDTH = 4096  # buckets of bigrams, and as many of trigrams


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """(languages, bits) of -1 and 1; every bit splits the languages."""
    if languages <= 5:
        rows = [p for p in itertools.product((-1, 1), repeat=languages) if p[0] == 1 and -1 in p]
        return np.array(rows).T
    bits = max(15, int(np.ceil(10 * np.log2(languages))))
    rng, best, kept = np.random.default_rng(seed), -1, None
    for _ in range(TRIES):
        code = rng.choice((-1, 1), (languages, bits))
        code = code[:, np.abs(code.sum(0)) < languages]
        near = (code.shape[1] - code @ code.T) // 2 + 10**6 * np.eye(languages, dtype=int)
        if near.min() > best:
            best, kept = near.min(), code
    return kept


def grams(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For bigrams and trigrams: bucket of each position, and which positions are of one row (others are crossings)."""
    d = data.astype(np.int64)
    row_end = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(len(d))
    for n, base in ((2, 0), (3, WIDTH)):
        h = np.zeros(max(0, len(d) - n + 1), np.int64)
        for k in range(n):
            h = h * 0x1F7B + d[k : len(h) + k]
        h = ((h * 0x2545F491) >> 13) % WIDTH + base
        yield h, at[: len(h)] + n <= row_end[: len(h)]


def margins(data: np.ndarray, starts: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bits) margins, and whether a row has any trigram."""
    rows = len(starts) - 1
    out, ok = np.tile(bias, (rows, 1)).astype(float), np.diff(starts) >= 3
    if len(data) < 3:
        return out, ok
    for k in range(0, rows):  # a row at a time keeps the look-ups in cache
        if ok[k]:
            part = data[starts[k] : starts[k + 1]]
            for h, _ in grams(part, np.array([0, len(part)])):
                seen = np.bincount(h, minlength=2 * WIDTH) if len(h) > 2 * WIDTH else None
                out[k] += (seen @ weight if seen is not None else weight[h].sum(0)) / len(h)
    return out, ok


def shares(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts) - 1, 2 * WIDTH), np.float32)
    for k in range(len(out)):
        part = data[starts[k] : starts[k + 1]]
        if len(part) >= 3:
            for h, _ in grams(part, np.array([0, len(part)])):
                out[k] += np.bincount(h, minlength=2 * WIDTH).astype(np.float32) / len(h)
    return out


@dataclass
class Decoder:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    gap: float = 0.0

    def losses(self, margin: np.ndarray) -> np.ndarray:
        """(rows, languages): weighted logistic loss of each codeword, in bits of one vote."""
        z = margin[:, None, :] * self.code[None]
        return (np.logaddexp(0, -z) * self.trust).sum(2) / self.trust.sum()

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its loss, and how much more the second nearest has."""
        loss = self.losses(margin)
        two = np.sort(loss, 1)[:, :2]
        return loss.argmin(1), two[:, 0], two[:, 1] - two[:, 0]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = SEED) -> Decoder:
    """x: shares of n-grams; y: numbers of languages."""
    code = codewords(len(languages))
    order = np.random.default_rng(seed).permutation(len(x))
    held, own = order[::4], np.setdiff1d(order, order[::4])
    mean, spread = x[own].mean(0), x[own].std(0) + 1e-4
    z, want = ((x[own] - mean) / spread).astype(np.float32), code[y[own]].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    share = np.bincount(y[own], minlength=len(languages))
    each = (1 / (np.maximum(share, 1) * len(languages)))[y[own]].astype(np.float32)[:, None]
    for step in range(1, STEPS + 1):  # Adam on the mean logistic loss, each language counting alike
        slope = -want * each / (1 + np.exp(np.clip(want * (z @ w + b), -30, 30)))
        gw, gb = z.T @ slope + DECAY * w, slope.sum(0)
        m1, m2, c1, c2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw, 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        lift = RATE / 10 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= lift * m1 / (np.sqrt(m2) + 1e-8)
        b -= lift * c1 / (np.sqrt(c2) + 1e-8)
    weight = w / spread[:, None]
    decoder = Decoder(languages, code, weight.astype(np.float64), b - mean @ weight, np.ones(code.shape[1]))
    test = held if len(held) else own
    margin = x[test] @ decoder.weight + decoder.bias
    right = ((margin > 0) == (code[y[test]] > 0)).mean(0)
    right = np.clip(right, 0.5, 1 - 0.5 / len(test))
    decoder.trust = np.maximum(np.log(right / (1 - right)), 0.05)
    got, _, gap = decoder.decide(margin)
    order = np.argsort(gap, kind="stable")
    rate = np.cumsum((got == y[test])[order]) / np.arange(1, len(order) + 1)
    low = np.flatnonzero(rate <= DOUBTFUL)
    decoder.gap = max(LEAST_GAP, float(gap[order[low[-1]]]) + 1e-9 if len(low) else 0.0)
    return decoder


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in S.slices(batches, "text", 4_000_000):
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            x = shares(*S.bytes_of(pc.utf8_lower(part.column(2))))
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]  # most n-grams don't occur in a text
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.tobytes() + r[a].tobytes() for a, r in zip(at, x, strict=True)], pa.binary())], names=["doc_id", "lang", "x"])


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), 2 * WIDTH), np.float32)
    for k, packed in enumerate(rows):
        n = len(packed) // 6
        out[k, np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed, np.float32, n, 2 * n)
    return out


def sample(docs: DataFrame, most: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang, text of at most `most` documents of each language; first the ids alone, then their texts."""
    own = docs.select(F.col("doc_id").cast("long").alias(f"{S.OWN}id"), F.col("lang").cast("string").alias(f"{S.OWN}l"))
    by = Window.partitionBy(f"{S.OWN}l").orderBy(F.xxhash64(f"{S.OWN}id", F.lit(SEED)), f"{S.OWN}id")
    few = own.where(f"{S.OWN}id is not null and {S.OWN}l is not null").distinct().withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)
    few = S.written(few, "language-sample")
    each = max(LEAST, SAMPLE // max(1, few.select(f"{S.OWN}l").distinct().count()))
    few = few.where(F.col("rn") <= each).drop("rn")  # SAMPLE rows, or LEAST a language: a bounded table of names and ids
    return docs.select(F.col("doc_id").cast("long").alias(f"{S.OWN}id"), F.col("lang").alias(f"{S.OWN}l"), "text").join(F.broadcast(few), [f"{S.OWN}id", f"{S.OWN}l"]).toDF("doc_id", "lang", "text")


def fit(docs: DataFrame, most: int = PER_LANGUAGE) -> Decoder | None:
    S.ship(docs.sparkSession)
    t = sample(docs, most).where("octet_length(text) >= 3").mapInArrow(_shares, "doc_id long, lang string, x binary").toArrow()
    rows = sorted(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), t["x"].to_pylist(), strict=True))
    names, count = np.unique([r[1] for r in rows], return_counts=True) if rows else (np.zeros(0, str), np.zeros(0))
    languages = [str(n) for n, c in zip(names, count, strict=True) if c >= LEAST]
    if len(languages) < 2:
        return None
    rows = [r for r in rows if r[1] in languages]
    return train(_unpacked([r[2] for r in rows]), np.array([languages.index(r[1]) for r in rows]), languages)


def language(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, predicted language, loss, gap to the second nearest, bits, ambiguous."""
    decoder = fit(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "text", 8_000_000):
            n = b.num_rows
            if decoder is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.string()), pa.array([True] * n)], names=NAMES)
                continue
            data, starts = S.bytes_of(pc.utf8_lower(b.column(1)))
            margin, ok = margins(data, starts, decoder.weight, decoder.bias)
            best, loss, gap = decoder.decide(margin)
            bits = ["".join("1" if v else "0" for v in m) for m in margin > 0]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([decoder.languages[k] for k in best], pa.string(), mask=~ok),
                    pa.array(loss, mask=~ok),
                    pa.array(gap, mask=~ok),
                    pa.array(bits, pa.string(), mask=~ok),
                    pa.array(~ok | (gap < decoder.gap)),
                ],
                names=NAMES,
            )

    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return skinny.mapInArrow(judge, "doc_id long, language string, loss double, gap double, bits string, ambiguous boolean")


NAMES = ["doc_id", "language", "loss", "gap", "bits", "ambiguous"]


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(S.table(spark, sf_dir, "documents"))
