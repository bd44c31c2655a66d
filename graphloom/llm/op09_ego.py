"""Near-duplicate embeddings by an epsilon grid order join.

Equal vectors are one class and enter the join once, so copies never make pairs. Vectors are scaled to unit length, so a cosine of at least COSINE is a distance of at most
epsilon = sqrt(2 - 2 COSINE). They are turned to the principal axes (covariance over all distinct vectors), laid in a grid of epsilon-wide cells on the LEADING axes, and
sorted by cell: the epsilon grid order. The sequence is cut into intervals of at most INTERVAL vectors with the box that each one fills. Interval pairs whose boxes are
within epsilon of each other are joined: halved recursively, a pair of parts is skipped once the distance of their boxes
(a lower bound of all distances between them) is above epsilon, and parts of LEAF vectors are compared in full. Distances in some axes never
exceed the whole distance, so no pair is lost: the join is exact.

Interval pairs meet by an equi-join on the cells of the first two axes that their boxes touch; only boxes and ids go through it. GROUP intervals that follow each other
travel as one packed row, so an interval is sent once for each group that one of its group meets, not once for each interval.

Defined results: null, empty, zero, non-finite vectors and those with null entries, or of another length than the commonest, are left out; so are rows with a null
vec_id (nothing names them); repeated rows count once; a vec_id with several vectors has a row for each; ties don't matter, as every pair is judged by itself; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

COSINE, LEADING, INTERVAL, LEAF, GROUP = 0.95, 6, 1024, 128, 8
SLACK = 1e-4  # for rounding in the bounds, which are in single precision; pairs themselves are decided by COSINE in double precision


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that can be compared, each row once, and their length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    rows = rows.distinct().where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    return rows.where(F.size("v") == dim), dim


def classes(rows: DataFrame) -> DataFrame:
    """(id, v, n): each distinct vector once, with the least id that has it and the number of those that do. Written, as it is read several times."""
    return S.written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")


def axes(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, leading first) of all unit vectors; partial sums are added up by Spark."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if b.num_rows:
                x = np.hstack([unit(_matrix(b.column(1), dim)), np.ones((b.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    found = rows.select("id", "v").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().to_pylist()
    total = np.zeros((dim + 1) ** 2)
    for r in found:
        total[r["k"]] = r["v"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    value, vector = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return mean, vector[:, np.argsort(-value, kind="stable")]


def join(a: np.ndarray, b: np.ndarray, epsilon: float, leading: int, own: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) that may be within epsilon; a and b: parts of the sequence, turned to the principal axes. own: a is b, then i < j."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(which: int, x: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (which, lo, hi) not in boxes:
            boxes[which, lo, hi] = (x[lo:hi, :leading].min(0), x[lo:hi, :leading].max(0))
        return boxes[which, lo, hi]

    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        (al, ah), (bl, bh) = box(0, a, a0, a1), box(0 if own else 1, b, b0, b1)
        apart = np.maximum(0, np.maximum(al - bh, bl - ah))
        if (apart * apart).sum() > epsilon * epsilon:
            continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            near = 2 - 2 * (a[a0:a1] @ b[b0:b1].T) <= epsilon * epsilon
            i, j = np.nonzero(near)
            i, j = i + a0, j + b0
            found.append((i[i < j], j[i < j]) if own else (i, j))
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if own and (a0, a1) == (b0, b1):
            todo += [(a0, am, a0, am), (am, a1, am, a1), (a0, am, am, a1)]
        elif a1 - a0 >= b1 - b0:
            todo += [(a0, am, b0, b1), (am, a1, b0, b1)]
        else:
            todo += [(a0, a1, b0, bm), (a0, a1, bm, b1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def sequence(rows: DataFrame, mean: np.ndarray, axis: np.ndarray, epsilon: float, kind: type = np.float32, leading: int = LEADING, interval: int = INTERVAL) -> DataFrame:
    """The intervals of the epsilon grid order: number, box (lo, hi), ids and packed vectors as they came. Written, so that their numbers stay."""
    dim = len(mean)
    cells = [f"c{k}" for k in range(leading)]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                cell = np.floor((unit(x) - mean) @ axis[:, :leading] / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), *(pa.array(cell[:, k]) for k in range(leading))], names=["id", "x", *cells])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 33
        for b in batches:
            for k in range(0, b.num_rows, interval):
                part = b.slice(k, interval)
                packed = b"".join(part.column(1).to_pylist())
                z = (unit(np.frombuffer(packed, kind).reshape(-1, dim).astype(float)) - mean) @ axis[:, :leading]
                ids = part.column(0).to_numpy().tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([list(z.min(0))], pa.list_(pa.float64())), pa.array([list(z.max(0))], pa.list_(pa.float64())), pa.array([ids], pa.binary()), pa.array([packed], pa.binary())], names=["no", "lo", "hi", "ids", "x"])
                no += 1

    spread = rows.select("id", "v").mapInArrow(turned, "id long, x binary, " + ", ".join(f"{c} int" for c in cells))
    return S.written(spread.orderBy(*cells, "id", "x").mapInArrow(cut, "no long, lo array<double>, hi array<double>, ids binary, x binary"), "intervals")


def _compared(dim: int, axis: np.ndarray, cosine: float, epsilon: float, leading: int, kind: type, pairs: bool):
    def intervals(rows: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = {}
        for r in rows:
            x = unit(np.frombuffer(r["x"], kind).reshape(-1, dim).astype(float))
            out[r["no"]] = np.frombuffer(r["ids"], np.int64), x, (x @ axis).astype(np.float32)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                meet, left, right = (batch.column(c)[k].as_py() for c in range(3))
                left, right, counts = intervals(left), intervals(right), []
                for m in meet:
                    (ia, xa, ta), (ib, xb, tb) = left[m["a"]], right[m["b"]]
                    i, j = join(ta, tb, epsilon, leading, m["a"] == m["b"])
                    value = np.einsum("ij,ij->i", xa[i], xb[j])
                    good = (value >= cosine) & (ia[i] != ib[j])
                    u, v = ia[i][good], ib[j][good]
                    if pairs and len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.round(value[good], 4))], names=["vec_id_a", "vec_id_b", "cosine"])
                    counts += [u, v]
                if not pairs and counts:
                    ids, n = np.unique(np.concatenate(counts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "links"])

    return compare


def _met(distinct: DataFrame, dim: int, cosine: float, leading: int, interval: int, kind: type, pairs: bool) -> DataFrame:
    """The links between distinct vectors (id, v): as pairs, or as partial counts of each."""
    epsilon, leading = float(np.sqrt(2 - 2 * cosine)) + SLACK, min(leading, dim)
    mean, axis = axes(distinct, dim)
    all_ = sequence(distinct, mean, axis, epsilon, kind, leading, interval)

    def touched(far: float, k: int) -> F.Column:
        low, high = F.floor((F.col("lo")[k] - far) / epsilon), F.floor((F.col("hi")[k] + far) / epsilon)
        return F.explode(F.sequence(low, high))

    boxes = all_.select("no", "lo", "hi")
    wide = boxes.select("no", "lo", "hi", touched(0.0, 0).alias("k0"))
    reach = boxes.select("no", "lo", "hi", touched(epsilon, 0).alias("k0"))
    if leading > 1:
        wide, reach = wide.select("*", touched(0.0, 1).alias("k1")), reach.select("*", touched(epsilon, 1).alias("k1"))
    keys = ["k0", "k1"][:leading]
    a, b = wide.select(F.col("no").alias("a"), F.col("lo").alias("al"), F.col("hi").alias("ah"), *keys), reach.select(F.col("no").alias("b"), F.col("lo").alias("bl"), F.col("hi").alias("bh"), *keys)
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col("al")[k] - F.col("bh")[k], F.col("bl")[k] - F.col("ah")[k]), F.lit(2.0)) for k in range(leading)), F.lit(0.0))
    near = a.join(b, keys).where("a <= b").where(apart <= epsilon * epsilon).select("a", "b").distinct()
    group = lambda c: F.floor(F.col(c) / GROUP)
    meet = near.groupBy(group("a").alias("ga"), group("b").alias("gb")).agg(F.collect_list(F.struct("a", "b")).alias("meet"))  # GROUP^2 at most
    packed = all_.groupBy(group("no").alias("g")).agg(F.collect_list(F.struct("no", "ids", "x")).alias("rows"))  # GROUP at most
    both = meet.join(packed.select(F.col("g").alias("ga"), F.col("rows").alias("left")), "ga").join(packed.select(F.col("g").alias("gb"), F.col("rows").alias("right")), "gb")
    schema = "vec_id_a long, vec_id_b long, cosine double" if pairs else "id long, links long"
    return both.select("meet", "left", "right").mapInArrow(_compared(dim, axis, cosine, epsilon, leading, kind, pairs), schema)


def _kind(vectors: DataFrame) -> type:
    """Vectors of single precision travel as such; any others in double precision."""
    return np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def near_pairs(vectors: DataFrame, cosine: float = COSINE, leading: int = LEADING, interval: int = INTERVAL) -> DataFrame:
    """(vec_id_a, vec_id_b, cosine), a < b: every pair of classes, named by their least ids, with at least this cosine, once."""
    S.ship(vectors.sparkSession)
    rows, dim = usable(vectors)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "vec_id_a long, vec_id_b long, cosine double")
    found = _met(classes(rows), dim, cosine, leading, interval, _kind(vectors), True)
    return found.groupBy("vec_id_a", "vec_id_b").agg(F.max("cosine").alias("cosine"))


def linked(vectors: DataFrame, cosine: float = COSINE, leading: int = LEADING, interval: int = INTERVAL) -> DataFrame:
    """One row a vector: vec_id, class_id (the least vec_id with an equal vector), class_size, links (other classes with at least this cosine)."""
    S.ship(vectors.sparkSession)
    rows, dim = usable(vectors)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "vec_id long, class_id long, class_size long, links long")
    of = classes(rows)
    links = _met(of, dim, cosine, leading, interval, _kind(vectors), False).groupBy("id").agg(F.sum("links").alias("links"))
    named = of.join(links, "id", "left").select("v", F.col("id").alias("class_id"), F.col("n").alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))
    # a vector that a third of all rows share makes one large key here; adaptive execution splits it
    return rows.join(named, "v").select(F.col("id").alias("vec_id"), "class_id", "class_size", "links")


def op9_ego_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(S.table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT e, min(vec_id) AS class_id, count(*) AS class_size FROM v GROUP BY e),
l AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.class_id <> b.class_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE} GROUP BY 1)
SELECT vec_id, class_id, class_size, CAST(coalesce(links, 0) AS BIGINT) AS links FROM v JOIN c USING (e) LEFT JOIN l USING (class_id)
"""
