"""Hard negatives by rotated one-bit codes: popcount estimates, residual intervals, exact integer scores of what survives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credtrace.llm.common import work_dir, written

#: One-bit codes of a vector: the first of the vector, each further one of what the codes before it leave over.
LEVELS = 4
#: Bits of a query's components, each a plane that meets a code by AND and popcount.
PLANES = 8
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors that are broadcast together, and the rows and anchors of a block of estimates in a task.
CHUNK, BLOCK_ROWS, BLOCK_ANCHORS = 4096, 1024, 256
#: Components are held within these bounds, so that scores of up to 8192 dimensions stay within 63 bits.
LIMIT = 1 << 25


@lru_cache(8)
def rotation(level: int, dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task; each level has its own."""
    q, r = np.linalg.qr(np.random.default_rng(7919 * dims + level).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, residuals) of the rows: a bitmap of signs and its alignment for each level, the norm of the rest.

    A code stands for the unit vector of its signs in the rotated frame; the alignment is the rest's projection on it.
    """
    n, dims = vectors.shape
    codes, alignments, rest = [], [], vectors.astype(np.float64)
    for level in range(LEVELS):
        turned = rest @ rotation(level, dims)
        positive = turned >= 0
        signs = np.where(positive, 1.0, -1.0) / np.sqrt(dims)
        alignment = (turned * signs).sum(axis=1)
        rest = rest - (alignment[:, None] * signs) @ rotation(level, dims).T
        bits = np.zeros((n, -(-dims // 64) * 64), bool)
        bits[:, :dims] = positive
        codes.append(np.packbits(bits, axis=1).view(np.uint64))
        alignments.append(alignment)
    return np.stack(codes, 1), np.stack(alignments, 1), np.linalg.norm(rest, axis=1)


@dataclass
class Anchors:
    """A chunk of anchors: their rows, and for each level bit planes, step, offset and rounding error of the turned vector."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    planes: np.ndarray
    steps: np.ndarray
    lows: np.ndarray
    errors: np.ndarray
    norms: np.ndarray
    positives: pa.Table | None = None

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Anchors:
        n, dims = vectors.shape
        planes, steps, lows, errors = [], [], [], []
        for level in range(LEVELS):
            turned = vectors @ rotation(level, dims)
            low = turned.min(axis=1)
            step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
            whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            errors.append(np.linalg.norm(turned - low[:, None] - whole * step[:, None], axis=1))
            bits = np.zeros((n, PLANES, -(-dims // 64) * 64), bool)
            bits[:, :, :dims] = (whole[:, None, :] >> np.arange(PLANES)[:, None]) & 1
            planes.append(np.packbits(bits, axis=2).view(np.uint64))
            steps.append(step)
            lows.append(low)
        return cls(ids, labels, vectors, np.stack(planes, 1), np.stack(steps, 1), np.stack(lows, 1), np.stack(errors, 1),
                   np.linalg.norm(vectors, axis=1))

    def intervals(self, one: slice, codes: np.ndarray, alignments: np.ndarray, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, half width), anchors by rows: no true score lies outside.

        The product with a unit sign vector is 2 P - S over sqrt(dims), P the sum over its positive places, S over all; P
        comes from popcounts of the planes. By Cauchy-Schwarz the rounding of the query adds at most alignment times
        error, and what all codes leave over at most the product of the norms.
        """
        dims = self.vectors.shape[1]
        estimate = np.zeros((len(self.ids[one]), len(codes)))
        half = self.norms[one, None] * residuals
        for level in range(LEVELS):
            whole = np.zeros(estimate.shape, np.int64)
            for k in range(PLANES):
                common = np.bitwise_count(self.planes[one, level, k][:, None, :] & codes[None, :, level]).sum(axis=2, dtype=np.int64)
                whole += common << k
            all_places = np.bitwise_count(self.planes[one, level]).sum(axis=2, dtype=np.int64) @ (1 << np.arange(PLANES))
            positives = np.bitwise_count(codes[:, level]).sum(axis=1, dtype=np.int64)
            product = self.steps[one, level, None] * (2 * whole - all_places[:, None]) + self.lows[one, level, None] * (2 * positives - dims)
            estimate += alignments[:, level] * product / np.sqrt(dims)
            half += self.errors[one, level, None] * np.abs(alignments[:, level])
        return estimate, half * (1 + 1e-9) + 1e-6 * (1 + self.norms[one, None])


def valid(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, labels turned and components as integers."""
    label = F.col("label").cast("long")
    component = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * 256))).cast("int")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(valid(F.col("embedding")), F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", component).alias("vector"))


def indexed(rows: DataFrame, dims: int) -> DataFrame:
    """(vec_id, label, mark, vector, codes, alignments, residual), a row each; shorter vectors end in zeros."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("vector").value_lengths().to_numpy()
            vectors = np.zeros((len(sizes), dims), np.int32)
            vectors[np.arange(dims) < sizes[:, None]] = b.column("vector").flatten().to_numpy()
            codes, alignments, residuals = coded(vectors)
            as_rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id"), "label": b.column("label"), "mark": b.column("mark"), "vector": as_rows(vectors),
                "codes": as_rows(codes), "alignments": as_rows(alignments), "residual": pa.array(residuals)})

    return rows.select("vec_id", "label", F.xxhash64("label", "vector").alias("mark"), "vector").mapInArrow(
        batch, "vec_id long, label long, mark long, vector binary, codes binary, alignments binary, residual double")


def matrix(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


@dataclass
class Best:
    """The first ``k`` distinct rows so far of each list: places in lists, scores, ids and marks, best first."""

    k: int
    lists: np.ndarray
    scores: np.ndarray
    ids: np.ndarray
    marks: np.ndarray

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, *(np.empty(0, np.int64) for _ in range(4)))

    def add(self, *more: np.ndarray) -> None:
        lists, scores, ids, marks = (np.concatenate(x) for x in zip((self.lists, self.scores, self.ids, self.marks), more))
        order = np.lexsort((marks, ids, -scores, lists))
        lists, scores, ids, marks = (x[order] for x in (lists, scores, ids, marks))
        new = np.ones(len(lists), bool)
        new[1:] = (np.diff(lists) != 0) | (np.diff(ids) != 0) | (np.diff(marks) != 0) | (np.diff(scores) != 0)
        lists, scores, ids, marks = (x[new] for x in (lists, scores, ids, marks))
        keep = np.arange(len(lists)) - np.searchsorted(lists, lists) < self.k
        self.lists, self.scores, self.ids, self.marks = (x[keep] for x in (lists, scores, ids, marks))

    def bar(self, n: int) -> np.ndarray:
        """Score that a row needs at least to enter each of n lists."""
        out = np.full(n, -np.inf)
        last = np.searchsorted(self.lists, np.arange(n), side="right") - 1
        full = np.bincount(self.lists, minlength=n)[:n] == self.k
        out[full] = self.scores[last[full]]
        return out


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, labels, marks, vectors, codes, alignments, residuals) of runs of distinct rows."""
    words = -(-dims // 64)
    for b in batches:
        for at in range(0, len(b), BLOCK_ROWS):
            x = b.slice(at, BLOCK_ROWS)
            ids, labels, marks, residuals = (x.column(c).to_numpy() for c in ("vec_id", "label", "mark", "residual"))
            _, first = np.unique(np.stack([ids, marks]), axis=1, return_index=True)
            yield (ids[first], labels[first], marks[first], matrix(x.column("vector"), np.int32, (dims,))[first].astype(np.int64),
                   matrix(x.column("codes"), np.uint64, (LEVELS, words))[first], matrix(x.column("alignments"), np.float64, (LEVELS,))[first],
                   residuals[first])


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def exact(one: np.ndarray, two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs of rows."""
    return np.concatenate([np.empty(0, np.int64), *(np.einsum("rd,rd->r", one[i[k:k + 65536]], two[j[k:k + 65536]]) for k in range(0, len(i), 65536))])


def positives(index: DataFrame, shared, dims: int, k: int) -> DataFrame:
    """(list, score, id, mark): the first ``k`` rows of the anchor's label in each task, lists numbered as the anchors."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = shared.value, Best.none(k)
        for ids, labels, marks, vectors, codes, alignments, residuals in blocks(batches, dims):
            bars = best.bar(len(anchors.ids))
            for at in range(0, len(anchors.ids), BLOCK_ANCHORS):
                one = slice(at, at + BLOCK_ANCHORS)
                estimate, half = anchors.intervals(one, codes, alignments, residuals)
                own = (anchors.labels[one, None] == labels) & (anchors.ids[one, None] != ids)
                bar = np.maximum(bars[one], kth_largest(np.where(own, estimate - half, -np.inf), k))
                i, j = np.nonzero(own & (estimate + half >= bar[:, None]))
                best.add(i + at, exact(anchors.vectors, vectors, i + at, j), ids[j], marks[j])
        yield pa.RecordBatch.from_pydict({"list": best.lists, "score": best.scores, "id": best.ids, "mark": best.marks})

    return index.mapInArrow(batch, "list long, score long, id long, mark long")


def negatives(index: DataFrame, shared, dims: int, k: int, low: int, high: int) -> DataFrame:
    """(list, score, id, mark): the first ``k`` rows of other labels in each task within the window of each positive."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = shared.value, Best.none(k)
        of, scores = (anchors.positives.column(c).to_numpy() for c in ("list", "score"))
        least, most = -(-low * scores // 100), high * scores // 100
        for ids, labels, marks, vectors, codes, alignments, residuals in blocks(batches, dims):
            bars = best.bar(len(of))
            for at in range(0, len(anchors.ids), BLOCK_ANCHORS):
                one = slice(at, at + BLOCK_ANCHORS)
                estimate, half = anchors.intervals(one, codes, alignments, residuals)
                other = anchors.labels[one, None] != labels
                windows = np.arange(np.searchsorted(of, at), np.searchsorted(of, at + BLOCK_ANCHORS))
                found = np.zeros(estimate.shape, bool)
                at_most, at_least = estimate + half, estimate - half
                for place in range(int(np.bincount(of[windows] - at).max()) if len(windows) else 0):
                    # The window number ``place`` of every anchor of the block that has so many.
                    chosen = windows[windows - np.searchsorted(of, of[windows]) == place]
                    rows = of[chosen] - at
                    lo, hi = least[chosen, None], most[chosen, None]
                    sure = np.where(other[rows] & (at_least[rows] >= lo) & (at_most[rows] <= hi), at_least[rows], -np.inf)
                    bar = np.maximum(np.maximum(bars[chosen], kth_largest(sure, k))[:, None], lo)
                    found[rows] |= other[rows] & (at_most[rows] >= bar) & (at_least[rows] <= hi)
                i, j = np.nonzero(found)
                product = exact(anchors.vectors, vectors, i + at, j)
                first, last = np.searchsorted(of, i + at), np.searchsorted(of, i + at, side="right")
                times = last - first
                window = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                j, product = np.repeat(j, times), np.repeat(product, times)
                inside = (product >= least[window]) & (product <= most[window])
                best.add(window[inside], product[inside], ids[j[inside]], marks[j[inside]])
        yield pa.RecordBatch.from_pydict({"list": best.lists, "score": best.scores, "id": best.ids, "mark": best.marks})

    return index.mapInArrow(batch, "list long, score long, id long, mark long")


def firsts(partial: DataFrame, k: int) -> DataFrame:
    """(list, score, id, rank): the first ``k`` of each list over all tasks; rows that repeat count once."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id", "mark")
    return partial.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("list", "score", "id", "rank")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int = 100, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         chunk: int = CHUNK) -> DataFrame:
    """Hard negatives of the anchors, the rows whose vec_id is divisible by ``every``, among all rows of another label.

    Scores are inner products of the integer vectors floor(256 x); higher ones come first, ties by smaller vec_id. A positive
    is one of an anchor's first ``n_positives`` other rows of its label; for each, the first ``n_negatives`` rows of other
    labels are returned that score ``low`` to ``high`` per cent of it.

    Method. Each row holds ``LEVELS`` one-bit codes in rotated frames, each with the alignment of the vector and its code.
    Popcounts of the codes with the bit planes of an anchor estimate the score; by Cauchy-Schwarz it lies within a known
    distance. Rows whose interval misses the window, or cannot pass what is already found, are left out, the others are
    scored as integers, so the result is that of scoring all pairs. Anchors meet the rows in chunks of bounded size
    (``chunk`` on average) that are broadcast; every task keeps the first rows of each list only.

    Rows with a null id, label or vector, or a component that is null or not finite take no part. Shorter vectors end in
    zeros; components beyond 2^25 are held there. Other rows are those of another id; rows that repeat id, label and vector
    count once, those that share an id alone are rows of their own. No rows give no rows; further columns are ignored.
    """
    spark = rows.sparkSession
    rows = prepared(rows)
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if not dims:  # no rows, or vectors without components, whose scores are 0 throughout
        dims = 1
    index = written(indexed(rows, dims))
    anchors = index.where(F.col("vec_id") % every == 0).select("vec_id", "label", "mark", "vector").distinct()
    n_chunks = -(-anchors.count() // chunk)
    anchors = written(anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(max(n_chunks, 1)))))
    folder = work_dir(spark)
    for number in range(n_chunks):
        held = anchors.where(F.col("chunk") == number).select("vec_id", "label", "mark", "vector").toArrow().sort_by(
            [("vec_id", "ascending"), ("mark", "ascending")])
        if not len(held):
            continue
        block = Anchors.of(held.column("vec_id").to_numpy(), held.column("label").to_numpy(),
                           matrix(held.column("vector").combine_chunks(), np.int32, (dims,)).astype(np.int64))
        shared = spark.sparkContext.broadcast(block)
        first = firsts(positives(index, shared, dims, n_positives), n_positives).toArrow().sort_by([("list", "ascending"), ("rank", "ascending")])
        shared.destroy()
        block.positives = first
        shared = spark.sparkContext.broadcast(block)
        named = spark.createDataFrame(pa.table({
            "window": np.arange(len(first)), "anchor_id": block.ids[first.column("list").to_numpy()], "positive_id": first.column("id"),
            "positive_score": first.column("score")}))
        found = firsts(negatives(index, shared, dims, n_negatives, low, high), n_negatives)
        found.join(F.broadcast(named), F.col("list") == F.col("window")).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
        shared.destroy()
    if not n_chunks:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(folder)


SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= {NEGATIVES}"""
