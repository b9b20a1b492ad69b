"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from credtrace.llm.char_grams import CHUNK, batched, code_points, hashes_of
from credtrace.llm.common import held_out, written

ORDERS, BITS = (4, 5, 6), 18
#: Buckets that the classifier looks at: those whose counts differ most between the classes.
FEATURES = 8192
#: Rows of each class that the weights are fitted on; ratios and the choice of features use all labelled rows.
SAMPLE = 2500
THRESHOLD = 0.3


@dataclass
class Model:
    """``marks`` tells buckets of interest, ``grams`` are sorted hashes with a weight each."""

    marks: np.ndarray
    grams: np.ndarray
    weights: np.ndarray
    intercept: float


def chunks_of(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, buckets) of the n-grams of a whole text; chunks overlap, so an n-gram may come twice."""
    points = code_points(" " + text.lower() + " ")
    for at in range(0, len(points), CHUNK):
        for hashes in hashes_of(points[at: at + CHUNK + ORDERS[-1] - 1], ORDERS):
            yield hashes, (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str, marks: np.ndarray) -> np.ndarray:
    """Distinct hashes of the n-grams of a whole text that fall in marked buckets."""
    return np.unique(np.concatenate([hashes[marks[buckets]] for hashes, buckets in chunks_of(text)])).view(np.int64)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from."""
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class (0, 1) the documents that hold each bucket, and the documents; 2^BITS numbers for each class."""
    part = 1 << 12

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, here, sizes = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool), [0, 0]
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text")):
                here[:] = False
                for _, buckets in chunks_of(text.as_py() or ""):
                    here[buckets] = True
                seen[toxic] += here
                sizes[toxic] += 1
        if sum(sizes):
            group = TaskContext.get().partitionId() // 256
            rows = [(toxic, k, group, seen[toxic, k * part:(k + 1) * part].tobytes()) for toxic in (0, 1) for k in range(len(here) // part)]
            rows += [(toxic, -1, group, np.array(sizes[toxic:toxic + 1], np.int64).tobytes()) for toxic in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["toxic", "part", "task_group", "counts"])

    def total(table: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return table.slice(0, 1).set_column(3, "counts", pa.array([added.tobytes()]))

    # Vectors are added for 256 tasks at a time, then once more, so that no group holds one for every task.
    kind = "toxic long, part long, task_group long, counts binary"
    rows = docs.select("toxic", "text").mapInArrow(batch, kind).groupBy("toxic", "part", "task_group").applyInArrow(total, kind)
    rows = rows.groupBy("toxic", "part").applyInArrow(total, kind).drop("task_group").collect()
    counts, sizes = np.zeros((2, 1 << BITS)), np.zeros(2)
    for toxic, k, held in rows:
        numbers = np.frombuffer(held, np.int64)
        if k < 0:
            sizes[toxic] = numbers[0]
        else:
            counts[toxic, k * part:(k + 1) * part] = numbers
    return counts[0], counts[1], sizes


def chosen_buckets(clean: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the buckets with the largest chi-square, and the log-count ratio of every bucket."""
    ratio = np.log((toxic + 0.5) / (sizes[1] + 1)) - np.log((clean + 0.5) / (sizes[0] + 1))
    total = clean + toxic
    expected = total * sizes[1] / sizes.sum()
    difference = (toxic - expected) ** 2 * (1 / np.maximum(expected, 1e-9) + 1 / np.maximum(total - expected, 1e-9))
    difference[total < 3] = 0
    marks = np.zeros(len(total), dtype=bool)
    best = np.argsort(-difference, kind="stable")[:features]
    marks[best[difference[best] > 0]] = True
    return marks, ratio


def fitted(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, truth: np.ndarray, weight: np.ndarray, n: int,
           penalty: float = 3.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by Adam over the whole sample; the penalty counts as so many rows."""
    penalty = penalty / len(truth)
    w, slow, fast, rate = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0.05
    share = (weight * truth).sum() / weight.sum()
    w[n] = np.log(share / (1 - share))
    weight = weight / weight.sum()
    parts = [slice(k, k + (1 << 18)) for k in range(0, len(rows), 1 << 18)]  # so that no step holds a second copy of all
    for t in range(1, steps + 1):
        z = w[n] + sum((np.bincount(rows[p], values[p] * w[columns[p]], minlength=len(truth)) for p in parts), np.zeros(len(truth)))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - truth) * weight
        slope = sum((np.bincount(columns[p], values[p] * error[rows[p]], minlength=n) for p in parts), np.zeros(n))
        step = np.append(slope + penalty * w[:n], error.sum())
        slow, fast = 0.9 * slow + 0.1 * step, 0.99 * fast + 0.01 * step * step
        w -= rate * (slow / (1 - 0.9 ** t)) / (np.sqrt(fast / (1 - 0.99 ** t)) + 1e-8)
    return w[:n], float(w[n])


def numbered(sets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, places, starts): the n-grams that two sets or more hold, sorted; for all sets behind one another the place of each
    n-gram among these or -1; where each set starts. Sets are looked at one by one, so little beside the places is held."""
    views = lambda: (np.frombuffer(x.as_buffer(), np.int64) for x in sets)
    starts = np.cumsum([0] + [len(v) for v in views()])
    flat = np.concatenate([np.empty(0, np.int64), *views()])
    flat.sort()
    same = flat[1:] == flat[:-1]
    grams = np.unique(flat[1:][same])
    del flat, same
    places = np.empty(starts[-1], np.int32)
    for at, v in zip(starts, views()):
        found = np.minimum(np.searchsorted(grams, v), max(len(grams) - 1, 0))
        places[at: at + len(v)] = np.where(grams[found] == v, found, -1) if len(grams) else -1
    return grams, places, starts


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE) -> Model:
    """Ratios and features from all labelled documents, weights from up to ``sample`` of them a class.

    The sample is the documents with the smallest id hashes and is weighted back to the class sizes. Its n-grams are kept
    as whole hashes, so that in a very long text an unknown n-gram is not taken for a known one.
    """
    docs = docs.select("doc_id", "text")
    truth = written(labelled(docs, labels))
    # Texts meet their labels by hash at every size; the label side, two numbers a row, is what each task holds.
    clean, toxic, sizes = bucket_counts(docs.where(~held_out(F.col("doc_id"))).join(truth.hint("shuffle_hash"), "doc_id"))
    if not sizes.all():
        score = 0.0 if not sizes[1] else 1.0
        return Model(np.zeros(1 << BITS, bool), np.empty(0, np.int64), np.empty(0), 40.0 * score - 20.0)
    marks, ratio = chosen_buckets(clean, toxic, sizes, features)
    taken = [truth.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [present(t.as_py() or "", shared.value).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "grams"])

    # Of documents that share an id one text is fitted on, so the sample is bounded in rows as well.
    chosen = docs.join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")).select("doc_id", "toxic", "t.text")
    picked = chosen.mapInArrow(batch, "doc_id long, toxic int, grams binary").toArrow().sort_by([("doc_id", "ascending"), ("grams", "ascending")])
    shared.destroy()
    classes = picked.column("toxic").to_numpy()
    grams, place, starts = numbered(picked.column("grams"))
    rows = np.repeat(np.arange(len(classes), dtype=np.int32), np.diff(starts))
    keep = place >= 0
    rows, columns = rows[keep], place[keep]
    del picked, place, keep
    scale = ratio[grams.view(np.uint64) >> np.uint64(64 - BITS)]
    weight = np.where(classes == 1, sizes[1] / max((classes == 1).sum(), 1), sizes[0] / max((classes == 0).sum(), 1))
    weights, intercept = fitted(rows, columns, scale.astype(np.float32)[columns], classes, weight, len(grams))
    return Model(marks, grams, weights * scale, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column ``__score`` from 0 to 1; needs the columns of docs to be of Arrow types."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])

    def one(text: str, m: Model) -> float:
        found = present(text, m.marks)
        at = np.searchsorted(m.grams, found)
        at[at == len(m.grams)] = 0
        z = m.intercept + (m.weights[at[m.grams[at] == found]].sum() if len(m.grams) and len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [one(t, shared.value) for texts in batched(b.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "__score"])

    return docs.mapInArrow(batch, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, scored by its whole text alone.

    Learns from labelled documents that are not held out. Null and empty texts score as what the intercept gives; without
    labels of both classes all score alike. Of repeated labels the highest counts; repeated documents are each scored;
    rows with a null doc_id are scored and never learned from; no rows give no rows; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                         (F.col("__score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, columns unchanged."""
    return score(docs, train(docs, labels)).where(F.col("__score") < threshold).drop("__score")
