"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrace.llm.char_grams import CHUNK, batched, code_points, hashes_of
from credtrace.llm.common import held_out, written

ORDERS, BITS, ALPHA = (1, 2, 3), 15, 0.5
#: Languages whose log probabilities are broadcast together, 13 MB at most; texts are scored once for each such group.
GROUP = 100


def buckets_of(points: np.ndarray, at: int, orders, bits: int) -> Iterator[np.ndarray]:
    """Per order the buckets of the n-grams that start in the chunk at ``at``."""
    for n, hashes in zip(sorted(orders), hashes_of(points[at: at + CHUNK + max(orders) - 1], orders)):
        yield (hashes[: min(CHUNK, max(len(points) - at - n + 1, 0))] >> np.uint64(64 - bits)).astype(np.int64)


def counted(docs: DataFrame, orders=ORDERS, bits=BITS) -> DataFrame:
    """(lang, bucket, n) over the whole texts of labelled documents; bucket -1 counts the documents.

    Each task adds into one vector for each language and hands on what is not zero, so a language with any share of the
    rows costs no more than another.
    """
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                vector = seen.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                vector[-1] += 1
                points = code_points((text.as_py() or "").lower())
                for at in range(0, len(points), CHUNK):
                    for buckets in buckets_of(points, at, orders, bits):
                        vector[:-1] += np.bincount(buckets, minlength=1 << bits)
        for lang, vector in seen.items():
            at = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(
                np.where(at == 1 << bits, -1, at).astype(np.int32)), pa.array(vector[at])], ["lang", "bucket", "n"])

    return docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(batch, "lang string, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Counts by language and bucket as a written table, and the languages with their log priors, sorted by name."""

    rows: DataFrame
    languages: list[str]
    priors: np.ndarray
    bits: int
    alpha: float

    def matrix(self, languages: list[str]) -> np.ndarray:
        """Log probabilities, buckets by languages, of a group of languages."""
        own = self.rows.where(F.col("lang").isin(languages) & (F.col("bucket") >= 0)).select("lang", "bucket", "n").toArrow()
        counts = np.full((1 << self.bits, len(languages)), self.alpha, np.float64)
        place = pa.compute.index_in(own.column("lang"), pa.array(languages, pa.string())).to_numpy()
        counts[own.column("bucket").to_numpy(), place] += own.column("n").to_numpy()
        return (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)


def train(docs: DataFrame, orders=ORDERS, bits=BITS, alpha=ALPHA) -> Model:
    rows = written(counted(docs, orders, bits))
    sizes = sorted((r[0], r[1]) for r in rows.where("bucket = -1").select("lang", "n").collect())
    counts = np.array([n for _, n in sizes], dtype=np.float64)
    return Model(rows, [x for x, _ in sizes], np.log(counts / counts.sum()) if sizes else counts, bits, alpha)


STATE = "best string, top double, total double"


def scored(docs: DataFrame, matrix: np.ndarray, languages: list[str], priors: np.ndarray, orders, bits: int, last: bool) -> DataFrame:
    """(doc_id, text, STATE): the best language so far, its log probability and the sum of all relative to it; the ``last`` group
    leaves the text out."""
    carried = ["doc_id"] if last else ["doc_id", "text"]
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def posterior(text: str) -> np.ndarray:
        total, points = priors.copy(), code_points(text.lower())
        for at in range(0, len(points), CHUNK):
            for buckets in buckets_of(points, at, orders, bits):
                if len(buckets) < 4096:
                    total += shared.value[buckets].sum(axis=0, dtype=np.float64)
                else:
                    total += np.bincount(buckets, minlength=1 << bits) @ shared.value
        return total

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = list(zip(*(b.column(c).to_pylist() for c in ("best", "top", "total"))))
            at = 0
            for texts in batched(b.column("text")):
                for text in texts:
                    best, top, total = state[at]
                    if any(map(str.isalpha, text)):
                        here = posterior(text)
                        first = int(here.argmax())
                        if best is None or here[first] > top:
                            total = (0.0 if best is None else total * np.exp(top - here[first])) + np.exp(here - here[first]).sum()
                            best, top = languages[first], float(here[first])
                        else:
                            total += np.exp(here - top).sum()
                        state[at] = best, top, float(total)
                    at += 1
            best, top, total = (list(x) for x in zip(*state)) if state else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(best, pa.string()), pa.array(top, pa.float64()),
                                              pa.array(total, pa.float64())], [*carried, "best", "top", "total"])

    return docs.mapInArrow(batch, ", ".join(f"{c} {kind}" for c, kind in docs.dtypes if c in carried) + ", " + STATE)


def predict(docs: DataFrame, model: Model, orders=ORDERS) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone.

    A text becomes sparse bucket counts; their product with the broadcast log-probability matrix, plus the log priors,
    gives the posterior, whose largest entry is the score. ``und`` with score 0 for null texts, texts without a letter
    (Unicode category L) and a model without languages; ties go to the first language by name. Beyond ``GROUP`` languages
    texts meet one group after the other, with what is known so far written between.
    """
    state = docs.select("doc_id", "text", F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("top"), F.lit(0.0).alias("total"))
    for at in range(0, len(model.languages), GROUP):
        group = model.languages[at: at + GROUP]
        if at:
            state = written(state)
        state = scored(state, model.matrix(group), group, model.priors[at: at + GROUP], orders, model.bits,
                       at + GROUP >= len(model.languages))
    return state.select("doc_id", F.coalesce("best", F.lit("und")).alias("lang_pred"),
                        F.when(F.col("best").isNull(), 0.0).otherwise(1 / F.col("total")).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, then predict all: (doc_id, held_out, lang_pred, score).

    All labelled rows are learned from, whole; rows with a null doc_id count as not held out. Predictions see the text
    only. Repeated rows count and are predicted each; no labelled rows give ``und`` throughout; no rows give no rows;
    further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
