"""Hard negatives against scoring every pair, and the intervals against true scores."""

import collections
import math

import duckdb
import numpy as np
import pytest

from credtrace.llm import hard_negatives, queries
from tools.check_oracle import TABLES, compare

SCHEMA = "vec_id long, embedding array<float>, label int, score double, list long, rank string, id int, mark int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, 1, "x", 2, 3) for i, v, l in rows], SCHEMA)


def every_pair(rows, every=100, n_positives=5, n_negatives=10, low=30, high=90):
    held = set()
    for i, v, l in rows:
        if None in (i, v, l) or any(x is None or not math.isfinite(x) for x in v):
            continue
        limit = hard_negatives.LIMIT
        q = tuple(max(-limit, min(limit, math.floor(256 * float(np.float32(x))))) for x in v)
        held.add((i, (l + 1) % 10 if i % 7 == 0 else l, q))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = collections.Counter()
    for a in held:
        if a[0] % every:
            continue
        own = sorted((-score(a, b), b[0], b[2]) for b in held if b[1] == a[1] and b[0] != a[0])[:n_positives]
        others = sorted((-score(a, b), b[0], b[2]) for b in held if b[1] != a[1])
        for p, positive, _ in own:
            inside = [(n, i) for n, i, _ in others if low * -p <= 100 * -n <= high * -p][:n_negatives]
            for rank, (n, i) in enumerate(inside, 1):
                out[a[0], positive, rank, i, -p, -n] += 1
    return out


def result(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def random_rows(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, dims))
    labels = rng.integers(0, 10, n)
    labels[rng.random(n) < 0.33] = 3
    return [(int(k), (centres[l] * spread + rng.standard_normal(dims)).astype(np.float32).tolist(), int(l)) for k, l in enumerate(labels)]


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_against_every_pair(spark, dims):
    rows = random_rows(600, dims, dims)
    assert result(hard_negatives.mine(table(spark, rows).repartition(5), every=20)) == every_pair(rows, every=20)


def test_awkward_rows(spark):
    rows = random_rows(150, 8, 5)
    rows += rows[:40]  # repeated rows
    rows += [(k, [1.0] * 8, 1) for k in range(1000, 1030)]  # ties
    rows += [(1000, [0.5] * 8, 2), (1001, [0.5] * 8, 1), (None, [1.0] * 8, 1), (1100, None, 1), (1200, [1.0] * 8, None), (1300, [], 4),
             (1400, [1.0, None] + [1.0] * 6, 1), (1500, [math.nan] * 8, 1), (1600, [math.inf] * 8, 1), (1700, [1.0, 2.0], 1), (-700, [0.3] * 8, 5),
             (1800, [1e30] * 8, 6), (1801, [3e5] * 8, 6), (1802, [-1e30] * 8, 7), (1900, [0.0] * 8, 8), (1901, [0.0] * 8, 8), (1902, [0.0] * 8, 9)]
    got = hard_negatives.mine(table(spark, rows).repartition(4), every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert result(got) == every_pair(rows, every=10)


def test_chunks_of_anchors(spark):
    rows = random_rows(300, 16, 9)
    assert result(hard_negatives.mine(table(spark, rows), every=5, chunk=7)) == every_pair(rows, every=5)


def test_no_rows_and_vectors_without_components(spark):
    assert hard_negatives.mine(table(spark, [])).collect() == []
    assert hard_negatives.mine(table(spark, [(100, None, 1)])).collect() == []
    rows = [(0, [], 1), (1, [], 2), (2, [], 2), (3, [], 1)]
    assert result(hard_negatives.mine(table(spark, rows))) == every_pair(rows)


def test_intervals_hold_the_scores_and_leave_few():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.standard_normal((2000, 64)) * 32).astype(np.int64)
    anchors = hard_negatives.Anchors.of(np.arange(20), np.zeros(20), vectors[:20])
    estimate, half = anchors.intervals(slice(0, 20), *hard_negatives.coded(vectors))
    truth = vectors[:20] @ vectors.T
    assert (np.abs(truth - estimate) <= half).all()
    bar = hard_negatives.kth_largest(np.where(np.arange(2000) >= 20, truth, -np.inf), 5)
    assert (estimate + half >= bar[:, None]).mean() < 0.1


def test_given_embeddings_against_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(spark, con, "op12_hard_negatives", queries.Q["op12_hard_negatives"], hard_negatives.SQL, sf).startswith("OK")
