"""MinHash near-duplicates against comparing all sets, and what the index promises."""

import random

import numpy as np
import pytest

from credtrace.llm import minhash_join
from credtrace.llm.components import components
from tests.llm.cases import awkward, docs, sentence
from tests.llm.test_documents import expected_components, multiset


def expected(rows, size=4, percent=80):
    return multiset((i, n, c, i is None or i == c) for i, n, c in expected_components(rows, size, percent))


def result(frame):
    assert frame.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return multiset(frame.collect())


def test_against_all_pairs(spark):
    assert result(minhash_join.near_duplicates(docs(spark, awkward()))) == expected(awkward())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
    return " ".join(words)


def test_copies_of_all_degrees(spark):
    """Groups of copies from equal to unlike, many around the threshold; one group holds a third of all rows."""
    rng = random.Random(11)
    base = [sentence(rng, 120).split() for _ in range(40)]
    rows = [(k * 7 % 1500, changed(rng, base[0 if rng.random() < 1 / 3 else rng.randrange(40)], rng.randint(0, 9)), "en", "a") for k in range(1500)]
    assert result(minhash_join.near_duplicates(docs(spark, rows).repartition(6))) == expected(rows)


def test_shared_passage_without_links(spark):
    """A passage of half of each text brings documents to the same keys; only real copies link."""
    rng = random.Random(12)
    passage = sentence(rng, 100)
    rows = [(k, passage + " " + sentence(rng, rng.choice([15, 40, 90])), "en", "a") for k in range(500)]
    rows += [(1000 + k, rows[k][1] + " tail", "en", "b") for k in range(60)]
    assert result(minhash_join.near_duplicates(docs(spark, rows))) == expected(rows)


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(13)
    one, two = sentence(rng, 50), sentence(rng, 60)
    rows = [(5, one, "en", "a"), (5, two, "en", "a"), (5, two, "en", "a"), (7, one + " end", "en", "a"), (3, two + " end", "en", "a"), (None, one, "en", "a")]
    assert result(minhash_join.near_duplicates(docs(spark, rows))) == expected(rows)


def test_no_rows(spark):
    assert minhash_join.near_duplicates(docs(spark, [])).collect() == []


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (400, minhash_join.SYMBOLS)).astype(np.uint16)
    two = one.copy()
    for row in two:
        row[rng.choice(minhash_join.SYMBOLS, minhash_join.DISTANCE, replace=False)] ^= 1
    for a, b in zip(minhash_join.chunk_keys(one), minhash_join.chunk_keys(two)):
        assert np.intersect1d(a, b).size
    worst = one[:1].copy()  # two errors in every chunk but the last, which has one
    worst.reshape(minhash_join.CHUNKS, minhash_join.WIDTH)[:, :2] ^= 1
    worst.reshape(minhash_join.CHUNKS, minhash_join.WIDTH)[-1, 1] ^= 1
    assert (worst != one[0]).sum() == minhash_join.DISTANCE
    assert np.intersect1d(minhash_join.chunk_keys(worst), minhash_join.chunk_keys(one[:1])).size


def test_symbols_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(300):
        members = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)
        one, two = np.sort(members[:500]), np.sort(members[100:])  # 400 of 600 in common
        agree.append((minhash_join.signature(one) == minhash_join.signature(two)).sum())
    expected_mean, sd = minhash_join.SYMBOLS * 2 / 3, np.sqrt(minhash_join.SYMBOLS * 2 / 9)
    assert abs(np.mean(agree) - expected_mean) < 4 * sd / np.sqrt(300) and 0.85 * sd < np.std(agree) < 1.15 * sd
    assert minhash_join.missed() < 1e-5


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "path": [(k, k + 1) for k in range(200)],
             "star": [(77, k) for k in range(300)], "none": []}[kind] + [(None, 3), (3, None), (9, 9)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            label[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, root(x)) for x in label)
