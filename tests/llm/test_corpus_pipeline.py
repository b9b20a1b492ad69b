"""The stages of the corpus pipeline at the values that the pipeline sets."""

import collections
import math
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credtrace.llm import mixing, toxicity
from credtrace.llm.common import written
from tests.llm.cases import awkward, docs, sentence
from tests.llm.test_documents import LOWER, expected_hits


def hot_source_passages(copies, passages=40):
    """Documents with one passage each; of 20 sources the first holds a third of all rows. Also the sites of each passage."""
    rng = random.Random(7)
    rows, sites = [], collections.defaultdict(set)
    for p in range(passages):
        passage = sentence(rng, 60)
        for _ in range(copies):
            source = "s0" if rng.random() < 1 / 3 else f"s{rng.randint(1, 19)}"
            rows.append((len(rows), sentence(rng, 20) + "\n" + passage, "en", source))
            sites[passage].add(source)
    return rows, sites


def test_passages_of_a_hot_source_are_removed(spark):
    for copies in (12, 15, 20):
        rows, sites = hot_source_passages(copies)
        assert any(len(s) < 10 for s in sites.values())
        kept = collections.Counter(line for r in corpus_pipeline.cross_site_lines(spark, docs(spark, rows), None).collect()
                                   for line in r["text"].split("\n")[1:])
        assert kept == {p: 1 if len(s) >= 4 else copies for p, s in sites.items()}
        assert sum(n == 1 for n in kept.values()) == len(sites)


def test_plain_copies_on_three_sites_stay(spark):
    rng = random.Random(8)
    text = sentence(rng, 30)
    rows = [(k, text, "en", f"s{k % 3}") for k in range(30)]
    assert {r["text"] for r in corpus_pipeline.cross_site_lines(spark, docs(spark, rows), None).collect()} == {text}


def test_every_copy_has_its_place(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, rng.randint(1, 40)), "en", "hot" if k < 400 else f"s{k % 5}") for k in range(500)]
    table = docs(spark, rows + [(900, None, "en", "hot"), (901, "", "en", "s1")])
    first = {r["doc_id"]: r for r in mixing.mix(table).collect()}
    got = corpus_pipeline.training_mix(spark, table, None).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    copies = collections.defaultdict(list)
    for r in got:
        copies[r["doc_id"]].append(r)
    assert set(copies) == set(first) and sum(r["taken"] for r in got) == sum(r["taken"] for r in first.values())
    for i, own in copies.items():
        assert [r["copy"] for r in own] == list(range(1, first[i]["copies"] + 1)) or [r["copy"] for r in own] == [first[i]["copies"]] == [0]
        assert own[0]["position"] == first[i]["position"]
    full = {r["source"] for r in got if r["target"] == 3 * r["source_size"]}
    assert full
    ranks = {s: k for k, s in enumerate(sorted({r["source"] for r in got}))}
    for source in full:  # the words that are due by a time follow the whole schedule, not its first third
        knots = mixing.SCHEDULES[ranks[source] % 3]
        due, whole = 0, sum(r["taken"] for r in got if r["source"] == source)
        area = lambda t: sum((min(t, b) - a) * (2 * u + (v - u) * (min(t, b) - a) / (b - a)) / 2 for (a, u), (b, v) in zip(knots, knots[1:]) if t > a)
        for r in got:
            if r["source"] == source and r["copy"]:
                due += r["taken"]
                assert (due - r["taken"] / 2) / whole == pytest.approx(area(r["position"]) / area(1.0), abs=1e-6)


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(rows, size, percent):
    """Smallest id of the group of each (id, text): by comparing sets that share a shingle."""
    by_set, label = {}, {}
    for i, text in rows:
        by_set.setdefault(sets_of(text, size), []).append(i)
    sets = [s for s in by_set if s]
    above = list(range(len(sets)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    shared = collections.Counter()
    for own in holders.values():
        shared.update((a, b) for n, a in enumerate(own) for b in own[n + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            above[root(a)] = root(b)
    least = {}
    for k, s in enumerate(sets):
        least[root(k)] = min([least.get(root(k), math.inf), *by_set[s]])
    for k, s in enumerate(sets):
        label.update({i: least[root(k)] for i in by_set[s]})
    return {i: label.get(i, i) for i, _ in rows}


def plain_stage(name, rows, sf):
    """What a stage has to make of (doc_id, text, source) rows; the classifier's verdicts are tested with it."""
    if name == "line_dedup":
        norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()
        sites, first = collections.defaultdict(set), {}
        for i, text, source in rows:
            for x in (text or "").split("\n"):
                sites[norm(x)].add(source)
                first[norm(x)] = min(i, first.get(norm(x), i))
        stays = lambda i, x: len(norm(x).split()) < 3 or len(sites[norm(x)]) < 4 or first[norm(x)] == i
        return [(i, None if t is None else "\n".join(x for x in t.split("\n") if stays(i, x)), s) for i, t, s in rows]
    if name == "near_copies":
        label = groups([(i, t) for i, t, _ in rows], 5, 80)
        return [r for r in rows if label[r[0]] == r[0]]
    if name == "decontamination":
        bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
        return [r for r, hit in zip(rows, expected_hits(rows, bench)) if not hit[5]]
    raise KeyError(name)


def test_whole_pipeline_against_plain_stages(spark):
    """Every stage on what the stage before kept, whole tables; the last one by its own test and the ids it places."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in toxicity.classify(table, labels).where("predicted = 0").collect()}
    frame = written(corpus_pipeline.without_toxic(spark, table, sf))
    assert {r["doc_id"] for r in frame.select("doc_id").collect()} == kept and 0 < len(kept) < table.count()
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
        frame = written(stage(spark, frame, sf))
        assert frame.columns == table.columns
        want = plain_stage(name, rows, sf)
        assert sorted(tuple(r) for r in frame.select("doc_id", "text", "source").collect()) == sorted(want), name
        assert name == "line_dedup" or len(want) < len(rows)
    last = corpus_pipeline.training_mix(spark, frame, sf)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in frame.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, last.collect()))


def test_stages_take_empty_tables(spark):
    empty = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").isEmpty(), name


def test_awkward_rows_through_every_stage(spark):
    """Nulls, copies, long texts and clashing columns; every stage but the last keeps all columns."""
    frame = docs(spark, awkward()).withColumn("n_removed", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = frame.columns
        frame = written(stage(spark, frame, "/root/testdata/sf0.001"))
        assert frame.columns == columns
    assert corpus_pipeline.training_mix(spark, frame, None).count() > 0
