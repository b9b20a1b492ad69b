"""The operators over documents against brute force, on rows with nulls, copies, ties, long and empty texts."""

import collections
import hashlib
import math
import re
import unicodedata
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from credtrace.llm import decontaminate, language_id, licences, line_dedup, mixing, ngram_join, quality, queries, toxicity
from tests.llm.cases import awkward, docs, sentence

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, awkward()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def expected_components(rows, size, percent):
    sets = []
    for i, text, *_ in rows:
        w = re.findall(WORD, (text or "").translate(LOWER))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), None if i is None else least[root(k)]) for k, (i, *_) in enumerate(rows)]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, table, size, percent):
    assert multiset(ngram_join.classes(table, size, percent).collect()) == multiset(expected_components(awkward(), size, percent))


def test_ngram_join_large_group(spark):
    import random
    rng = random.Random(5)
    base = [sentence(rng, 90).split() for _ in range(3)]
    rows = []
    for k in range(1200):
        w = list(base[k % 3])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((k * 7 % 1200, " ".join(w), "en", "a"))
    got = multiset(ngram_join.classes(docs(spark, rows), 3, 90).collect())
    assert got == multiset(expected_components(rows, 3, 90))


def test_ngram_join_keeps_one(spark, table):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(table, 3, 90).collect()]
    wanted = {c for i, n, c in expected_components(awkward(), 3, 90) if n and i is not None} | {4, 5, 6}
    assert sorted(x for x in kept if x is not None) == sorted(wanted) and kept.count(None) == 2


def expected_hits(rows, bench, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = re.findall(pattern, (text or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(item)
    out = []
    for i, text, *_ in rows:
        w, hit, items = re.findall(pattern, (text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])]
        ids = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, table):
    base = awkward()[0][1].split()
    bench = [(1, " ".join(base[5:25])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, "one"), (1, " ".join(base[40:50])), (None, "this line stands"),
             (6, "stands on every site of the net"), (12, " ".join(base[41:51])), (7, "É é x")]
    items = spark.createDataFrame([(a, b, 1) for a, b in bench], "item_id long, text string, n_words int")
    got = decontaminate.decontaminate(table, items).drop("item_ids").collect()
    assert multiset(got) == multiset(expected_hits(awkward(), bench))
    assert decontaminate.decontaminate(table, items.limit(0)).where("contaminated").isEmpty()
    kept = decontaminate.clean(table, items)
    assert kept.columns == table.columns
    assert multiset(kept.select("doc_id", "text").collect()) == multiset(
        (i, text) for (i, text, *_), r in zip(awkward(), expected_hits(awkward(), bench)) if not r[5])


def test_decontamination_keeps_clean_rows_that_share_an_id(spark):
    import random
    rng = random.Random(6)
    item, clean = sentence(rng, 12), [sentence(rng, 20) for _ in range(4)]
    rows = [(None, item, "en", "a"), (None, clean[0], "en", "a"), (None, None, "en", "a"), (6, item + " more", "en", "a"), (6, clean[1], "en", "b"),
            (6, clean[1], "en", "b"), (7, clean[2], "en", "a"), (8, item, "en", "a")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean(docs(spark, rows), items).select("doc_id", "text").collect()
    assert multiset(kept) == multiset([(None, clean[0]), (None, None), (6, clean[1]), (6, clean[1]), (7, clean[2])])


def test_winnowing_finds_every_span(spark):
    import random
    rng = random.Random(3)
    bench = [(k, sentence(rng, rng.randint(10, 60))) for k in range(20)]
    rows = []
    for k in range(60):
        item = bench[k % 20][1].split()
        at, n = rng.randrange(len(item) - 9), rng.randint(8, 14)
        rows.append((k, " ".join([sentence(rng, rng.randint(0, 30)), *item[at:at + n], sentence(rng, 20)]), "en", "a"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert multiset(decontaminate.decontaminate(docs(spark, rows), items).drop("item_ids").collect()) == multiset(expected_hits(rows, bench))


def norm(line):
    return " ".join(re.findall(WORD, line)).lower()


def test_line_dedup(spark, table):
    sites, first = collections.defaultdict(set), {}
    for i, text, _, s in awkward():
        for line in (text or "").split("\n"):
            if len(norm(line).split()) >= 3:
                sites[norm(line)].add(s)
                if i is not None:
                    first[norm(line)] = min(i, first.get(norm(line), i))
    wanted = []
    for i, text, _, s in awkward():
        lines = None if text is None else [x for x in text.split("\n") if len(norm(x).split()) < 3 or len(sites[norm(x)]) < 4 or (
            i is not None and first[norm(x)] == i)]
        wanted.append((i, None if lines is None else "\n".join(lines)))
    got = line_dedup.dedupe(table)
    assert multiset(got.select("doc_id", "text").collect()) == multiset(wanted)
    assert set(table.columns) < set(got.columns) and got.where("text IS NOT NULL AND n_chars <> length(text)").isEmpty()
    assert any(t is not None and "this line stands" not in t for _, t in wanted)


def test_line_dedup_sketch_and_count_agree(spark):
    rows = [(k * 100 + s, f"shared by {k} of the sites", "en", f"site{s}") for k in (2, 3, 4, 5, 9, 12, 40, 300) for s in range(k)]
    got = line_dedup.dedupe(docs(spark, rows), lg_k=4).where("n_removed > 0").select("text", "doc_id").collect()
    assert len(got) == sum(k - 1 for k in (4, 5, 9, 12, 40, 300))


def test_line_dedup_near_a_high_threshold(spark):
    rows = [(k * 100 + s, f"shared by {k} of the sites", "en", f"site{s}") for k in (3, 8, 9, 10, 11, 12, 40, 300) for s in range(k)]
    got = line_dedup.dedupe(docs(spark, rows), min_sites=10, lg_k=4).where("n_removed > 0").select("text", "doc_id").collect()
    assert len(got) == sum(k - 1 for k in (10, 11, 12, 40, 300))


def test_line_dedup_leaves_a_column_of_its_own_name(spark):
    rows = [(k, "a line that all the sites have", "en", f"s{k}") for k in range(6)]
    table = docs(spark, rows).withColumn("n_removed", F.lit("mine"))
    counted = line_dedup.dedupe(table)
    assert counted.columns.count("n_removed") == 1 and {r[0] for r in counted.select("n_removed").collect()} == {0, 1}
    plain = line_dedup.dedupe(table, count=None)
    assert plain.columns == table.columns and {r[0] for r in plain.select("n_removed").collect()} == {"mine"}


def test_quality(spark, table):
    counts, hosts = collections.Counter(), collections.Counter()
    for i, text, _, s in awkward():
        hosts[s] += 1
        counts.update({(s, norm(x)) for x in (text or "").split("\n") if norm(x)})
    wanted = []
    for i, text, _, s in awkward():
        w = re.findall(WORD, text or "")
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        often = collections.Counter(tri)
        repeat = {k + j for k, t in enumerate(tri) if often[t] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if norm(x)]
        gone = sum(len(norm(x).split()) for x in lines if counts[(s, norm(x))] > 1 and counts[(s, norm(x))] * 100 > hosts[s] * 40)
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        wanted.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), gone,
                       failed, not failed and 100 * gone <= 20 * len(w)))
    got = quality.judge(table, min_docs=1, max_docs_percent=40, max_removed_percent=20).collect()
    assert multiset(got) == multiset(wanted)
    assert any(r["removed_words"] > 0 for r in got)


def test_quality_rejects_depleted_documents_under_the_given_limits(spark):
    """Documents that pass the base rules and share most of their words, line by line, with others of their host."""
    import random
    rng = random.Random(10)
    shared = [sentence(rng, 20) for _ in range(4)]
    rows = [(k, "\n".join([*shared, sentence(rng, 30)]), "en", "hot") for k in range(4)]
    rows += [(10 + k, "\n".join([*shared, sentence(rng, 30)]), "en", "few") for k in range(3)]
    rows += [(100 + k, sentence(rng, 90), "en", "hot") for k in range(600)]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, rows)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {k for k, r in got.items() if not r["kept"]} == {0, 1, 2, 3} and got[0]["removed_words"] == 80


def test_mixing(spark, table):
    got = mixing.mix(table).collect()
    sizes, total = collections.Counter(), 0
    for i, text, _, s in awkward():
        sizes[s] += len(re.findall(WORD, text or ""))
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        price = left / sum(weight[s] for s in names if s not in full) if len(full) < len(names) else 0
        more = {s for s in names if s not in full and price * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for r in got:
        want = 3 * sizes[r["source"]] if r["source"] in full else price * weight[r["source"]]
        assert r["target"] == pytest.approx(want) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0) == (r["position"] > 1 or r["copies"] == 0)
        taken[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in names}
    assert all(abs(taken[r["source"]] - r["target"]) <= largest[r["source"]] for r in got)
    assert multiset(mixing.mix(table.repartition(5)).collect()) == multiset(got)


def test_curriculum_inverts_its_schedule(spark):
    for k, knots in enumerate(mixing.SCHEDULES):
        for share in (0.0, 0.1, 0.5, 0.77, 0.999):
            from pyspark.sql import functions as F
            t = spark.range(1).select(mixing.time_of(F.lit(share), F.lit(k))).first()[0]
            grid = [n / 20000 for n in range(20001)]
            weight = [next(w0 + (w1 - w0) * (x - a) / (b - a) for (a, w0), (b, w1) in zip(knots, knots[1:]) if x <= b) for x in grid]
            assert sum(w for x, w in zip(grid, weight) if x < t) / sum(weight) == pytest.approx(share, abs=2e-3)


def test_languages(spark):
    import random
    rng = random.Random(2)
    stems = {"en": "the and ing", "de": "der sch keit", "fr": "eau oux que"}
    rows = []
    for k in range(300):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((k, " ".join("".join(rng.choice(stems[lang].split()) for _ in range(2)) for _ in range(30)), lang if k % 10 else None, "a"))
    rows += [(900, None, "en", "a"), (901, "12 34 !", "en", "a"), (902, "", None, "a"), (None, "der schkeit der keit", None, None)]
    got = language_id.identify(docs(spark, rows)).collect()
    truth = {k: ("en", "de", "fr")[k % 3] for k in range(300)}
    assert len(got) == len(rows)
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if r["doc_id"] in (900, 901, 902) else truth.get(r["doc_id"], "de"))


def plain_language_model(rows, orders=language_id.ORDERS, bits=language_id.BITS, alpha=language_id.ALPHA):
    """Predictions of (text) by naive Bayes in dictionaries over the learned (text, lang) rows."""
    mask = (1 << 64) - 1

    def buckets(text):
        points = [ord(c) for c in text.lower()]
        for at in range(len(points)):
            h = 1
            for k in range(max(orders)):
                if at + k >= len(points):
                    break
                h = ((h ^ points[at + k]) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 29
                if k + 1 in orders:
                    yield ((h * 0xD6E8FEB86659FD93) & mask) >> (64 - bits)

    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        counts[lang].update(buckets(text or ""))
        sizes[lang] += 1
    totals = {lang: sum(c.values()) + alpha * (1 << bits) for lang, c in counts.items()}

    def predict(text):
        if not any(unicodedata.category(c).startswith("L") for c in text or ""):
            return "und", 0.0
        logs = {lang: math.log(n / sum(sizes.values())) for lang, n in sizes.items()}
        for b, n in collections.Counter(buckets(text)).items():
            for lang in logs:
                logs[lang] += n * math.log((counts[lang][b] + alpha) / totals[lang])
        best = min(logs, key=lambda x: (-logs[x], x))
        return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())
    return predict


def test_languages_against_plain_naive_bayes(spark, monkeypatch):
    """On given documents, many languages in several groups, signs that are no letters, and repeated rows."""
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in given] + [(5000 + k, f"wort{k} " * 9, f"x{k:02d}", "a") for k in range(12)]
    rows += [(6000, "½ ² ⅓ Ⅷ ①", None, "a"), (6001, "½ é", None, "a"), *[(given[0]["doc_id"], given[0]["text"], given[0]["lang"], "a")] * 2]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    predict = plain_language_model([(t, l) for i, t, l, _ in rows if l is not None and not held(i)])
    want = collections.Counter((i, held(i), predict(t)[0]) for i, t, *_ in rows)
    for group in (100, 5):
        monkeypatch.setattr(language_id, "GROUP", group)
        got = language_id.identify(docs(spark, rows)).collect()
        assert collections.Counter((r["doc_id"], r["held_out"], r["lang_pred"]) for r in got) == want
        scores = {i: predict(t)[1] for i, t, *_ in rows}
        assert all(r["score"] == pytest.approx(scores[r["doc_id"]], abs=1e-3) for r in got)


def test_held_out_accuracy_on_given_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").collect()}
    got = [r for r in queries.op6_language_id(spark, sf).where("held_out").collect() if r["doc_id"] in truth]
    assert len(got) > 1000 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    found = [(toxic[r["doc_id"]], r["predicted"]) for r in queries.op10_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in toxic]
    hits = collections.Counter(found)
    assert hits[1, 1] >= 0.8 * (hits[1, 1] + hits[1, 0]) and hits[0, 0] >= 0.97 * (hits[0, 0] + hits[0, 1])


def test_toxicity_ratios_against_plain_counts(spark):
    """Documents of each class that hold a bucket, counted text by text; repeated documents count each."""
    rows = [(k, t, "en", "a") for k, t in enumerate(["bad word here", "good word here", "", "bad bad", "another good one"])]
    rows += [rows[0]]
    truth = {0: 1, 1: 0, 2: 0, 3: 1, 4: 0}
    frame = docs(spark, rows).join(spark.createDataFrame(list(truth.items()), "doc_id long, toxic int"), "doc_id")
    clean, toxic, sizes = toxicity.bucket_counts(frame)
    want = [collections.Counter(), collections.Counter()]
    for i, t, *_ in rows:
        want[truth[i]].update({int(b) for _, buckets in toxicity.chunks_of(t) for b in buckets})
    for vector, counter in zip((clean, toxic), want):
        assert {int(b): int(vector[b]) for b in vector.nonzero()[0]} == counter
    assert sizes.tolist() == [3, 3]


def test_toxicity_fits_one_text_of_an_id(spark):
    """An id that is repeated often is one row of the sample."""
    rows = [(1, "vile thing", "en", "a")] * 300 + [(k, f"plain talk {k}", "en", "a") for k in range(3, 40)]
    labels = spark.createDataFrame([(1, 1), *((k, 0) for k in range(3, 40))], "doc_id long, toxic int")
    got = toxicity.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_ngrams_of_a_sample_are_numbered():
    import numpy as np
    import pyarrow as pa
    sets = [np.array(x, np.int64) for x in ([-5, 1, 7], [], [1, 9], [-5, 1])]
    grams, places, starts = toxicity.numbered(pa.chunked_array([pa.array([s.tobytes() for s in sets], pa.binary())]))
    assert grams.tolist() == [-5, 1] and places.tolist() == [0, 1, -1, 1, -1, 0, 1] and starts.tolist() == [0, 3, 3, 5, 7]


def test_long_text_is_read_whole(spark):
    rows = [(1, "aaa bbb " * 300, "x", "a"), (3, "ccc ddd " * 300, "y", "a"), (4, "aaa bbb " * 10 + "ccc ddd " * 150000, None, "a")]
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs(spark, rows)).collect()}[4] == "y"


def test_toxicity(spark):
    import random
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(500):
        w, bad = sentence(rng, 60).split(), k % 5 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["vilewort", "nastyword"])
        rows.append((k, " ".join(w), "en", "a"))
        labels.append((k, 1, int(bad), "x"))
    rows += [(900, None, None, None), (901, "", None, None), (None, "vilewort and more", None, None), (902, sentence(rng, 40000), "en", "a")]
    truth = spark.createDataFrame(labels + [(0, 0, 0, "again"), (None, 1, 1, "z"), (900, 1, None, "z")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.classify(docs(spark, rows), truth).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    wrong = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and r["predicted"] != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 5
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in (900, 901, 902, None)} == {900: 0, 901: 0, 902: 0, None: 1}
    assert toxicity.classify(docs(spark, rows), truth.limit(0)).where("predicted = 1").isEmpty()


def test_licences(spark):
    rows = [(1, "code\nReleased under the MIT License.\nmore", "en", "a"), (102, "Licensed under CC BY-NC 4.0.", "en", "a"), (103, "text alone", "en", "a"),
            (104, None, "en", "a"), (2, "no notice here", "en", "a"), (305, "mit und ohne", "de", "b"), (None, "All rights reserved.", "en", "a"),
            (106, "Licensed under the Apache License, Version 2.0.\n" + "word " * 200, "en", "a")]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, rows), licences.document_path()).collect()}
    assert {k: r["licence"] for k, r in got.items()} == {1: "MIT", 102: "CC-BY-NC-4.0", 103: "CC-BY-NC-4.0", 104: "CC-BY-NC-4.0", 2: "MIT", 305: None,
                                                       None: "Proprietary", 106: "Apache-2.0"}
    assert got[103]["inherited_from"] == "a/en/1" and got[106]["n_statements"] == 1


def test_nothing_in_nothing_out(spark, nothing):
    empty_labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for frame in (ngram_join.classes(nothing), decontaminate.decontaminate(nothing, items), line_dedup.dedupe(nothing), quality.judge(nothing),
                  mixing.mix(nothing), language_id.identify(nothing), toxicity.classify(nothing, empty_labels),
                  licences.scan(nothing, licences.document_path())):
        assert frame.isEmpty()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    from tools.check_oracle import TABLES, compare
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(spark, con, name, queries.Q[name], queries.ORACLE[name], SF).startswith("OK")
