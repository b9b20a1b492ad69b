"""N-gram Jaccard join of documents by signature trees."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credtrace.llm.common import text_hash, written
from credtrace.llm.components import components
from credtrace.llm.shingles import mixed, shingle_sets
from credtrace.llm.signature_tree import links

SIZE, PERCENT = 3, 90
#: Sets of one side of a task.
TASK_SETS = 384
#: Bits of the bitmap that tells keys of one document from shared ones; 2 MB at any size of the corpus.
MAP_BITS = 24


def routing_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set such that any two sets that link have one in common.

    The hash space is cut into ranges, as many for all sets of a size class [2^c, 2^(c + 1)); what a range holds is a
    token. Linked sets of n and l hashes differ in d <= (n + l)(100 - p) / (100 + p) of them, so in at most d tokens, and
    under any common order one of the first d + 1 tokens of each is shared. Fuller ranges come first in the order, as
    they say more. A set with fewer than d + 1 ranges that hold something gives its floor(n(100 - p) / 100) + 1 smallest
    hashes as well: two sets that share only empty ranges both do, and share one of these. A set takes part in its own
    class and in that of its largest partner.
    """
    n, keys = len(members), []
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(members))])
    largest = n * 100 // percent
    for number in range(n.bit_length() - 1, largest.bit_length()):
        high = (2 << number) - 1
        ranges = 2 * high * (100 - percent) // (100 + percent) + 1
        edges = (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(members, edges), [n]])
        held = np.flatnonzero(at[1:] > at[:-1])
        tokens = mixed((running[at[held + 1]] - running[at[held]]) ^ mixed(np.uint64(number << 40) + held.astype(np.uint64) + np.uint64(1)))
        needed = (100 - percent) * (n + min(high, largest)) // (100 + percent) + 1
        if len(tokens) > needed:
            tokens = tokens[np.lexsort((tokens, at[held] - at[held + 1]))[:needed]]
        elif len(tokens) < min(needed, ranges):
            keys.append(members[: n * (100 - percent) // 100 + 1])
        keys.append(tokens)
    return np.unique(np.concatenate(keys))


def sketch(members: np.ndarray) -> bytes:
    """A byte for each of about n / 4 ranges of the hash space: the sum of the range's hashes. Two bytes of neighbours
    add up to the byte of both ranges, so a longer sketch folds to the length of a shorter one."""
    bits = max(3, int(np.log2(len(members) / 4 + 1) + 0.5))
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    at = np.concatenate([[0], np.searchsorted(members, edges), [len(members)]])
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(members ^ np.uint64(0x2545F4914F6CDD1D)))])
    return (running[at[1:]] - running[at[:-1]]).astype(np.uint8).tobytes()


def folded(one: np.ndarray, length: int) -> np.ndarray:
    while one.shape[-1] > length:
        one = one[..., 0::2] + one[..., 1::2]
    return one


def keyed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, key) of documents with words."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [routing_keys(s, percent) if len(s) else s for s in shingle_sets(b.column("text"), size)]
            ends = np.cumsum([0] + [len(k) for k in keys])
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(flat.astype(np.uint64).view(np.int64)))], ["doc_id", "keys"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(batch, "doc_id long, keys array<long>").select(
        "doc_id", F.explode("keys").alias("key"))


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, one, two, sketch): size of a document's set, its 128-bit fingerprint and its sketch."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, one, two, sketches = [], [], [], []
            for s in shingle_sets(b.column("text"), size):
                counts.append(len(s))
                one.append(mixed(s).sum(dtype=np.uint64))
                two.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sketches.append(sketch(s) if len(s) else b"")
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                       pa.array(np.array(two, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "one", "two", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(batch, "doc_id long, n_shingles long, one long, two long, sketch binary")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(cid, hashes) of documents."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for k, s in enumerate(shingle_sets(b.column("text"), size)):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["cid", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(batch, "cid long, hashes binary")


TASK = ["block", "left", "right"]


def possible_links(sketches: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, a: np.ndarray, b: np.ndarray,
                   percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest, by place, of the pairs between a and b that may link: every range whose bytes differ holds a
    difference, and linked sets differ in at most (100 - p) / (100 + p) of their sizes together."""
    above = list(range(len(sizes)))

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    lengths = np.array([len(x) for x in sketches])
    for length in np.unique(lengths[b]):
        others = b[lengths[b] == length]
        narrowed = {int(length): np.array([sketches[k] for k in others])}
        for k in a.tolist():
            short = int(min(length, lengths[k]))
            if short not in narrowed:
                narrowed[short] = folded(narrowed[int(length)], short)
            near = (narrowed[short] != folded(sketches[k], short)).sum(axis=1) <= (100 - percent) * (sizes[k] + sizes[others]) // (100 + percent)
            near &= (labels[others] != labels[k]) & (np.minimum(sizes[k], sizes[others]) * 100 >= percent * np.maximum(sizes[k], sizes[others]))
            for other in others[near].tolist():
                if root(k) != root(other):
                    above[root(other)] = root(k)
                    yield k, other


def possible(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each task of (..., side, cid, label, n, sketch) a spanning forest of the pairs that may link."""
    def task(table: pa.Table) -> pa.Table:
        sketches = [np.frombuffer(x, dtype=np.uint8) for x in table.column("sketch").to_pylist()]
        sizes, labels, sides, ids = (table.column(c).to_numpy() for c in ("n", "label", "side", "cid"))
        one, two, open_ones = (np.flatnonzero(sides == k) for k in range(3))
        found = [*possible_links(sketches, sizes, labels, one, two, percent), *possible_links(sketches, sizes, labels, open_ones, open_ones, percent)]
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in found], pa.int64()), "b": pa.array([int(ids[y]) for _, y in found], pa.int64())})

    return tasks.groupBy(*TASK).applyInArrow(task, "a long, b long")


def verified(tasks: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) inside tasks of (block, left, right, side, cid, label, hashes), each a bounded group."""
    def task(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        found = list(links(sets, *(table.column(c).to_numpy() for c in ("cid", "label", "side")), percent))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return tasks.groupBy(*TASK).applyInArrow(task, "a long, b long")


def with_sets(tasks: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of the tasks (block, left, right, side, cid, label). Texts of their documents are read again; Spark
    broadcasts the ids only while they are few."""
    tasks = written(tasks.select(*TASK, "side", "cid", "label"))
    ids = written(tasks.select(F.col("cid").alias("doc_id")).distinct())
    sets = sets_of(docs.join(ids, "doc_id", "left_semi"), size)
    return written(verified(tasks.join(sets, "cid").select(*TASK, "side", "cid", "label", "hashes"), percent))


def parts(count, size: int):
    return F.ceil(count / F.lit(size)).cast("int")


#: Rows of a pivot with many partners are spread over so many hash slices when they are joined with their count.
SALTS = 64


def star_tasks(members: DataFrame, size: int = TASK_SETS) -> DataFrame:
    """Every member of a group against the smallest member of the group, which stands in each part of a large group."""
    pairs = members.where("cid <> pivot").select("pivot", "cid").distinct()
    large = pairs.groupBy("pivot").agg(parts(F.count(F.lit(1)), size).alias("n_parts")).where("n_parts > 1")
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = pairs.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(salted, ["pivot", "salt"], "left").select(
        F.col("pivot").alias("block"), "cid", F.pmod(F.xxhash64("cid", F.lit(1)), F.coalesce("n_parts", F.lit(1))).cast("int").alias("left"),
        F.lit(1).alias("side"))
    heads = pairs.select("pivot").distinct().join(large, "pivot", "left").select(
        F.col("pivot").alias("block"), F.col("pivot").alias("cid"),
        F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1)).alias("left"), F.lit(0).alias("side"))
    return placed.unionByName(heads).select("block", "left", F.lit(0).alias("right"), "side", "cid", F.col("cid").alias("label"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of (cid, ...) with the label of their component; what has no link is its own."""
    return rows.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label, open): the groups that still hold several components after their smallest member has met all.

    Members of the smallest member's component are settled, the others open. Groups with the same members are taken once.
    """
    pivots = labelled(members.where("cid = pivot").select("key", "cid"), labels).select("key", F.col("label").alias("pivot_label"))
    named = written(labelled(members.where("cid <> pivot"), labels).join(pivots, "key").select(
        "key", "cid", "label", (F.col("label") != F.col("pivot_label")).cast("int").alias("open")))
    groups = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("n_open"), F.min("cid").alias("low"),
                                      F.max("cid").alias("high"), F.bit_xor(F.xxhash64("cid")).alias("mark")).where("n_open > 0 AND n > 1")
    chosen = groups.groupBy("n", "n_open", "low", "high", "mark").agg(F.min("key").alias("key"))
    return named.join(chosen.select("key"), "key")


def pair_tasks(named: DataFrame, size: int = TASK_SETS) -> DataFrame:
    """Tasks in which the open members of each group of (key, cid, label, open) meet the settled ones and each other, part
    by part; settled ones do not meet again."""
    sizes = named.groupBy("key").agg(F.sum(1 - F.col("open")).alias("n_settled"), F.sum("open").alias("n_open")).where("n_open > 0")
    rows = named.join(sizes, "key").withColumns({"s": parts(F.col("n_settled"), size), "o": parts(F.col("n_open"), size)})
    mine = F.xxhash64("cid")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    settled = rows.where("open = 0").select("key", "cid", "label", F.pmod(mine, F.col("s")).cast("int").alias("left"),
                                            F.explode(every(F.col("o"))).alias("right"), F.lit(0).alias("side"))
    facing = rows.where("open = 1").withColumn("part", F.pmod(mine, F.col("o")).cast("int"))
    against = facing.where("s > 0").select("key", "cid", "label", F.explode(every(F.col("s"))).alias("left"), F.col("part").alias("right"),
                                           F.lit(1).alias("side"))
    among = facing.select("key", "cid", "label", "part", F.explode(every(F.col("o"))).alias("other")).select(
        "key", "cid", "label", (-1 - F.least("part", "other")).alias("left"), F.greatest("part", "other").alias("right"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"))
    return settled.unionByName(against).unionByName(among).select(F.col("key").alias("block"), "left", "right", "side", "cid", "label")


def clusters(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label, open): groups that possible links hold together; the largest component of a group is settled."""
    named = written(labelled(components(edges).select(F.col("label").alias("key"), F.col("node").alias("cid")), labels))
    main = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("of_key")).agg(
        F.max(F.struct("n", "label")).alias("m"))
    return named.join(main, F.col("key") == F.col("of_key")).select(
        "key", "cid", "label", (F.col("label") != F.col("m.label")).cast("int").alias("open"))


def shared_keys(docs: DataFrame, narrow: DataFrame, named: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, pivot, cid): the classes of each key that several classes have, and the smallest of them.

    Most keys belong to one document. They are told by their smallest and largest document, which combine before the
    shuffle, and marked in a bitmap of fixed size; only rows whose bit is set are shuffled again to list the members.
    """
    rows = keyed(docs, size, percent)
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    groups = written(groups.select("key"))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << MAP_BITS)).cast("int")
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))
    marks = groups.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    candidates = rows.join(F.broadcast(marks), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("key", "doc_id")
    members = candidates.join(groups, "key")
    owner = narrow.where("doc_id IS NOT NULL").join(named.drop("sketch"), ["n_shingles", "one", "two"]).select("doc_id", "cid").distinct()
    members = members.join(owner, "doc_id").select("key", "cid").distinct()
    pivots = members.groupBy("key").agg(F.min("cid").alias("pivot"), F.max("cid").alias("top")).where("pivot < top")
    return members.join(pivots.select("key", "pivot"), "key").select("key", "pivot", "cid")


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Method. Documents with equal sets are one class, named by its smallest doc_id. Classes that can link share a routing
    key (see ``routing_keys``), so only groups of one key are searched: each part of a group becomes a signature tree, a
    tree of nodes that hold the OR of token bitmaps and a size range, and two trees are traversed together, passing over
    node pairs whose largest possible overlap is too small. Surviving pairs are compared exactly. Before whole sets are
    gathered, byte sketches of them take out what has no possible partner. First every group is
    searched against its smallest member; groups whose members are then one component are done. In the others what is
    still apart meets: possible links by sketch hold clusters together, and each cluster is searched once. Tasks are bounded, whatever the size of a group, and nothing depends on luck: the result
    is that of comparing all pairs.

    A text that is null or without words has an empty set and links with nothing. Rows that share a
    doc_id are placed by their own texts. A null doc_id links nothing and has no component. Repeated rows each get their row. No rows give no rows; further
    columns are ignored. Output: doc_id, n_shingles, component_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = written(described(docs, size))
    named = narrow.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "one", "two").agg(
        F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch"))
    members = written(shared_keys(docs, narrow, named, size, percent))
    sketches = written(named.select("cid", F.col("n_shingles").alias("n"), "sketch").join(members.select("cid").distinct(), "cid", "left_semi"))
    with_sketch = lambda tasks: tasks.join(sketches, "cid").select(*TASK, "side", "cid", "label", "n", "sketch")
    stars = written(possible(with_sketch(star_tasks(members)), percent))
    found = with_sets(star_tasks(stars.select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("cid"))), docs, size, percent)
    labels = components(found)
    edges = possible(with_sketch(pair_tasks(open_groups(members, labels))), percent)
    more = with_sets(pair_tasks(clusters(edges, labels)), docs, size, percent)
    if not more.isEmpty():
        labels = components(found.unionByName(more))
    rooted = named.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        F.col("one").alias("of_one"), F.col("two").alias("of_two"), F.col("n_shingles").alias("of_n"), F.coalesce("label", "cid").alias("root"))
    return narrow.join(rooted, (F.col("one") == F.col("of_one")) & (F.col("two") == F.col("of_two")) & (
        F.col("n_shingles") == F.col("of_n")) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, columns unchanged.

    Of rows that share this doc_id the one with the smallest text hash stays. Documents without words or without a
    doc_id all stay.
    """
    found = classes(docs, size, percent).where("n_shingles > 0 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("__id"), "component_id").groupBy("__id").agg(F.max("component_id").alias("__component"))
    tagged = docs.withColumn("__key", F.col("doc_id").cast("long")).join(found, F.col("__key") == F.col("__id"), "left")
    kept = tagged.where("__component IS NULL OR __component = __key").withColumn("__text", text_hash(F.col("text")))
    alone = kept.where("__component IS NULL")
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("__text"))
    first = kept.where("__component IS NOT NULL").withColumn("__rank", rank).where("__rank = 1")
    return alone.select(*docs.columns).unionByName(first.select(*docs.columns))


def sql(size: int = SIZE, percent: int = PERCENT) -> str:
    """The same in DuckDB for ids that are not null and unique: pairs by their common shingles, then reachability."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
                                                       '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d WHERE len(w) >= {size})
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {size - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS at FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.at)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.at) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
