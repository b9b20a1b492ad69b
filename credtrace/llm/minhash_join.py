"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrace.llm.common import written
from credtrace.llm.components import components
from credtrace.llm.ngram_join import TASK, clusters, open_groups, pair_tasks, star_tasks
from credtrace.llm.shingles import mixed, shingle_sets
from credtrace.llm.signature_tree import overlaps

SIZE, PERCENT = 4, 80
#: A signature has CHUNKS * WIDTH symbols of 16 bits. In each chunk ERRORS symbols may differ; signatures that differ in up to
#: DISTANCE symbols have a chunk with no more than these (pigeonhole), so they share one of its keys.
CHUNKS, WIDTH, ERRORS = 20, 5, 1
SYMBOLS = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Bits of the bitmap that tells keys of one class from shared ones; 2 MB at any size of the corpus.
MAP_BITS = 24
#: Signatures of one side of a task, 200 bytes each. Fewer, larger tasks name a possible link less often.
TASK_SIGNATURES = 2048
_MULTIPLIERS = (mixed(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def missed(percent: int = PERCENT) -> float:
    """The chance that the signatures of two sets of just this similarity differ in more than DISTANCE symbols."""
    q = 1 - percent / 100
    return sum(math.comb(SYMBOLS, k) * q ** k * (1 - q) ** (SYMBOLS - k) for k in range(DISTANCE + 1, SYMBOLS + 1))


def signature(members: np.ndarray) -> np.ndarray:
    """Sixteen bits of the smallest member under each of SYMBOLS hash functions."""
    low = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    a, b = _MULTIPLIERS[:SYMBOLS, None] | np.uint32(1), _MULTIPLIERS[SYMBOLS:, None]
    short = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, (short[at: at + 4096] * a + b).min(axis=1), out=low)
    return mixed(low.astype(np.uint64) + (np.arange(1, SYMBOLS + 1, dtype=np.uint64) << np.uint64(32))).astype(np.uint16)


@lru_cache(1)
def kept_symbols() -> list[list[int]]:
    """Places of a chunk that a key keeps, for each choice of ERRORS places that may differ."""
    return [[p for p in range(WIDTH) if p not in wrong] for wrong in combinations(range(WIDTH), ERRORS)]


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of signatures by rows: a key for each chunk and each choice of the symbols that may differ."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    keys = []
    for number, kept in enumerate(kept_symbols()):
        key = np.full(parts.shape[:2], number + 1, np.uint64) + (np.arange(CHUNKS, dtype=np.uint64) << np.uint64(16))
        for p in kept:
            key = mixed(key ^ mixed(parts[:, :, p] + np.uint64(p + 1 << 20)))
        keys.append(key)
    return np.concatenate(keys, axis=1)


FINGERPRINT = "n_shingles long, one long, two long"


def fingerprint(s: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits of a set; equal sets have equal ones."""
    sums = np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64)
    return len(s), int(sums[0]), int(sums[1])


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, one, two, signature) of every row of docs."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, signatures = [], []
            for s in shingle_sets(b.column("text"), size):
                prints.append(fingerprint(s))
                signatures.append(signature(s).tobytes() if len(s) else b"")
            numbers = np.array(prints, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(numbers[:, k]) for k in range(3)), pa.array(signatures, pa.binary())],
                                             ["doc_id", "n_shingles", "one", "two", "signature"])

    return docs.select("doc_id", "text").mapInArrow(batch, f"doc_id long, {FINGERPRINT}, signature binary")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, hashes): the set of each wanted class (cid, first_doc, n_shingles, one, two), made again from its first document."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for doc_id, s in zip(ids, shingle_sets(b.column("text"), size)):
                row = [pa.array([x], pa.int64()) for x in (doc_id, *fingerprint(s))]
                yield pa.RecordBatch.from_arrays([*row, pa.array([s.tobytes()], pa.binary())], ["first_doc", "n_shingles", "one", "two", "hashes"])

    rows = docs.join(wanted.select(F.col("first_doc").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        batch, f"first_doc long, {FINGERPRINT}, hashes binary")
    # Rows that share an id are told apart by their sets; of repeated rows one is enough.
    return rows.join(wanted, ["first_doc", "n_shingles", "one", "two"]).groupBy("cid").agg(F.first("hashes").alias("hashes"))


class Forest:
    """Which members of a task are connected: by their labels at first, then by what is joined."""

    def __init__(self, labels: np.ndarray):
        _, self.above = np.unique(labels, return_inverse=True)
        self.labels = self.above.copy()
        self.above = list(range(int(self.above.max(initial=-1)) + 1))

    def root(self, label: int) -> int:
        while self.above[label] != label:
            self.above[label] = label = self.above[self.above[label]]
        return label

    def apart(self, one: int, others: np.ndarray) -> np.ndarray:
        mine = self.root(int(self.labels[one]))
        return np.array([self.root(x) != mine for x in self.labels[others].tolist()], bool)

    def join(self, one: int, other: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(int(self.labels[one])), self.root(int(self.labels[other]))
        self.above[y] = x
        return x != y


def near_pairs(table: pa.Table, percent: int, apart) -> Iterator[tuple[int, np.ndarray]]:
    """(k, others): by place, the members that are apart from k, of fitting size and within DISTANCE; side 0 meets side 1,
    side 2 itself."""
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(table), SYMBOLS)
    sides, sizes = table.column("side").to_numpy(), table.column("n").to_numpy()
    zero, one, two = (np.flatnonzero(sides == k) for k in range(3))
    for k, others in [(k, one) for k in zero.tolist()] + [(k, two[i + 1:]) for i, k in enumerate(two.tolist())]:
        if len(others):
            others = others[np.minimum(sizes[k], sizes[others]) * 100 >= percent * np.maximum(sizes[k], sizes[others])]
            others = others[(signatures[others] != signatures[k]).sum(axis=1) <= DISTANCE]
            yield k, others[apart(k, others)]


def linked(table: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
    ids = table.column("cid").to_numpy()
    places = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"a": ids[places[:, 0]], "b": ids[places[:, 1]]})


def possible(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each task a spanning forest of the pairs of different labels whose signatures are within DISTANCE.

    The forest is one of members, not of labels: every member that has such a pair is in it, as the pair may link where
    others of the same labels do not.
    """
    def task(table: pa.Table) -> pa.Table:
        labels, forest = table.column("label").to_numpy(), Forest(np.arange(len(table)))
        pairs = near_pairs(table, percent, lambda k, others: labels[others] != labels[k])
        return linked(table, [(k, x) for k, others in pairs for x in others.tolist() if forest.join(k, x)])

    return tasks.groupBy(*TASK).applyInArrow(task, "a long, b long")


def confirmed(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each task a spanning forest of the links; pairs within DISTANCE are compared by their full sets."""
    def task(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        forest, found = Forest(table.column("label").to_numpy()), []
        for k, others in near_pairs(table, percent, forest.apart):
            if len(others):
                for x, c in zip(others.tolist(), overlaps(sets[k], [sets[x] for x in others]).tolist()):
                    if 100 * c >= percent * (len(sets[k]) + len(sets[x]) - c) and forest.join(k, x):
                        found.append((k, x))
        return linked(table, found)

    return tasks.groupBy(*TASK).applyInArrow(task, "a long, b long")


def shared_keys(named: DataFrame) -> DataFrame:
    """(key, pivot, cid): the classes of each key that several have, and the smallest of them.

    Keys are told by their smallest and largest class, which combine before the shuffle, and the shared ones marked in a
    bitmap of fixed size; only rows whose bit is set are shuffled again.
    """
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = chunk_keys(np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint16).reshape(len(b), SYMBOLS))
            ends = np.arange(len(b) + 1) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))], ["cid", "keys"])

    rows = named.select("cid", "signature").mapInArrow(batch, "cid long, keys array<long>").select("cid", F.explode("keys").alias("key"))
    groups = written(rows.groupBy("key").agg(F.min("cid").alias("pivot"), F.max("cid").alias("top")).where("pivot < top").select("key", "pivot"))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << MAP_BITS)).cast("int")
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))
    marks = groups.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    candidates = rows.join(F.broadcast(marks), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("key", "cid")
    return candidates.join(groups, "key").select("key", "pivot", "cid")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Method. Documents with equal sets are one class. A class has a MinHash signature of 16-bit symbols, cut into chunks; a
    chunk gives a key for each choice of symbols that may differ. Signatures within DISTANCE share a key for certain, so
    classes that share a key are all that need to meet: first with the smallest class of the key, then, in keys whose
    classes are not yet one component, each with each, part by part in bounded tasks. Pairs within DISTANCE are compared
    by their full sets, read again for the classes that have such a pair. Two sets of similarity 0.8 exceed the DISTANCE
    with a chance of 4e-6 (``missed``), more similar ones with less; no other step loses a pair.

    A text that is null or without words has an empty set and links with nothing. Rows that share a doc_id are placed by
    their own texts. A null doc_id links nothing, has no component and is kept. Repeated rows each get their row. No rows
    give no rows; further columns are ignored. Output: doc_id, n_shingles, component_id, kept (doc_id = component_id).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = written(described(docs, size))
    named = written(narrow.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "one", "two").agg(
        F.min("doc_id").alias("first_doc"), F.first("signature").alias("signature")).withColumn("cid", F.monotonically_increasing_id()))
    members = written(shared_keys(named))
    signatures = named.select("cid", F.col("n_shingles").alias("n"), "signature")
    columns = [*TASK, "side", "cid", "label", "n", "signature"]

    def with_signatures(tasks: DataFrame) -> DataFrame:
        return tasks.join(signatures, "cid").select(*columns)

    def with_sets(tasks: DataFrame) -> DataFrame:
        tasks = written(with_signatures(tasks))
        wanted = named.join(tasks.select("cid").distinct(), "cid", "left_semi").select("cid", "first_doc", "n_shingles", "one", "two")
        return tasks.join(sets_of(docs, written(wanted), size), "cid").select(*columns, "hashes")

    stars = written(possible(with_signatures(star_tasks(members, TASK_SIGNATURES)), percent))
    found = written(confirmed(with_sets(star_tasks(stars.select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("cid")))), percent))
    labels = components(found)
    edges = possible(with_signatures(pair_tasks(open_groups(members, labels), TASK_SIGNATURES)), percent)
    more = written(confirmed(with_sets(pair_tasks(clusters(edges, labels))), percent))
    if not more.isEmpty():
        labels = components(found.unionByName(more))
    rooted = named.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("label", "cid"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component"))
    rooted = rooted.join(least, "root").select(F.col("n_shingles").alias("of_n"), F.col("one").alias("of_one"), F.col("two").alias("of_two"), "component")
    same = (F.col("n_shingles") == F.col("of_n")) & (F.col("one") == F.col("of_one")) & (F.col("two") == F.col("of_two")) & F.col("doc_id").isNotNull()
    component = F.coalesce("component", "doc_id")
    return narrow.join(rooted, same, "left").select("doc_id", "n_shingles", component.alias("component_id"),
                                                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


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
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.at) AS component_id, d.doc_id = min(r.at) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
