"""Alignment of the tokens of two tokenizers by pointer jumping over their overlaps."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrace.llm.common import written

#: Folder of the tokenizer files; it has to be on every executor.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text and links that are held at once; a longer text is taken alone, a larger group by its distinct ids.
BATCH_BYTES, BATCH_LINKS = 1 << 20, 1 << 20
#: Id pairs whose counts are broadcast, the most frequent ones: 13 bytes each at any size of the corpus.
HEAD = 1 << 18


def byte_symbols() -> dict[str, int]:
    """Bytes by the characters that a byte-level vocabulary writes for them: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Fixed value: how byte-level tokenizers split a text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class may differ between Unicode versions.
BEYOND = re.compile(r"[^\x00-\u024f]")


def unusual(text: str) -> bool:
    """Whether the slower library is to take care of a text: characters ``BEYOND``, and what may be a very long run."""
    words = text.split()
    spare = len(text) - sum(map(len, words)) - len(words)
    return spare >= 1000 or max(map(len, words), default=0) >= 1000 or (not text.isascii() and BEYOND.search(text) is not None)


class Pair:
    """Both tokenizers, the bytes of each of their ids and the lengths of these.

    Where the ids of A are the ranks of its merges, the faster of two libraries encodes with these; it gives the same ids for
    texts that are not ``unusual``.
    """

    def __init__(self, folder: str, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(f"{folder}/{file_a}")
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=f"{folder}/{file_b}")
        symbols = byte_symbols()
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(map(symbols.get, t)) if all(c in symbols for c in t) else t.encode() for t in names]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(k) else t.replace("▁", " ").encode()
                        for k, t in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.ranked = self.by_ranks(json.loads(self.a.to_str()))

    def by_ranks(self, settings: dict):
        """The encoder by ranks, None where the ids are not the order of the merges."""
        split, model = settings.get("pre_tokenizer") or {}, settings["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if (split.get("type"), split.get("use_regex"), split.get("add_prefix_space"), settings.get("normalizer")) != ("ByteLevel", True, False, None):
            return None
        if [model["vocab"].get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken
        ranks = {self.bytes_a[k]: k for k in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text in both; none where the tokens do not spell the text behind a space."""
        spaced, out = [" " + t for t in texts], []
        slow = [not self.ranked or unusual(t) for t in spaced]
        others = iter(self.a.encode_batch_fast([t for t, x in zip(spaced, slow) if x], add_special_tokens=False))
        for text, by_library, two in zip(spaced, slow, self.b.encode(texts, num_threads=1)):
            one = next(others).ids if by_library else self.ranked.encode_ordinary(text)
            raw = text.encode()
            whole = b"".join(map(self.bytes_a.__getitem__, one)) == raw == b"".join(map(self.bytes_b.__getitem__, two))
            out.append((np.array(one if whole else [], np.int64), np.array(two if whole else [], np.int64)))
        return out


@lru_cache(2)
def pair(folder: str, file_a: str, file_b: str) -> Pair:
    return Pair(folder, file_a, file_b)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token of each token, B's tokens numbered after A's; both sides cover the same bytes.

    Every token points to the farthest-right token of the other side that overlaps it, one that nothing reaches beyond to
    itself. Doubling the successors leaves each token at the last token of its component.
    """
    n = len(ends_a)
    starts_a, starts_b = ends_a - np.diff(ends_a, prepend=0), ends_b - np.diff(ends_b, prepend=0)
    from_a = n + np.searchsorted(starts_b, ends_a, side="left") - 1
    over_b = np.searchsorted(starts_a, ends_b, side="left") - 1
    itself = n + np.arange(len(ends_b))
    successor = np.concatenate([from_a, np.where(ends_a[over_b] > ends_b, over_b, itself)])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor
        successor = farther


def group_numbers(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of A and of B, counted from 0 in the order of the text."""
    last = terminals(ends_a, ends_b)
    ranks = np.cumsum(np.diff(last[len(ends_a):], prepend=-1) != 0) - 1
    return ranks[last[: len(ends_a)] - len(ends_a)], ranks


@lru_cache(2)
def digits(largest: int) -> np.ndarray:
    """Decimal digits of the numbers up to the largest, padded with zero bytes, and a place for what follows them."""
    width = len(str(largest))
    return np.array([str(k).encode() for k in range(largest + 1)], dtype=f"S{width + 1}").view(np.uint8).reshape(largest + 1, width + 1)


def spelled(ids_a, ids_b, group_a, group_b, counts_a, counts_b, cuts: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of runs of groups that end before the groups ``cuts``; ``numbers`` are digits."""
    n = len(ids_a) + len(ids_b)
    before_a, before_b = np.cumsum(counts_a), np.cumsum(counts_b)
    ids, follow = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + (before_b - counts_b)[group_a]] = ids_a
    ids[np.arange(len(ids_b)) + before_a[group_b]] = ids_b
    follow[before_a + before_b - counts_b - 1] = ord("|")
    follow[before_a + before_b - 1] = ord(";")
    rows = numbers[ids]
    rows[:, -1] = follow
    ends = np.concatenate([[0], np.cumsum((rows != 0).sum(axis=1))])
    flat = rows.ravel()
    flat = flat[flat != 0].tobytes()
    tokens = np.concatenate([[0], before_a + before_b])
    return [flat[ends[tokens[x]]: ends[tokens[y]] - 1] for x, y in zip(np.concatenate([[0], cuts[:-1]]), cuts)]


def linked_pairs(ids_a, ids_b, counts_a, counts_b, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, how often) of the linked id pairs, distinct by owner; a pair's code is a * width + b.

    ``owner`` tells whose each group is. Small groups are written out together, a large one by its distinct ids.
    """
    start_a, start_b, links = np.cumsum(counts_a) - counts_a, np.cumsum(counts_b) - counts_b, counts_a * counts_b
    keys, times = [], []
    small = np.flatnonzero(links <= BATCH_LINKS)
    cut = np.searchsorted(np.cumsum(links[small]), np.arange(1, links[small].sum() // BATCH_LINKS + 2) * BATCH_LINKS, side="right")
    for g in np.split(small, cut):
        if not len(g):
            continue
        n = links[g]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        each = np.repeat(counts_b[g], n)
        a, b = ids_a[np.repeat(start_a[g], n) + place // each], ids_b[np.repeat(start_b[g], n) + place % each]
        found, often = np.unique((np.repeat(owner[g], n).astype(np.uint64) << np.uint64(40)) + (a * width + b).astype(np.uint64), return_counts=True)
        keys.append(found)
        times.append(often)
    for g in np.flatnonzero(links > BATCH_LINKS):
        a, n_a = np.unique(ids_a[start_a[g]: start_a[g] + counts_a[g]], return_counts=True)
        b, n_b = np.unique(ids_b[start_b[g]: start_b[g] + counts_b[g]], return_counts=True)
        keys.append((np.uint64(int(owner[g]) << 40) + (a[:, None] * width + b).astype(np.uint64)).ravel())
        times.append((n_a[:, None] * n_b).ravel())
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    often = np.zeros(len(found), np.int64)
    np.add.at(often, inverse, np.concatenate(times))
    return (found >> np.uint64(40)).astype(np.int64), (found & np.uint64((1 << 40) - 1)).astype(np.int64), often


def listed(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values as one list for each of the n owners; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def aligned(texts: list[str], tools: Pair) -> dict[str, pa.Array]:
    """The columns of a batch of texts."""
    n, width = len(texts), len(tools.bytes_b)
    encoded = tools.encode(texts)
    n_a, n_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in encoded)]) for k in (0, 1))
    none = np.empty(0, np.int64)
    if len(ids_a):
        group_a, group_b = group_numbers(np.cumsum(tools.lengths_a[ids_a]), np.cumsum(tools.lengths_b[ids_b]))
        counts_a, counts_b = np.bincount(group_a), np.bincount(group_b)
        texts_of = np.repeat(np.arange(n), n_a)[np.cumsum(counts_a) - 1]  # all texts end in a cut: no group has two
        groups, links = np.bincount(texts_of, minlength=n), np.zeros(n, np.int64)
        np.add.at(links, texts_of, counts_a * counts_b)
        owner, codes, often = linked_pairs(ids_a, ids_b, counts_a, counts_b, texts_of, width)
        held = np.flatnonzero(groups)
        hashes = dict(zip(held.tolist(), (hashlib.sha256(s).hexdigest() for s in spelled(
            ids_a, ids_b, group_a, group_b, counts_a, counts_b, np.cumsum(groups)[held], digits(max(len(tools.bytes_a), width) - 1)))))
    else:
        groups = links = np.zeros(n, np.int64)
        owner, codes, often, hashes = none, none, none, {}
    return {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(groups.astype(np.int64)), "n_links": pa.array(links),
            "groups_sha256": pa.array([hashes.get(k, "") for k in range(n)]),
            "codes": listed(owner, codes, n, pa.int64()), "often": listed(owner, often, n, pa.int64())}


def by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of texts of up to so many characters together, one at least."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def tokenised(docs: DataFrame, folder: str, file_a: str, file_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, often) of every row of docs."""
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = pair(folder, file_a, file_b)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for run in by_bytes(texts):
                columns = aligned(texts[run], tools)
                rows = b.slice(run.start, run.stop - run.start)
                yield pa.RecordBatch.from_pydict({"row": rows.column("row"), "doc_id": rows.column("doc_id")} | columns)

    kind = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, often array<long>"
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batch, kind)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(code, n, best): documents that hold each linked id pair, and whether no pair of its A id is in more."""
    counts = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(F.expr(f"code div {width}").alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.expr(f"code div {width}")).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(rows: DataFrame, counts: DataFrame, head: int) -> DataFrame:
    """(row, n_best, count_sum): counts over the links of each row.

    The ``head`` most frequent pairs are looked up in a broadcast table, pairs beyond them are joined with their counts.
    """
    frequent = counts.orderBy(F.desc("n"), "code").limit(head).toArrow().sort_by("code")
    shared = rows.sparkSession.sparkContext.broadcast(tuple(frequent.column(c).to_numpy().copy() for c in ("code", "n", "best")))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for b in batches:
            codes, often = (b.column(c).flatten().to_numpy() for c in ("codes", "often"))
            sizes = b.column("codes").value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            there = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, owner[there], often[there] * n[at[there]])
            np.add.at(bests, owner[there], often[there] * best[at[there]])
            rest = ~there
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "n_best": pa.array(bests), "count_sum": pa.array(sums),
                                              "codes": listed(owner[rest], codes[rest], len(sizes), pa.int64()),
                                              "often": listed(owner[rest], often[rest], len(sizes), pa.int64())})

    known = written(rows.select("row", "codes", "often").mapInArrow(batch, "row long, n_best long, count_sum long, codes array<long>, often array<long>"))
    rare = known.where(F.size("codes") > 0).select("row", F.explode(F.arrays_zip("codes", "often")).alias("x")).select("row", "x.codes", "x.often")
    rare = rare.join(counts, F.col("codes") == F.col("code")).select(
        "row", (F.col("often") * F.col("best").cast("long")).alias("n_best"), (F.col("often") * F.col("n")).alias("count_sum"))
    return known.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, head: int = HEAD) -> DataFrame:
    """How the tokens of two tokenizers align in every text, and how usual each text's links are in the corpus.

    A encodes a space and the text, B the text (it adds the space); special tokens are neither added nor read from a text.
    Tokens that overlap in bytes, directly or through others, are a group: groups are cut where both tokenizers end a token.
    All A-B token pairs of a group are links. The count of an id pair is the number of documents that hold it linked;
    ``n_best`` counts the links whose pair has the highest count of its A id, ties included, ``count_sum`` adds the
    counts of all links. Texts are encoded once, whole; their distinct pairs are written to the shared folder and counted
    by aggregation.

    Null and empty texts, and texts that a tokenizer does not give back, have no tokens: zeros and an empty hash. Every row
    is a document of its own, also where ids are null or repeat. No rows give no rows; further columns are ignored. Output:
    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).
    """
    rows = written(tokenised(docs, folder, file_a, file_b))
    counts = written(pair_counts(rows, len(pair(folder, file_a, file_b).bytes_b)))
    return rows.drop("codes", "often").join(summed(rows, counts, head), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
