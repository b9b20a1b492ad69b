"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions.text import bind
from credtrace.llm.common import text_hash

WINDOW = 10
_GAP = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def item_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; an empty array for null or none."""
    lower = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))
    return bind(F.coalesce(F.btrim(lower, F.lit(_GAP)), F.lit("")), lambda t: F.when(
        t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))


def winnowed(w: Column, span: int) -> Column:
    """Fingerprints (first, last, hash): runs of ``span``-word windows that share their minimum k-gram hash.

    With k words to a k-gram and span - k + 1 k-grams to a window, two texts that share ``span`` words in a row share the
    minimum hash of that window, so a join on fingerprints finds every shared span.
    """
    k = (span + 1) // 2
    grams = span - k + 1

    def runs(minima: Column) -> Column:
        starts = F.filter(F.transform(minima, lambda v, i: F.when(
            (i == 0) | (v != F.get(minima, i - 1)), F.struct(i.alias("first"), v.alias("hash")))), lambda x: x.isNotNull())
        return bind(starts, lambda s: F.transform(s, lambda x, j: F.struct(
            x["first"].alias("first"), (F.coalesce(F.get(s, j + 1)["first"], F.size(minima)) - 1).alias("last"),
            x["hash"].alias("hash"))))

    def hashes(v: Column) -> Column:
        return F.slice(F.transform(v, lambda x, i: F.xxhash64(x, *[F.get(v, i + j) for j in range(1, k)])), F.lit(1),
                       F.greatest(F.size(v) - k + 1, F.lit(0)))

    def minima(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.least(x, *[F.get(h, i + j) for j in range(1, grams)]) if grams > 1 else x),
                       F.lit(1), F.greatest(F.size(h) - grams + 1, F.lit(0)))

    return bind(bind(bind(w, hashes), minima), runs)


def windows_of(w: Column, starts, span: int) -> Column:
    """(start, window) for the starts that ``starts`` gives for the words."""
    return bind(w, lambda v: F.transform(starts(v), lambda i: F.struct(
        i.alias("start"), F.array_join(F.slice(v, i + 1, F.lit(span)), " ").alias("window"))))


def hits_of_span(docs: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(of_doc, of_text, start, span, item_id): every place where a ``span``-word window of an item stands in a document.

    Fingerprints of both sides are joined first; Spark broadcasts the items' ones only while they are small. Documents
    with a common fingerprint are met again by their key, and the windows of the matched runs are compared as text.
    """
    item_windows = items.select("item_id", F.explode(windows_of(
        F.col("w"), lambda v: F.sequence(F.lit(0), F.size(v) - span), span)).alias("x")).select(
        F.col("item_id"), F.col("x.window").alias("window")).distinct()
    prints = items.select(F.explode(F.transform(winnowed(F.col("w"), span), lambda x: x["hash"])).alias("hash")).distinct()
    found = (docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.explode(
        winnowed(item_words(F.col("text")), span)).alias("f")).select("doc_id", "text_hash", "f.*").join(prints, "hash", "left_semi")
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).agg(
            F.collect_set(F.struct("first", "last")).alias("runs")))
    met = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (text_hash(F.col("text")) == F.col("of_text")))
    starts = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    rows = met.select("of_doc", "of_text", F.explode(windows_of(item_words(F.col("text")), lambda v: starts, span)).alias("x"))
    return rows.select("of_doc", "of_text", "x.*").join(item_windows, "window").select(
        "of_doc", "of_text", "start", F.lit(span).alias("span"), "item_id")


def covered(intervals: Column) -> Column:
    """Words inside the union of (start, span) intervals."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(intervals), zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["span"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["span"] - F.greatest(a["end"], x["start"]))).alias("n")))["n"]


def hits_of(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(of_doc, of_text, places, item_ids) of the documents that hold a window; rows with equal id and text are one."""
    short = [r[0] for r in items.where(F.size("w") < window).select(F.size("w")).distinct().collect()]
    spans = [hits_of_span(docs, items.where(F.size("w") >= window), window)]
    spans += [hits_of_span(docs, items.where(F.size("w") == n), n) for n in sorted(short)]
    return reduce(DataFrame.unionByName, spans).groupBy("of_doc", "of_text").agg(
        F.collect_set(F.struct("start", "span")).alias("places"), F.collect_set("item_id").alias("item_ids"))


def items_of(bench: DataFrame) -> DataFrame:
    return bench.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A word is hit inside any occurrence of a window: ``window`` consecutive words of an item, or a whole shorter item.
    Shorter items are joined by fingerprints of their own length; which lengths there are is read first (at most
    ``window`` - 1 numbers).

    Null or empty texts have no words; empty items match nothing; an item_id that is null hits words but is not counted
    as an item; repeated items count once and repeated documents each get their row; no rows on either side give no
    hits; further columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    hits = hits_of(docs, items_of(bench), window)
    base = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.size(item_words(F.col("text"))).alias("n_words"))
    ids = F.sort_array(F.transform(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    return base.join(hits, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(covered(F.col("places")), F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("places").isNotNull().alias("contaminated"), ids.alias("item_ids"))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, columns unchanged. Rows with equal id and text go together."""
    found = hits_of(docs.select("doc_id", "text"), items_of(bench), window).select("of_doc", "of_text")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (text_hash(F.col("text")) == F.col("of_text")), "left_anti")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
             translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
        SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM i),
g AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l WHERE len(w) >= n)),
h AS (SELECT r, s, g.n, item_id FROM g JOIN i ON g.g = i.g AND g.n = i.n),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (
        SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""
