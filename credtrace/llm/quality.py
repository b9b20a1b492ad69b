"""Quality rules: measures of one document, then lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions.text import bind
from credtrace.llm.common import WS, text_hash, words, written
from credtrace.llm.lines import line_rows

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_REMOVED_PERCENT = 50, 50, 50
#: A line is boilerplate in a host when more documents than this have it, and more than this share of the host. The share is 0:
#: what is boilerplate does not depend on how large its host is.
MIN_DOCS, MAX_DOCS_PERCENT = 3, 0


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more, the first occurrence included.

    Equal windows meet by sorting (hash, position) in the row; texts without a repeat are told by a hash set before.
    """
    def covered(hashes: Column) -> Column:
        runs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(runs, lambda s: F.filter(F.transform(s, lambda x, k: F.when(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda x: x.isNotNull()))
        fresh = bind(F.sort_array(twice), lambda p: F.transform(
            p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), x - 3))))
        return F.aggregate(fresh, F.lit(0), lambda a, x: a + x)

    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1),
                      F.greatest(F.size(w) - 2, F.lit(0)))
    return bind(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(covered(t)))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; all 0 for null."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    return bind(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size(F.split(full, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words")))


def boilerplate(lines: DataFrame, docs: DataFrame, host: str, min_docs: int, max_docs_percent: int) -> DataFrame:
    """(host, hash) of the lines above the limits. Counts combine before the shuffle, however common a line or host is."""
    counts = lines.groupBy("host", "hash").agg(F.sum("first").alias("n_docs")).where(F.col("n_docs") > min_docs)
    if not max_docs_percent:
        return counts.select(F.col("host").alias("of_host"), F.col("hash").alias("of_hash"))
    sizes = docs.groupBy(F.col(host).alias("of_host")).agg(F.count(F.lit(1)).alias("host_docs"))
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("of_host"))).where(
        F.col("n_docs") * 100 > F.col("host_docs") * max_docs_percent).select(
        F.col("host").alias("of_host"), F.col("hash").alias("of_hash"))


def judge(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
          min_docs: int = MIN_DOCS, max_docs_percent: int = MAX_DOCS_PERCENT,
          max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """Measures and verdict for every document.

    A document fails the base rules with fewer than ``min_words`` words or with more than ``max_repeat_percent`` % of
    them in repeated windows. Lines that more than ``min_docs`` documents and ``max_docs_percent`` % of a host share are
    removed; a document that loses more than ``max_removed_percent`` % of its words so is rejected as depleted.

    Texts stay where they are scanned: only line hashes are shuffled, made once and written to the shared folder, and a very
    common line is split by the skew join.

    Null text counts as no words; a null host is a host of its own; repeated rows are documents of their own in counts
    and each gets its row; no rows give no rows; further columns are ignored. Output: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept.
    """
    lines = written(line_rows(docs, host))
    common = boilerplate(lines, docs, host, min_docs, max_docs_percent)
    hits = lines.join(common, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("hash") == F.col("of_hash")))
    removed = hits.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), F.col("host").alias("in_host")).agg(
        F.collect_set(F.struct("index", "n")).alias("gone"))
    removed = removed.withColumn("removed_words", F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"])).drop("gone")
    base = docs.select("doc_id", F.col(host).alias("host"), text_hash(F.col("text")).alias("text_hash"),
                       measures(F.col("text")).alias("m")).select("doc_id", "host", "text_hash", "m.*")
    joined = base.join(removed, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))
                       & F.col("host").eqNullSafe(F.col("in_host")), "left")
    gone = F.coalesce(F.col("removed_words"), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("removed_words"),
        failed.alias("base_failed"), (~failed & (100 * gone <= max_removed_percent * F.col("n_words"))).alias("kept"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS raw FROM d),
n AS (SELECT r, source, raw, lower(array_to_string(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+'), ' ')) AS line,
             len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS k FROM l),
c AS (SELECT source, line, count(DISTINCT r) AS docs FROM n WHERE k > 0 GROUP BY ALL),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
g AS (SELECT n.r, sum(k) AS gone FROM n JOIN c ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source
      JOIN h ON h.source IS NOT DISTINCT FROM c.source
      WHERE k > 0 AND c.docs > {MIN_DOCS} AND c.docs * 100 > h.docs * {MAX_DOCS_PERCENT} GROUP BY n.r),
u AS (SELECT r, count(*) - count(DISTINCT raw) AS dups FROM n WHERE k > 0 GROUP BY r),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
e AS (SELECT r, i FROM t QUALIFY count(*) OVER (PARTITION BY r, tri) > 1),
v AS (SELECT r, count(DISTINCT p) AS rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM e) GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone, 0) AS BIGINT) AS removed_words
      FROM d LEFT JOIN u USING (r) LEFT JOIN v USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, b AS base_failed,
       NOT b AND 100 * removed_words <= {MAX_REMOVED_PERCENT} * n_words AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS b FROM m)"""
