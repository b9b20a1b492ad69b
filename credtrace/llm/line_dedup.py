"""Line dedup by distinct-site spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions.text import bind
from credtrace.llm.common import text_hash, written
from credtrace.llm.lines import line_rows

#: Sites that make a line boilerplate: above the 2 to 3 of plain copies, so that a hot source, whose copies are one site, hides none.
MIN_SITES, MIN_WORDS, LG_K = 4, 3, 11


def spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(hash, first_doc) of the lines that at least ``min_sites`` distinct sites have.

    A HyperLogLog sketch per line hash is merged by the aggregation, map side first, so its size does not depend on how
    common a line is. The standard error of a sketch is below 1.04 / sqrt(2^lg_k); lines whose estimate lies within five
    of them (and two sites) of the threshold are counted exactly, the others are settled by their sketch.
    """
    margin = math.ceil(5 * 1.04 / math.sqrt(1 << lg_k) * min_sites) + 2
    sketched = lines.groupBy("hash").agg(F.hll_sketch_agg(F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("")), lg_k).alias("sites"),
                                         F.min("doc_id").alias("first_doc")).select(
        "hash", "first_doc", F.hll_sketch_estimate("sites").alias("estimate"))
    sketched = sketched.where(F.col("estimate") >= min_sites - margin)
    near = sketched.where(F.col("estimate") < min_sites + margin)
    exact = (lines.join(near.select("hash"), "hash", "left_semi").groupBy("hash", "host").agg(F.lit(1).alias("one"))
             .groupBy("hash").agg(F.count(F.lit(1)).alias("n_sites")).where(F.col("n_sites") >= min_sites))
    return sketched.where(F.col("estimate") >= min_sites + margin).select("hash", "first_doc").unionByName(
        near.join(exact, "hash", "left_semi").select("hash", "first_doc"))


def gone_mask(indices: Column) -> Column:
    """Bytes with a 1 at each of the line indices, so that a line is looked up in constant time."""
    return bind(F.sort_array(indices), lambda g: F.array_join(F.transform(g, lambda x, k: F.concat(
        F.repeat(F.lit("0"), x - F.coalesce(F.get(g, k - 1), F.lit(-1)) - 1), F.lit("1"))), "").cast("binary"))


def dedupe(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
           lg_k: int = LG_K, count: str | None = "n_removed") -> DataFrame:
    """The documents without their cross-site boilerplate.

    Lines are compared in lower case with white space collapsed. A line of at least ``min_words`` words that at least
    ``min_sites`` sites hold is removed everywhere but in the document with the smallest doc_id, so no content is lost
    altogether. Every document keeps its row and columns; ``text`` (and ``n_chars``, where it is a column) change, and
    the column ``count`` has the number of removed lines, in place of a column of that name; with None there is no count.

    Null text stays null; a null site is a site of its own; null doc_ids never hold a line's kept copy unless all do (and
    then all lose it); repeated rows are treated alike; a document all of whose lines go keeps an empty text; no rows
    give no rows; other columns are passed through.
    """
    lines = written(line_rows(docs, site, min_words))
    common = spread(lines, min_sites, lg_k)
    hits = lines.join(common, "hash").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")) | F.col("doc_id").isNull())
    gone = hits.groupBy(F.col("doc_id").alias("__of_doc"), F.col("text_hash").alias("__of_text")).agg(
        F.collect_set("index").alias("__gone"))
    tagged = docs.withColumn("__text_hash", text_hash(F.col("text")))
    joined = tagged.join(gone, F.col("doc_id").eqNullSafe(F.col("__of_doc")) & (F.col("__text_hash") == F.col("__of_text")), "left")
    kept = bind(gone_mask(F.col("__gone")), lambda mask: F.array_join(F.filter(
        F.split("text", "\n"), lambda x, i: F.substring(mask, i + 1, F.lit(1)) != F.lit(b"1")), "\n"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    joined = joined.withColumn("__text", text)
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(
            F.length("__text").cast(docs.schema["n_chars"].dataType))
    if count is not None:
        columns[count] = F.coalesce(F.size("__gone"), F.lit(0))
    return joined.select(*[v.alias(c) for c, v in columns.items()])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
n AS (SELECT *, lower(array_to_string(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+'), ' ')) AS line,
             len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS k FROM l),
c AS (SELECT line, min(doc_id) AS first_doc FROM n WHERE k >= {MIN_WORDS} GROUP BY line
      HAVING count(DISTINCT coalesce('=' || source, '')) >= {MIN_SITES}),
g AS (SELECT n.r, n.raw, n.i, c.line IS NOT NULL AND (n.doc_id IS NULL OR n.doc_id IS DISTINCT FROM c.first_doc) AS gone
      FROM n LEFT JOIN c ON n.line = c.line AND n.k >= {MIN_WORDS}),
t AS (SELECT r, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS n FROM g GROUP BY r)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL WHEN n > 0 THEN coalesce(kept, '') ELSE text END AS text,
       CASE WHEN n > 0 THEN length(coalesce(kept, '')) ELSE n_chars END AS n_chars, CAST(coalesce(n, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN t USING (r)"""
