"""Lines of documents as hashes, for the operators that count lines across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions.text import bind
from credtrace.llm.common import WS, WS_RUN, text_hash


def normalised(line: Column) -> Column:
    """Lower case, white space at the ends dropped and one space elsewhere."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(WS)), WS_RUN, " "))


def line_structs(text: Column) -> Column:
    """Per line (hash of the normalised line, its words, its index); null and wordless lines have 0 words."""
    def of(line: Column, index: Column) -> Column:
        return bind(normalised(line), lambda v: F.struct(
            F.xxhash64(v).alias("hash"), F.when(v == "", 0).otherwise(
                F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))) + 1).alias("n"), index.alias("index")))

    return F.transform(F.split(text, "\n"), of)


def line_rows(docs: DataFrame, host: str, min_words: int = 1) -> DataFrame:
    """A row for each line of at least ``min_words`` words: (doc_id, text_hash, host, hash, n, index, first).

    ``first`` marks the first of equal lines within one document, so that sums of it count documents. Lines are marked by
    sorting inside the row: no shuffle, and no search that grows with the square of the lines.
    """
    lines = F.sort_array(F.filter(line_structs(F.col("text")), lambda x: x["n"] >= min_words))
    marked = bind(lines, lambda a: F.transform(a, lambda x, k: F.struct(
        x["hash"].alias("hash"), x["n"].alias("n"), x["index"].alias("index"),
        F.coalesce(F.get(a, k - 1)["hash"] != x["hash"], F.lit(True)).cast("int").alias("first"))))
    return (docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.col(host).alias("host"),
                        F.explode(marked).alias("line")).select("doc_id", "text_hash", "host", "line.*"))
