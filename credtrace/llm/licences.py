"""Licence scan: TF-IDF cosine of statements and files to templates, then inheritance from directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credtrace.functions.text import bind
from credtrace.llm.common import text_hash, written

# Notices as their licences ask for them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: Licence texts, and notices that are usually wrapped (``_notice``), for whole files and blocks of lines.
TEXTS = tuple((p.stem.split("_")[0], p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
#: Words that a text is not searched for unless a template cannot do without.
COMMON = frozenset("a all and are as at be by for from in is it not of on or that the this to with you 0 1 2 3 4".split())
THRESHOLD, FILE_PERCENT = 0.7, 10
_WORD = "[a-z0-9]+"
_COMMENT = r"^\s*(//|#|/?\*|--|;|%|<!--|(?i:rem|dnl)\s)"


def template_vectors(templates=TEMPLATES, threshold=THRESHOLD):
    """Rows (number, licence, token, weight) of unit vectors, idf by token, idf of unknown tokens, tokens to look for.

    Of each template so many tokens are looked for that the others alone stay below the threshold: a text without any of
    them cannot match.
    """
    bags = [Counter(re.findall(_WORD, text.lower())) for _, text in templates]
    seen = Counter(t for bag in bags for t in bag)
    unknown = math.log(1 + len(bags)) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows, wanted = [], set()
    for number, ((licence, _), bag) in enumerate(zip(templates, bags)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(number, licence, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
        for t in sorted(bag, key=lambda t: (t not in wanted, t in COMMON, -bag[t] * idf[t], t)):
            if math.sqrt(sum((n * idf[x] / norm) ** 2 for x, n in bag.items() if x not in wanted)) < threshold * 0.999:
                break
            wanted.add(t)
    return rows, idf, unknown, sorted(wanted)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def text_vectors(texts=TEXTS, threshold=THRESHOLD):
    """As ``template_vectors`` for long texts, counts damped by 1 + ln n; last a bound for each text.

    A bound has the squared weight of the common words, how many other words it takes at least to reach the threshold with
    these, and the other words with their squared weights.
    """
    bags = [Counter(re.findall(_WORD, text.lower())) for _, text in texts]
    seen = Counter(t for bag in bags for t in bag)
    unknown = math.log(1 + len(bags)) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows, bounds = [], []
    for number, ((licence, _), bag) in enumerate(zip(texts, bags)):
        value = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        rows += [(number, licence, t, v / norm) for t, v in sorted(value.items())]
        others = sorted(((v / norm) ** 2, t) for t, v in value.items() if t not in COMMON)[::-1]
        common = held = sum((v / norm) ** 2 for t, v in value.items() if t in COMMON)
        least = 0
        while held < threshold ** 2 * 0.999:
            held, least = held + others[least][0], least + 1
        bounds.append((common, least, others))
    return rows, idf, unknown, bounds


def blocks(lines: Column) -> Column:
    """(first, end) of the runs of two or more lines that are comments, that have words, or that are comments or have no words."""
    def runs(kinds: Column, of) -> Column:
        flags = F.transform(kinds, of)
        changes = bind(flags, lambda f: F.filter(F.transform(f, lambda v, i: F.when(
            (i == 0) | (v != F.get(f, i - 1)), F.struct(i.alias("first"), v.alias("inside")))), lambda x: x.isNotNull()))
        spans = bind(changes, lambda c: F.transform(c, lambda x, j: F.struct(
            x["first"].alias("first"), F.coalesce(F.get(c, j + 1)["first"], F.size(kinds)).alias("end"), x["inside"].alias("inside"))))
        return F.transform(F.filter(spans, lambda x: x["inside"] & (x["end"] - x["first"] >= 2)), lambda x: F.struct(x["first"], x["end"]))

    kinds = F.transform(lines, lambda x: F.when(~x.rlike("[A-Za-z0-9]"), 0).when(x.rlike(_COMMENT), 1).otherwise(2))
    return bind(kinds, lambda k: F.array_distinct(F.concat(
        runs(k, lambda x: x == 1), runs(k, lambda x: x != 0), runs(k, lambda x: x != 2))))


def counted(words: Column) -> Column:
    """(token, n) of the distinct tokens: equal ones meet by sorting within the row, so that no shuffle is needed to count them."""
    def runs(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda t, i: F.when((i == 0) | (t != F.get(a, i - 1)), i)), lambda i: i.isNotNull())
        return bind(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(a, i).alias("token"), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).cast("long").alias("n"))))

    return bind(F.sort_array(words), runs)


def scored(found: DataFrame, vectors, idf, unknown: float, threshold: float, damped: bool) -> DataFrame:
    """The best template of each unit that reaches the threshold; dot products with unit vectors are summed by aggregation."""
    spark = found.sparkSession
    vectors = F.broadcast(spark.createDataFrame(vectors, "number int, licence string, token string, weight double"))
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "token string, idf double"))
    key = ["of_doc", "of_text", "doc_tokens", "unit", "first", "end"]
    counts = found.select(*key, F.explode(counted(F.col("tokens"))).alias("c")).select(*key, "c.token", "c.n")
    times = F.lit(1.0) + F.log("n") if damped else F.col("n")
    valued = counts.join(weights, "token", "left").withColumn("value", times * F.coalesce("idf", F.lit(unknown)))
    lengths = valued.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.sum("n").alias("n_tokens")).select(
        *[F.col(k).alias(f"in_{k}") for k in key], "norm", "n_tokens")
    dots = valued.join(vectors, "token").groupBy(*key, "number", "licence").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    same = F.col("of_doc").eqNullSafe(F.col("in_of_doc")) & (F.col("of_text") == F.col("in_of_text")) & (F.col("unit") == F.col("in_unit"))
    good = dots.join(lengths, same).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    return good.groupBy(*key, "n_tokens").agg(F.max(F.struct("score", "licence")).alias("best")).select(
        *key, "best.licence", "best.score", "n_tokens")


def statements(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, texts=TEXTS) -> DataFrame:
    """(of_doc, of_text, doc_tokens, unit, first, end, licence, score, n_tokens, rank): what matches a notice or licence text.

    Units are lines, the whole text as unit -1, and blocks of lines [first, end) as units from -2 downwards. All are held to
    the notices (rank 0), blocks (rank 1) and whole texts (rank 2) to the licence texts as well.

    A text or unit that lacks too much of every template cannot reach the threshold and is passed over; the others become
    sparse token counts. The vectors are tables of fixed size.
    """
    rows, idf, unknown, wanted = template_vectors(templates, threshold)
    text_rows, text_idf, text_unknown, bounds = text_vectors(texts, threshold)
    look_for = F.array(*[F.lit(t) for t in wanted])
    vocabulary = F.array(*[F.lit(t) for t in sorted(idf)])
    squares = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w * w).alias("w")) for n, _, t, w in rows if n == k])
                        for k in range(len(templates))])
    text_vocabulary = F.split(F.lit(" ".join(sorted(set(text_idf) - COMMON))), " ")

    def may_match(words: Column) -> Column:
        """No cosine exceeds the root of the squared weights of the template's tokens that are present."""
        enough = bind(F.array_intersect(words, vocabulary), lambda held: F.exists(squares, lambda template: F.aggregate(
            template, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(held, x["t"]), x["w"]).otherwise(0.0)) >= threshold ** 2 * 0.999))
        return F.when(F.arrays_overlap(words, look_for), enough).otherwise(False)

    def may_be_text(words: Column) -> Column:
        """The same bound, the common words counted as present; of a long text only how many of the others it takes."""
        def reached(held: Column, common: float, least: int, others) -> Column:
            if least >= 40:  # so many are rare enough, and the plan stays small
                return F.size(held) >= least
            names = F.split(F.lit(" ".join(t for _, t in others)), " ")
            shares = F.split(F.lit(" ".join(repr(w) for w, _ in others)), " ").cast("array<double>")
            return (F.size(held) >= least) & (F.aggregate(held, F.lit(common), lambda a, x: a + F.coalesce(
                F.get(shares, F.array_position(names, x).cast("int") - 1), F.lit(0.0))) >= threshold ** 2 * 0.999)

        return bind(F.array_intersect(words, text_vocabulary), lambda held: reduce(
            Column.__or__, [reached(held, *bound) for bound in sorted(bounds, key=lambda b: b[1])]))

    def units(lines: Column) -> Column:
        def unit(number, first, end, body):
            return F.struct(number.cast("int").alias("unit"), first.cast("int").alias("first"), end.cast("int").alias("end"), body.alias("body"))

        return F.concat(F.transform(lines, lambda x, i: unit(i, i, i + 1, x)), F.array(unit(F.lit(-1), F.lit(0), F.size(lines), F.col("text"))),
                        F.transform(blocks(lines), lambda b, k: unit(-2 - k, b["first"], b["end"], F.array_join(
                            F.slice(lines, b["first"] + 1, b["end"] - b["first"]), " "))))

    # The texts are read once: what may match is written with what it may match, then scored against both vocabularies.
    units_of = docs.select("doc_id", "text", tokens(F.col("text")).alias("all")).where(may_match(F.col("all")) | may_be_text(F.col("all"))).select(
        F.col("doc_id").alias("of_doc"), text_hash(F.col("text")).alias("of_text"), F.size("all").alias("doc_tokens"),
        F.explode(bind(F.split("text", "\n"), units)).alias("u")).select(
        "of_doc", "of_text", "doc_tokens", "u.unit", "u.first", "u.end", tokens(F.col("u.body")).alias("tokens"))
    found = written(units_of.withColumns({"notice": may_match(F.col("tokens")), "full": (F.col("unit") < 0) & may_be_text(F.col("tokens"))}).where(
        "notice OR full").distinct())
    noticed = scored(found.where("notice"), rows, idf, unknown, threshold, False)
    full = scored(found.where("full"), text_rows, text_idf, text_unknown, threshold, True)
    return noticed.withColumn("rank", F.lit(0)).unionByName(full.withColumn("rank", F.when(F.col("unit") == -1, 2).otherwise(1)))


def innermost(places: Column) -> Column:
    """Struct (n, stated): how many of the places (first, end, n_tokens) hold no other one, and their tokens."""
    ordered = F.sort_array(F.transform(places, lambda p: F.struct((-p["first"]).alias("back"), p["end"].alias("end"), p["n_tokens"].alias("n_tokens"))))
    zero = F.struct(F.lit(2 ** 31 - 1).alias("end"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stated"))
    return F.aggregate(ordered, zero, lambda a, p: F.when(p["end"] < a["end"], F.struct(
        p["end"].alias("end"), (a["n"] + 1).alias("n"), (a["stated"] + p["n_tokens"]).alias("stated"))).otherwise(a))


def scan(docs: DataFrame, path: Column, threshold: float = THRESHOLD, file_percent: int = FILE_PERCENT) -> DataFrame:
    """Licence of every file: its own best statement, or that of the nearest directory above that has a licence file.

    A match of a licence text comes before one of a notice, a whole file's before a block's. Statements that hold another one
    are not counted. A file whose statements hold at least ``file_percent`` % of its tokens is a licence file and speaks for its
    directory, the most frequent licence first, ties by name. Directories, not files, are joined with their ancestors.

    Null or empty texts have no statement and inherit; a null path has no directory and inherits nothing; repeated rows
    each get their row and count in their directory; no rows give no rows; further columns are ignored. Output: doc_id,
    path, own_licence, score, n_statements, inherited_from, licence.
    """
    whole = F.col("unit") == -1
    own = statements(docs, threshold).groupBy("of_doc", "of_text", "doc_tokens").agg(
        F.max(F.struct("rank", "score", "licence")).alias("best"), F.max(whole.cast("int")).alias("whole"),
        F.collect_set(F.when(~whole, F.struct("first", "end", "n_tokens"))).alias("places")).withColumn("inner", innermost(F.col("places"))).select(
        "of_doc", "of_text", F.col("best.licence").alias("own_licence"), F.col("best.score").alias("score"), F.col("inner.n").alias("n_statements"),
        ((F.col("whole") == 1) | (F.col("inner.stated") * 100 >= F.col("doc_tokens") * file_percent)).alias("speaks"))
    files = docs.select("doc_id", path.alias("path"), text_hash(F.col("text")).alias("text_hash")).withColumn(
        "directory", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")))
    files = files.join(own, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    speaking = files.where("speaks AND directory IS NOT NULL").groupBy("directory", "own_licence").agg((-F.count(F.lit(1))).alias("n"))
    speaking = speaking.groupBy(F.col("directory").alias("above")).agg(F.min(F.struct("n", "own_licence")).alias("m")).select(
        "above", F.col("m.own_licence").alias("said"))
    pieces = F.split("directory", "/")
    above = files.select("directory").where("directory IS NOT NULL").distinct().select(F.col("directory").alias("below"), F.posexplode(
        F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))).alias("depth", "above"))
    nearest = above.join(speaking, "above").groupBy("below").agg(F.max(F.struct("depth", "said", "above")).alias("m")).select(
        "below", F.col("m.said").alias("said"), F.col("m.above").alias("above"))
    joined = files.join(nearest, F.col("directory") == F.col("below"), "left")
    return joined.select("doc_id", "path", "own_licence", "score", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
                         F.when(F.col("own_licence").isNull(), F.col("above")).alias("inherited_from"),
                         F.coalesce("own_licence", "said").alias("licence"))


def document_path(per_directory: int = 100) -> Column:
    """Path of a document: source, language and a directory for each run of ids; null where there is no id."""
    return F.concat(F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"),
                    F.floor(F.col("doc_id") / per_directory).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def sql(threshold: float = THRESHOLD, file_percent: int = FILE_PERCENT, per_directory: int = 100) -> str:
    rows, idf, unknown, _ = template_vectors()
    vectors = ", ".join(f"({n}, '{licence}', '{t}', {w!r}::DOUBLE)" for n, licence, t, w in rows)
    weights = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in sorted(idf.items()))
    return f"""
WITH v(number, licence, token, weight) AS (VALUES {vectors}), i(token, idf) AS (VALUES {weights}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
             coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || CAST(CAST(floor(doc_id / {per_directory}) AS BIGINT) AS VARCHAR) AS directory FROM documents),
l AS (SELECT r, unnest(range(len(string_split(text, chr(10))))) AS unit, unnest(string_split(text, chr(10))) AS body FROM d
      UNION ALL SELECT r, -1, text FROM d),
t AS (SELECT r, unit, unnest(regexp_extract_all(lower(body), '{_WORD}')) AS token FROM l),
c AS (SELECT r, unit, t.token, count(*) AS n, count(*) * coalesce(any_value(idf), {unknown!r}::DOUBLE) AS value FROM t LEFT JOIN i ON i.token = t.token GROUP BY ALL),
z AS (SELECT r, unit, sqrt(sum(value * value)) AS norm, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT c.r, c.unit, z.n, licence, round(sum(value * weight) / any_value(norm), 6) AS score
      FROM c JOIN v ON v.token = c.token JOIN z ON z.r = c.r AND z.unit = c.unit GROUP BY c.r, c.unit, z.n, licence, number),
m AS (SELECT r, unit, any_value(n) AS n, max(score) AS score, max_by(licence, (score, licence)) AS licence FROM s WHERE score >= {threshold} GROUP BY r, unit),
o AS (SELECT m.r, max(score) AS score, max_by(licence, (score, licence)) AS own, count(CASE WHEN unit >= 0 THEN 1 END) AS n_statements,
             bool_or(unit < 0) OR coalesce(sum(CASE WHEN unit >= 0 THEN n END), 0) * 100 >= {file_percent} * any_value(total) AS speaks
      FROM m JOIN (SELECT r, n AS total FROM z WHERE unit = -1) USING (r) GROUP BY m.r),
f AS (SELECT * FROM d LEFT JOIN o USING (r)),
p AS (SELECT directory AS above, arg_min(own, (-n, own)) AS said FROM (SELECT directory, own, count(*) AS n FROM f WHERE speaks AND directory IS NOT NULL GROUP BY ALL) GROUP BY 1),
a AS (SELECT directory AS below, k, array_to_string(string_split(directory, '/')[1:k], '/') AS above FROM (
        SELECT directory, unnest(range(1, len(string_split(directory, '/')) + 1)) AS k FROM (SELECT DISTINCT directory FROM d WHERE directory IS NOT NULL))),
n AS (SELECT below, arg_max(said, k) AS said, arg_max(above, k) AS above FROM a JOIN p USING (above) GROUP BY below)
SELECT doc_id, directory || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, own AS own_licence, score, CAST(coalesce(n_statements, 0) AS BIGINT) AS n_statements,
       CASE WHEN own IS NULL THEN above END AS inherited_from, coalesce(own, said) AS licence
FROM f LEFT JOIN n ON n.below = f.directory"""
