"""Mixing sources to target weights along a training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credtrace.llm.common import words

WEIGHTS = (5, 2, 1)
CAP = 3
#: Weight of a source over the run as (time, weight) knots, dealt to the sources in turn; linear between knots.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (1.0, 1.75)))


def demand_steps(knots) -> list[tuple[float, float, float, float, float]]:
    """Per linear piece: demand before it, demand after it, start time, start weight, slope; all demand sums to 1."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, before, steps = sum(areas), 0.0, []
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        steps.append((before, before + area / total, a[0], a[1] / total, (b[1] - a[1]) / (b[0] - a[0]) / total))
        before += area / total
    return steps


def time_of(share: Column, schedule: Column, schedules=SCHEDULES) -> Column:
    """Time in 0..1 at which a source's integrated schedule has asked for ``share`` of its words."""
    chosen = F.lit(None).cast("double")
    for k, knots in reversed(list(enumerate(schedules))):
        at = F.lit(1.0)
        for before, after, start, weight, slope in reversed(demand_steps(knots)):
            rest = share - F.lit(before)
            root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
            found = F.lit(start) + F.lit(2.0) * rest / (F.lit(weight) + root)
            at = F.when(share < F.lit(after), found).otherwise(at)
        chosen = F.when(schedule == k, F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))).otherwise(chosen)
    return chosen


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """Per source its target: weights share all words, no target above ``cap`` times the source, the excess reshared.

    ``sizes`` has one row for each source (source, source_size). Resharing until nothing is above its limit ends where
    one common price per weight fills every source that is not full; sorted by size over weight, the full ones come
    first, so the price is found by running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("fill"), F.col("rank"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
              .withColumn("fill", F.col("source_size") / F.col("weight")))
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (ranked.withColumn("total", F.sum("source_size").over(everywhere))
              .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
              .withColumn("open_weight", F.sum("weight").over(after)))
    fits = F.col("left").cast("double") * F.col("weight") <= F.col("limit").cast("double") * F.col("open_weight")
    price = F.first(F.when(fits, F.struct("left", "open_weight")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("price", price)
    target = (F.when(F.col("total") == 0, F.lit(0.0)).when(F.col("price").isNull(), F.col("limit").cast("double"))
              .otherwise((F.col("weight") * F.col("price.left")).cast("double") / F.col("price.open_weight")))
    return ranked.select("source", "source_size", target.alias("target"), F.col("rank").alias("source_rank"))


def place(docs: DataFrame, weights=WEIGHTS, cap=CAP, schedules=SCHEDULES, bits=12) -> DataFrame:
    """Which documents a training mix takes, how often, and when each copy is due.

    A source offers its documents in the order of the md5 of their ids, again and again up to ``cap`` times. A copy is
    taken when its middle word lies inside the source's target, so each source ends within half a document of its target.
    Copies are placed at the time when the source's integrated schedule reaches their middle word.

    Running sums are made in two levels: over 2^bits slices of the id hash in a source, then inside a slice, so a source
    with any share of all rows is spread over that many groups. Only ids and sizes are shuffled, never texts.

    Returns (doc_id, source, size, source_size, target, copies, taken, position, positions). ``positions`` has the time of
    each copy, ``position`` that of the first, or above 1 for a document that is not taken. Null or wordless texts have size 0 and are never taken; a null
    source is a source of its own, last in order; a null doc_id hashes as the empty string; repeated rows count each;
    no rows give no rows; further columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    narrow = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"))
    narrow = narrow.withColumn("slice", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(1 << (32 - bits))).cast("int"))
    slices = narrow.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, cap)
    in_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(in_source), F.lit(0)))
    slices = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.source", "slice", "slice_start", "source_size", "target", "source_rank")
    rows = narrow.alias("n").join(slices.alias("s"), F.col("n.source").eqNullSafe(F.col("s.source")) & (
        F.col("n.slice") == F.col("s.slice"))).select("n.*", "slice_start", "source_size", "target", "source_rank")
    in_slice = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(in_slice), F.lit(0))
    rows = rows.withColumn("middle", start.cast("double") + F.col("size").cast("double") / 2)
    copies = sum((F.when((F.col("size") > 0) & (F.col("source_size") * n + F.col("middle") <= F.col("target")), 1)
                  .otherwise(0) for n in range(cap)), F.lit(0))
    share = F.when(F.col("target") > 0, F.col("middle") / F.col("target")).otherwise(
        F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)))
    rows = rows.withColumn("copies", copies).withColumn("share", share)
    position = F.when(F.col("copies") > 0, time_of(F.col("share"), F.col("source_rank") % len(schedules), schedules)).otherwise(
        F.lit(1.0) + F.col("share"))
    positions = F.transform(F.slice(F.array(*[F.lit(n).cast("long") for n in range(cap)]), F.lit(1), F.col("copies")), lambda n: time_of(
        (F.col("source_size") * n + F.col("middle")) / F.col("target"), F.col("source_rank") % len(schedules), schedules))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
                       (F.col("size") * F.col("copies")).alias("taken"), position.alias("position"), positions.alias("positions"))


def mix(docs: DataFrame, weights=WEIGHTS, cap=CAP, schedules=SCHEDULES, bits=12) -> DataFrame:
    """What ``place`` returns without the positions of further copies: a row for each document."""
    return place(docs, weights, cap, schedules, bits).drop("positions")


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorts mixed documents by the position of their first copy, ties by id; untaken ones come last."""
    return mixed.orderBy("position", "doc_id")


def training_order(placed: DataFrame) -> DataFrame:
    """A row for each taken copy, range-sorted by its position, ties by id and copy; untaken documents come last.

    ``copy`` counts a document's copies from 1 and ``taken`` has the words of this one; both are 0 for an untaken document.
    """
    rows = placed.select("*", F.posexplode_outer("positions").alias("nth", "due")).withColumns({
        "copy": F.coalesce(F.col("nth") + 1, F.lit(0)).cast("long"), "taken": F.when(F.col("due").isNull(), 0).otherwise(F.col("size")).cast("long"),
        "position": F.coalesce("due", "position")})
    return rows.drop("positions", "nth", "due").orderBy("position", "doc_id", "copy")


def sql(weights=WEIGHTS, cap=CAP, schedules=SCHEDULES) -> str:
    """The same in DuckDB: target by resharing round after round, order by one running sum for each source."""
    cases = []
    for k, knots in enumerate(schedules):
        for before, after, start, weight, slope in demand_steps(knots):
            cases.append(f"WHEN source_rank % {len(schedules)} = {k} AND share < {after!r}::DOUBLE THEN {start!r}::DOUBLE + 2.0::DOUBLE * (share - {before!r}::DOUBLE) / "
                         f"({weight!r}::DOUBLE + sqrt(greatest({weight * weight!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * (share - {before!r}::DOUBLE), 0.0::DOUBLE)))")
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_rank FROM d GROUP BY source),
w AS (SELECT *, CAST([{', '.join(map(str, weights))}][source_rank % {len(weights)} + 1] AS BIGINT) AS weight,
             {cap} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
f AS (SELECT 0 AS round, source_rank, weight, cap, total, FALSE AS full_ FROM w
      UNION ALL
      SELECT round + 1, source_rank, weight, cap, total, full_ OR
             weight * (total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) >
             cap * coalesce(sum(CASE WHEN NOT full_ THEN weight END) OVER (), 0)
      FROM f WHERE round < (SELECT count(*) FROM s)),
p AS (SELECT source_rank, CASE WHEN total = 0 THEN 0.0::DOUBLE WHEN full_ THEN cap::DOUBLE ELSE
             CAST(CAST(weight * (total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) AS BIGINT) AS DOUBLE) /
             CAST(sum(CASE WHEN NOT full_ THEN weight END) OVER () AS DOUBLE) END AS target
      FROM f WHERE round = (SELECT count(*) FROM s)),
r AS (SELECT d.doc_id, d.source, d.size, d.k, w.source_size, w.source_rank, p.target,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY w.source_rank ORDER BY d.k, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + CAST(d.size AS DOUBLE) / 2 AS middle
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN p USING (source_rank)),
c AS (SELECT *, CAST({' + '.join(f'CASE WHEN size > 0 AND source_size * {n} + middle <= target THEN 1 ELSE 0 END' for n in range(cap))} AS BIGINT) AS copies,
             CASE WHEN target > 0 THEN middle / target ELSE CAST(('0x' || substr(k, 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE END AS share FROM r)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken,
       CASE WHEN copies > 0 THEN least(greatest(CASE {' '.join(cases)} ELSE 1.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)
            ELSE 1.0::DOUBLE + share END AS position
FROM c"""
