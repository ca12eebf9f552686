"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept

#: Runs of anything but space and U+0009..U+000D.
WORD = r"[^ \t-\r]+"
#: Leaves of the hash space in which the fractional repetition of a source is cut: two
#: histograms of this many bits each, then the documents of a single leaf in order.
BITS = 12
HASH_BITS = 60
#: Sources whose plan may travel to every task.
TRAVELLING = 50_000


def _hash(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, total: int, cap: float) -> DataFrame:
    """Add target to (source, source_size, weight): shares of total by weight, none above
    cap times its size; what is cut off goes to the others by weight, until none is above.

    Only three sums leave the table in a round, and a round more is needed only when it
    clamps another source.
    """
    weigh = sources.agg(F.sum("weight")).first()[0] or 1
    exact = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")
    limit = F.col("source_size") * F.lit(cap)
    rest, weight, clamped = total, weigh, 0
    while True:
        above = exact(F.floor(limit)) * exact(weight) < exact(rest) * exact(F.col("weight"))
        n, held, freed = sources.agg(F.count_if(above), F.sum(F.when(above, F.floor(limit))), F.sum(F.when(above, F.col("weight")))).first()
        if n == clamped:
            break
        clamped, rest, weight = n, total - int(held), weigh - freed
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def _placed(totals: DataFrame, few: bool) -> DataFrame:
    """totals with place, from 0 in order of source, null last.

    A few sources are numbered at once; many in ranges of sources, each after what is before it.
    """
    order = F.col("source").asc_nulls_last()
    if few:
        return totals.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
    ranges = kept(totals.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = ranges.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.join(F.broadcast(before.drop("count")), "range").withColumn("place", own + F.col("before")).drop("range", "before")


def plan(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """The sizes of documents (doc_id, source, size, hash), and a row for each source: of, source_size,
    target, whole (repetitions of all), and where those that get one more end: prefix and last.

    What is made of the plan goes through the last result: up to TRAVELLING sources are marked
    for broadcast; more of them are joined.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(documents.select("doc_id", "source", words.alias("size"), _hash(F.col("doc_id"), seed).alias("hash")))
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = totals.count() <= TRAVELLING
    told = F.broadcast if few else lambda df: df
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    sources = cut(_placed(totals, few).select("source", "source_size", weight.alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(sources, total, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    found = cut(filled.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")))
    for level in (1, 2):  # find the leaf in which the rest is reached
        digit = F.shiftright("hash", HASH_BITS - BITS * level)
        inside = sized.join(told(found), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", HASH_BITS - BITS * (level - 1)) == F.col("prefix")))
        cells = inside.groupBy("of", digit.alias("cell")).agg(F.sum("size").alias("in_cell"))
        upto = F.sum("in_cell").over(Window.partitionBy("of").orderBy("cell")).alias("upto")
        cells = cells.select("of", "cell", "in_cell", upto).join(told(found.select(F.col("of").alias("plan_of"), "rest", "before")), F.col("of").eqNullSafe(F.col("plan_of")))
        reached = cells.filter(F.col("upto") + F.col("before") >= F.col("rest"))
        first = reached.groupBy("plan_of").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("in_cell") + F.col("before")).alias("before")), "cell").alias("found"))
        found = cut(found.drop("prefix", "before").join(told(first), F.col("of").eqNullSafe(F.col("plan_of")), "left").select("of", "source_size", "target", "whole", "rest", F.coalesce("found.cell", F.lit(1 << BITS * level)).alias("prefix"), F.coalesce("found.before", F.lit(0)).alias("before")))
    inside = sized.join(told(found), F.col("source").eqNullSafe(F.col("of")) & (_leaf(F.col("hash")) == F.col("prefix")))
    units = inside.groupBy("of", "hash", "doc_id", "rest", "before").agg(F.sum("size").alias("unit"))
    upto = F.sum("unit").over(Window.partitionBy("of").orderBy("hash", "doc_id"))
    near = units.withColumn("upto", upto).filter(2 * (F.col("before") + F.col("upto")) - F.col("unit") <= 2 * F.col("rest"))
    last = near.groupBy(F.col("of").alias("last_of")).agg(F.max(F.struct("hash", "doc_id")).alias("last"))
    found = cut(found.join(told(last), F.col("of").eqNullSafe(F.col("last_of")), "left").drop("last_of", "rest", "before"))
    return sized, found, told


def _leaf(hash_: Column) -> Column:
    return F.shiftright(hash_, HASH_BITS - 2 * BITS)


def _times(hash_: Column, doc_id: Column, of: str = "") -> Column:
    """How often a document is repeated, by its hash and the plan of its source."""
    behind = (_leaf(hash_) == F.col(f"{of}prefix")) & (F.struct(hash_.alias("hash"), doc_id.alias("doc_id")) <= F.col(f"{of}last"))
    return F.col(f"{of}whole") + F.when((_leaf(hash_) < F.col(f"{of}prefix")) | F.coalesce(behind, F.lit(False)), 1).otherwise(0)


def repetitions(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, reps) for each document.

    Sources in order of code points, null last, take the weights in turn. Every document
    is repeated as many whole times as its source's target holds its size; those first in
    the order of a seeded hash once more, up to where the source comes nearest its target.
    Rows with the same doc_id and source go together. An empty table gives no rows; a
    source without words takes nothing.
    """
    sized, found, told = plan(documents, seed, weights, cap)
    met = sized.join(told(found), F.col("source").eqNullSafe(F.col("of")))
    return met.select("doc_id", "source", "size", "source_size", "target", _times(F.col("hash"), F.col("doc_id")).alias("reps"))


def taken(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words with repeats) of every document."""
    return repetitions(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


def mix(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents themselves, each as often as the mix repeats it; columns as they were.

    Repetitions follow from a row and the plan of its source, so that no text is moved.
    """
    _, found, told = plan(documents.select("doc_id", "text", "source"), seed, weights, cap)
    own = found.select(*(F.col(c).alias(f"_mix_{c}") for c in ("of", "whole", "prefix", "last")))
    met = documents.join(told(own), F.col("source").eqNullSafe(F.col("_mix_of")))
    copies = met.withColumn("_mix_times", _times(_hash(F.col("doc_id"), seed), F.col("doc_id"), "_mix_")).filter("_mix_times > 0")
    return copies.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int")))).select(*documents.columns)


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size,
         substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM sources),
stepped AS (
  SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM ranked),
level AS (
  SELECT arg_min(rest, k) AS rest, arg_min(open, k) AS open FROM stepped WHERE 3 * source_size * open >= rest * weight),
filled AS (
  SELECT source, source_size, CASE WHEN 3 * source_size * level.open < level.rest * weight THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(level.rest AS DOUBLE) * weight / CAST(level.open AS DOUBLE) END AS target FROM stepped, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled),
summed AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash, s.doc_id) AS unit
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * upto - unit <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM summed
"""
