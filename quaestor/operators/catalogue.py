"""Type catalogues: repeated subjects, redirects, concordances, number index, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SHARD_BYTES = 4 * 1024 * 1024


def fold_subjects(rows: DataFrame, key: str, multi: list[str], scalar: list[str]) -> DataFrame:
    """Repeated subjects as one: values of multi in order of row_idx without repeats; a scalar that
    differs is null and flags a conflict."""
    first = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("row_idx", c)))), lambda x: x[c]))
    one = lambda c: F.when(F.count_distinct(c) == 1, F.min(c))
    conflict = F.greatest(*(F.count_distinct(c) for c in scalar), F.lit(0)) > 1
    return rows.groupBy(key).agg(*(first(c).alias(c) for c in multi), *(one(c).alias(c) for c in scalar), conflict.alias("conflict"))


def resolve_redirects(links: DataFrame, kept: DataFrame) -> DataFrame:
    """(old, target, status) of replacement links (old, new): followed to a kept id.

    ambiguous: more than one successor; cycle: it never ends; dangling: it ends at an id that
    is not kept. Chains double their reach in each round, so rounds grow with the logarithm
    of the longest one. A chain that ends and is longer than the reach has a row that ends
    within twice the reach; so when a round ends none, all that are still open are cycles.
    """
    grouped = links.groupBy("old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("new"))
    now = cut(grouped.select("old", F.when(F.col("n") == 1, F.col("new")).alias("at")))
    before = -1
    while True:
        jump = now.select(F.col("old").alias("mid"), F.col("at").alias("next"), F.lit(True).alias("hit"))
        now = cut(now.join(jump, F.col("at") == F.col("mid"), "left").select("old", F.when(F.col("hit"), F.col("next")).otherwise(F.col("at")).alias("at"), F.col("hit").alias("open")))
        still = now.filter("open").count()  # rows that were open before this round
        if still in (0, before):
            break
        before = still
    heads = grouped.select(F.col("old").alias("head"), F.lit(True).alias("is_link"))
    good = kept.select(F.col("id").alias("kept_id")).distinct()
    done = now.join(heads, F.col("at") == F.col("head"), "left").join(good, F.col("at") == F.col("kept_id"), "left")
    status = F.when(F.col("at").isNull(), "ambiguous").when(F.col("is_link"), "cycle").when(F.col("kept_id").isNull(), "dangling").otherwise("ok")
    return done.select("old", F.when(status == "ok", F.col("at")).alias("target"), status.alias("status"))


def concordance(links: DataFrame, bundled: DataFrame) -> DataFrame:
    """Old ids with all their targets, of those whose every target is bundled."""
    ids = bundled.select(F.col("id").alias("target"), F.lit(True).alias("here")).distinct()
    return links.join(ids, "target", "left").groupBy("old").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.every(F.coalesce("here", F.lit(False))).alias("whole")).filter("whole").drop("whole")


def leading_number(title: Column) -> Column:
    """The integer that a title's last word starts with, by which numbers are indexed."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(title, " "), -1), r"^(\d+)", 1), F.lit("")).cast("bigint")


def number_index(types: DataFrame) -> DataFrame:
    """number -> ids that start with it, in order."""
    return types.withColumn("number", leading_number(F.col("title"))).filter("number is not null").groupBy("number").agg(F.array_sort(F.collect_list("id")).alias("ids"))


#: A group has so many parts at most, one for each letter.
PARTS = 26


def shard_parts(records: DataFrame, limit: int = SHARD_BYTES, overhead: int = 0) -> DataFrame:
    """records (group, id, bytes) with part: the fewest even parts of a group, in order of id, none of
    which is above limit with its overhead. bytes is a record with the separator behind it; the last
    one of a part has none.

    A record opens the next part once what is before it has passed that part's share of the
    group. A record above the limit, and a group that needs more than PARTS parts, are errors, raised
    here. So a group holds about PARTS times limit bytes at most, which is seen before any group is put in
    order. No records, no parts.
    """
    sizes = cut(records.groupBy("group").agg(F.sum("bytes").alias("_total"), F.max("bytes").alias("_most")))
    most, total = sizes.agg(F.max("_most"), F.max("_total")).first()
    if most is not None and most - 1 + overhead > limit:
        raise ValueError("a record is larger than a part may be")
    if total is not None and total > PARTS * (limit - overhead + 1):
        raise ValueError("a group needs more parts than there are letters")
    # Every number of parts that may do, at once: groups are small, and rows hold three numbers.
    counts = sizes.select(F.col("group").alias("_group"), "_total", F.explode(F.sequence(F.greatest(F.ceil(F.col("_total") / (limit - overhead + 1)), F.lit(1)), F.lit(PARTS).cast("bigint"))).alias("_count"))
    own = Window.partitionBy("group", "_count").orderBy("id")
    before = F.coalesce(F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    placed = records.select("group", "id", "bytes").join(counts, F.col("group").eqNullSafe(F.col("_group"))).withColumns({"_before": before, "_at": F.row_number().over(own)})
    # A part behind its share catches up by one a record, so the least lead up to here decides.
    share = F.least(F.call_function("div", F.col("_before") * F.col("_count"), F.greatest("_total", F.lit(1))), F.col("_count") - 1)
    lead = F.min(F.col("_share") - F.col("_at")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    tried = placed.withColumn("_share", share).select("group", "_count", "id", "bytes", F.least(F.col("_at") + lead, F.col("_share")).cast("int").alias("part"))
    full = tried.groupBy("group", "_count", "part").agg(F.sum("bytes").alias("_size")).groupBy("group", "_count").agg(F.max("_size").alias("_size"))
    chosen = cut(full.filter(F.col("_size") - 1 + overhead <= limit).groupBy(F.col("group").alias("_g")).agg(F.min("_count").alias("_c")))
    if chosen.count() < sizes.count():
        raise ValueError("a group needs more parts than there are letters")
    parts = tried.join(chosen, F.col("group").eqNullSafe(F.col("_g")) & (F.col("_count") == F.col("_c"))).select(F.col("group").alias("_g"), F.col("id").alias("_id"), "part")
    return records.join(parts, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_id"))).drop("_g", "_id")


def agreed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values are unanimous."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def labelled(ids: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """ids with the first label that the tables (slug, label) have, in their order, else the slug."""
    rows = ids
    for k, table in enumerate(tables):
        rows = rows.join(table.select(F.col("slug").alias(f"_s{k}"), F.col("label").alias(f"_l{k}")), F.col(key) == F.col(f"_s{k}"), "left")
    return rows.select(*ids.columns, F.coalesce(*(f"_l{k}" for k in range(len(tables))), key).alias("label"))
