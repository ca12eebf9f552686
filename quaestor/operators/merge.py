"""Two-sided merge of snapshots, referential checks and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def ceiling(exported_at: Column, now: Column) -> Column:
    """What an incoming change may claim at most: the export's time, or now if that is more than a day ahead."""
    return F.when(F.unix_seconds(exported_at) - F.unix_seconds(now) > DAY, now).otherwise(exported_at)


def decide(local: DataFrame, incoming: DataFrame, limit: Column, payload: list[str]) -> DataFrame:
    """Each id of either side with its decision and the row that stays.

    Equal rows and older changes keep the local one; a later change is taken with the next
    revision; a new id whose identity is known is skipped, any other added. Columns: id,
    revision, updated_at, identity and the payload.
    """
    ours = local.select("id", *(F.col(c).alias(f"l_{c}") for c in ("revision", "updated_at", "identity", *payload)))
    theirs = incoming.select("id", *(F.col(c).alias(f"r_{c}") for c in ("revision", "updated_at", "identity", *payload)))
    known = local.filter("identity is not null").select(F.col("identity").alias("r_identity"), F.lit(True).alias("known")).distinct()
    both = ours.join(theirs, "id", "full_outer").join(known, "r_identity", "left")
    same = F.lit(True)
    for c in payload:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    new = F.col("l_revision").isNull()
    later = F.least("r_updated_at", limit) > F.col("l_updated_at")
    decision = (
        F.when(F.col("r_revision").isNull(), "local only").when(~new & same, "kept local").when(~new & ~later, "kept local")
        .when(~new, "updated").when(F.coalesce("known", F.lit(False)), "skipped").otherwise("added")
    )
    take = F.col("decision").isin("updated", "added")
    revision = F.when(F.col("decision") == "updated", F.greatest("l_revision", "r_revision") + 1).when(F.col("decision") == "added", F.col("r_revision")).otherwise(F.col("l_revision"))
    chosen = [F.when(take, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in ("updated_at", *payload)]
    return both.withColumn("decision", decision).select("id", "decision", revision.alias("revision"), *chosen)


def changed_fields(before: dict[str, Column], after: dict[str, Column], most: int = 8) -> Column:
    """Names of the fields that differ, the first eight, then how many more."""
    names = F.array_compact(F.array(*(F.when(~before[k].eqNullSafe(after[k]), F.lit(k)) for k in before)))
    more = F.when(F.size(names) > most, F.concat(F.lit(" and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), more)


def dangling(rows: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose key points nowhere."""
    return rows.filter(F.col(key).isNotNull()).join(targets.select(F.col(target).alias("_to")), F.col(key) == F.col("_to"), "left_anti")


def quarantine(rows: DataFrame, checks: dict[str, Column], key: str, order: list[str]) -> DataFrame:
    """rows with the first reason to set them aside: a failed check in its order, or a repeated id
    (all but the first); null for those that stay."""
    repeated = F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1
    reason = F
    for name, bad in checks.items():
        reason = reason.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    return rows.withColumn("_again", repeated).withColumn("reason", reason.when(F.col("_again"), F.lit("duplicate-id"))).drop("_again")


def fold(set_aside: DataFrame) -> DataFrame:
    """Set-aside rows of one body and reason as one: the earliest date, all links."""
    return set_aside.groupBy("body", "reason").agg(F.min("set_aside_at").alias("set_aside_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("links")))).alias("links"))


def apply_commands(commands: DataFrame) -> DataFrame:
    """The state after an ordered log of puts and deletes with expected revisions, per id.

    A repeated request counts once, at its first place; a command whose expected revision is
    not the row's is refused. Commands of an id are folded in order.
    """
    first = Window.partitionBy("request_id").orderBy("seq")
    once = commands.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    logs = once.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "expected", "value"))).alias("log"))
    begin = F.struct(F.lit(0).alias("revision"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("live"), F.lit(0).alias("refused"))

    def step(s: Column, c: Column) -> Column:
        good = c["expected"] == F.when(s["live"], s["revision"]).otherwise(0)
        put = c["kind"] == "put"
        return F.struct(
            F.when(good, s["revision"] + 1).otherwise(s["revision"]).alias("revision"), F.when(good, F.when(put, c["value"])).otherwise(s["value"]).alias("value"),
            F.when(good, put).otherwise(s["live"]).alias("live"), F.when(good, s["refused"]).otherwise(s["refused"] + 1).alias("refused"),
        )

    return logs.select("id", F.aggregate("log", begin, step).alias("s")).select("id", "s.*")
