"""Commands on the bids of lots: an ordered log with expected revisions, folded for each lot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: What a command may be, and why it may be refused, in the order of the checks.
COMMANDS = ("bid.plan", "bid.place", "bid.cancel", "lot.outcome.set", "lot.delete")
REFUSALS = ("not-found", "conflict", "not-open", "no-plan", "no-bid", "collection-link", "active-bid")


def apply(lots: DataFrame, commands: DataFrame) -> DataFrame:
    """The lots after their commands: id, live, revision, planned, active, outcome, refusals and bids.

    lots: id, revision, planned, active (minor or null), outcome, linked. commands: lot_id, request_id,
    seq, kind, expected, amount, outcome. A request counts once, at its first place. One whose expected revision
    is not the lot's is a conflict. Only an open lot takes bids; a plan without an amount clears the plan
    there is; placing a bid ends the plan; an outcome settles the bid; a lot with a bid in
    force or an entry in the collection is not deleted. refusals has seq and reason of each
    command refused, bids what was done to the lot's bids, in order. A lot without commands stays as it is;
    commands for no lot are dropped, see orphans. The log of a lot is folded in its order, so it is held in one place.
    """
    # No command stands before the first of its request. Asked so, rows are put in order once they are dealt, and not before it too.
    before = F.lag(F.lit(1)).over(Window.partitionBy("request_id").orderBy("seq"))
    once = commands.withColumn("_before", before).filter("_before IS NULL")
    logs = once.groupBy(F.col("lot_id").alias("_lot")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "expected", "amount", "outcome"))).alias("log"))
    begin = F.struct(
        F.lit(True).alias("live"), F.col("revision").cast("bigint").alias("revision"), F.col("planned").cast("bigint").alias("planned"), F.col("active").cast("bigint").alias("active"),
        F.col("outcome").alias("outcome"), F.array().cast("array<struct<seq:bigint,reason:string>>").alias("refusals"), F.array().cast("array<struct<action:string,amount:bigint>>").alias("bids"),
    )

    def step(s: Column, c: Column) -> Column:
        return let(F.struct(refused(s, c).alias("reason")), lambda r: done(s, c, r["reason"]))

    def refused(s: Column, c: Column) -> Column:
        kind, bid = c["kind"], c["kind"].isin("bid.plan", "bid.place", "bid.cancel")
        return (
            F.when(~s["live"], "not-found").when(~c["expected"].eqNullSafe(s["revision"]), "conflict")
            .when(bid & (s["outcome"] != "open"), "not-open").when((kind == "bid.plan") & c["amount"].isNull() & s["planned"].isNull(), "no-plan")
            .when((kind == "bid.cancel") & s["active"].isNull(), "no-bid")
            .when((kind == "lot.delete") & F.col("linked"), "collection-link").when((kind == "lot.delete") & s["active"].isNotNull(), "active-bid")
        )

    def done(s: Column, c: Column, reason: Column) -> Column:
        kind, good = c["kind"], reason.isNull()
        plan, place = good & (kind == "bid.plan"), good & (kind == "bid.place")
        gone = good & kind.isin("bid.cancel", "lot.outcome.set")
        did = lambda test, action, amount: F.when(test, F.struct(action.alias("action"), amount.cast("bigint").alias("amount")))
        cleared = (plan & c["amount"].isNull()) | (place & s["planned"].isNotNull())
        settled = good & (kind == "lot.outcome.set") & s["active"].isNotNull()
        actions = F.array_compact(F.array(
            did(cleared, F.lit("planned-cleared"), s["planned"]), did(plan & c["amount"].isNotNull(), F.lit("planned-revised"), c["amount"]),
            did(place, F.when(s["active"].isNull(), "placed").otherwise("active-revised"), c["amount"]),
            did(good & (kind == "bid.cancel"), F.lit("externally-cancelled"), s["active"]),
            did(settled, F.when(c["outcome"] == "won", "settled-won").otherwise("settled-lost"), s["active"]),
        ))
        return F.struct(
            (s["live"] & ~(good & (kind == "lot.delete"))).alias("live"), F.when(good, s["revision"] + 1).otherwise(s["revision"]).alias("revision"),
            F.when(plan, c["amount"].cast("bigint")).when(place | (good & (kind == "lot.outcome.set")), F.lit(None)).otherwise(s["planned"]).alias("planned"),
            F.when(place, c["amount"].cast("bigint")).when(gone, F.lit(None)).otherwise(s["active"]).alias("active"),
            F.when(good & (kind == "lot.outcome.set"), c["outcome"]).otherwise(s["outcome"]).alias("outcome"),
            F.when(good, s["refusals"]).otherwise(F.concat(s["refusals"], F.array(F.struct(c["seq"].cast("bigint").alias("seq"), reason.alias("reason"))))).alias("refusals"),
            F.concat(s["bids"], actions).alias("bids"),
        )

    none = F.array().cast(logs.schema["log"].dataType)
    both = lots.join(logs, F.col("id") == F.col("_lot"), "left")
    return both.select("id", F.aggregate(F.coalesce("log", none), begin, step).alias("s")).select("id", "s.*")


def orphans(lots: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands for lots that are not there."""
    return commands.join(lots.select(F.col("id").alias("lot_id")), "lot_id", "left_anti")
