"""Exposure, collection totals, comparables, queues and want lists over lots and auctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import FEES, SAFE, bid_cost, currency_rank, exact, premium, sticky_sum
from ..functions.text import with_identity_key


def exposure(lots: DataFrame) -> DataFrame:
    """Open bids per currency, and per currency and event, in one pass with grouping sets.

    A bid without a premium rate counts with its hammer only; the all-in total counts where
    the fee sheet is in the bid's currency. A total that can't be held exactly is an error.
    """
    open_ = lots.filter((F.col("outcome") == "open") & F.col("bid_minor").isNotNull())
    event = F.coalesce(F.col("event_id").cast("string"), F.lit("unassigned"))
    both = premium(F.col("bid_minor"), F.col("premium_bps"))["hammer_plus_premium"]
    fees = {f: F.col(f) for f in FEES if f in lots.columns}
    total = F.when(F.col("sheet_currency") == F.col("currency"), bid_cost(F.col("bid_minor"), F.col("premium_bps"), fees)["total"])
    rows = open_.select("currency", event.alias("event_id"), "bid_minor", "premium_bps", both.alias("both"), total.alias("total"))
    held = lambda c: F.when(F.sum(exact(F.col(c))) > SAFE, F.raise_error(F.lit("unsafe exposure")).cast("bigint")).otherwise(F.coalesce(F.sum(c), F.lit(0)))
    summed = rows.groupingSets([["currency"], ["currency", "event_id"]], "currency", "event_id").agg(
        F.grouping("event_id").alias("all_events"), F.count(F.lit(1)).alias("binding_count"), held("bid_minor").alias("hammer_minor"),
        F.count_if(F.col("premium_bps").isNull()).alias("unknown_premium_count"), held("both").alias("known_hammer_plus_bp_minor"),
        F.count("total").alias("total_count"), held("total").alias("known_total_minor"),
    )
    return summed.orderBy(currency_rank(F.col("currency")), F.desc("all_events"), "event_id")


def collection_totals(amounts: DataFrame) -> DataFrame:
    """Per currency over (entry_id, kind, currency, minor, year): entries, counts and sums by
    kind, years. An entry with two currencies counts in both; unsafe sums are null."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("minor"))
    kinds = ("hammer", "cost", "invoice")
    return amounts.groupBy("currency").agg(
        F.count_distinct("entry_id").alias("entry_count"), *(F.count(of(k)).alias(f"{k}_count") for k in kinds),
        *(sticky_sum(of(k)).alias(f"{k}_minor") for k in kinds), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def comparables(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entries joined with evidence of the same normalized reference and currency: counts and range.

    Keys are normalized and evidence is reduced to a row a key before the join.
    """
    rows = with_identity_key(evidence, "reference", "ref_key").filter("ref_key <> '' and minor is not null")
    reduced = rows.groupBy("ref_key", "currency").agg(F.count(F.lit(1)).alias("comparable_count"), F.min("minor").alias("low_minor"), F.max("minor").alias("high_minor"))
    keyed = with_identity_key(entries, "reference", "ref_key")
    return keyed.join(reduced, ["ref_key", "currency"], "left").drop("ref_key").withColumn("comparable_count", F.coalesce("comparable_count", F.lit(0)))


def queue(lots: DataFrame, name: str) -> DataFrame:
    """Lots (with the state and sort_at of their auctions) of a queue, in its order.

    Timed and undated sales are in order of time, lots without one last, then as saved.
    """
    open_ = F.coalesce("outcome", F.lit("open")) == "open"
    state = F.coalesce("state", F.lit("unknown"))
    tests = {
        "all-coins": F.lit(True), "completed": ~open_, "closing-soon": open_ & (state == "soon"), "needs-outcome": open_ & (state == "ended"),
        "needs-research": open_ & (F.trim(F.coalesce("reference", F.lit(""))) == ""), "planned": open_ & F.col("planned_minor").isNotNull() & F.col("bid_minor").isNull(),
        "active": open_ & F.col("bid_minor").isNotNull(), "all-open": open_,
    }
    return lots.filter(tests[name]).orderBy(F.col("sort_at").asc_nulls_last(), "idx")


def coins_to_watch(lots: DataFrame, limit: int = 5) -> DataFrame:
    """At most five: ended without an outcome, then the next to come, then newest without a sale."""
    open_ = F.coalesce("outcome", F.lit("open")) == "open"
    tier = F.when(open_ & (F.col("state") == "ended"), 1).when(open_ & F.col("state").isin("soon", "upcoming", "started"), 2).when(open_ & F.col("event_id").isNull(), 3)
    order = [F.col("tier"), F.when(F.col("tier") == 2, F.col("sort_at")), F.when(F.col("tier") == 3, F.col("created_at")).desc(), F.col("idx")]
    return lots.withColumn("tier", tier).filter("tier is not null").orderBy(*order).limit(limit)


def compact_priorities(lots: DataFrame) -> DataFrame:
    """Priorities 1 to n in each group by (priority, id); groups that have them already stay."""
    own = Window.partitionBy("group_id")
    rank = F.row_number().over(own.orderBy("priority", "id"))
    ready = (F.min("priority").over(own) == 1) & (F.max("priority").over(own) == F.count(F.lit(1)).over(own)) & (F.size(F.collect_set("priority").over(own)) == F.count(F.lit(1)).over(own))
    return lots.withColumn("new_priority", F.when(ready, F.col("priority")).otherwise(rank).cast("int"))


def duplicate_lots(lots: DataFrame, incoming: DataFrame) -> DataFrame:
    """(candidate_id, id): for each incoming lot the first local one with which it shares a page, a
    canonical address or the (house, sale, lot) identity; two different identities rule a pair out.

    Keys of all kinds are put in one column, so one equi join replaces the disjunction.
    """

    def keyed(df: DataFrame) -> DataFrame:
        urls = F.array_compact(F.array(*(F.when(F.col(c) != "", F.concat(F.lit("u:"), F.col(c))) for c in ("page_url", "canonical_url"))))
        return df.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.concat(urls, F.array(F.concat(F.lit("t:"), F.col("identity"))))))))

    ours = keyed(lots).select("key", "id", "idx", F.col("identity").alias("own_identity"))
    theirs = keyed(incoming).select("key", F.col("id").alias("candidate_id"), F.col("identity").alias("candidate_identity"))
    # Only the first local lot of a key and identity can win, so hot keys join a row each.
    firsts = ours.groupBy("key", "own_identity").agg(F.min_by(F.struct("idx", "id"), F.struct("idx", "id")).alias("first"))
    met = theirs.join(firsts, "key").filter(F.coalesce(F.col("own_identity") == F.col("candidate_identity"), F.lit(True)))
    return met.groupBy("candidate_id").agg(F.min("first").alias("first")).select("candidate_id", "first.id")


def want_matches(wants: DataFrame, lots: DataFrame) -> DataFrame:
    """Wants and lots of one type: catalogue, volume, section and base number are equal; a bracketed
    letter must agree only if both have one. Parsed readings come as columns."""
    keys = ["catalogue", "volume", "section", "base"]
    w = wants.select(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), F.col("id").alias("want_id"), F.coalesce("bracket", F.lit("")).alias("want_bracket"))
    o = lots.select(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), F.col("id").alias("lot_id"), F.coalesce("bracket", F.lit("")).alias("lot_bracket"))
    agree = (F.col("want_bracket") == "") | (F.col("lot_bracket") == "") | (F.col("want_bracket") == F.col("lot_bracket"))
    return w.join(o, keys).filter(agree).select("want_id", "lot_id")
