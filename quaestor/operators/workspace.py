"""Lists and filters of a collector's workspace: settled lots, auctions, wants, drafts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import CURRENCIES, currency_rank

#: A draft lives a day, and the newest of them stay.
DRAFT_SECONDS, DRAFTS = 24 * 3600, 20


def with_own(entries: DataFrame, lots: DataFrame, key: str = "lot_id") -> DataFrame:
    """Collection entries with their lots (columns own_*), where there is one."""
    return entries.join(lots.select(*(F.col(c).alias(f"own_{c}") for c in lots.columns)), F.col(key) == F.col("own_id"), "left")


def history(lots: DataFrame, column: str) -> DataFrame:
    """A row for each entry of a lot's history, numbered from zero in its order."""
    return lots.select("id", F.posexplode(column).alias("position", "entry")).select("id", "position", "entry.*")


def containing(lots: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Lots that hold the query, in any case, in one of the columns; all of them for a blank query."""
    wanted = F.lit(query.strip().lower())
    found = [F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False)) for c in columns]
    test = found[0]
    for f in found[1:]:
        test = test | f
    return lots if not query.strip() else lots.filter(test)


def settled(lots: DataFrame, query: str, columns: list[str], year: int | None, outcomes: list[str]) -> DataFrame:
    """Settled lots that hold the query, of a year and of some outcomes where these are given, newest first."""
    rows = containing(lots.filter("outcome <> 'open'"), query, columns)
    rows = rows if year is None else rows.filter(F.year("settled_at") == year)
    rows = rows if not outcomes else rows.filter(F.col("outcome").isin(*outcomes))
    return rows.orderBy(F.col("settled_at").desc_nulls_last(), "idx")


def split_auctions(timed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Auctions still to come, soonest first, and those that are over, latest first."""
    over = F.coalesce(F.col("state") == "ended", F.lit(False))
    return timed.filter(~over).orderBy(F.col("sort_at").asc_nulls_last(), "event"), timed.filter(over).orderBy(F.col("sort_at").desc(), "event")


def compared(lots: DataFrame, selected: DataFrame) -> DataFrame:
    """The lots that selected (id, position) names, in the order of the selection."""
    return selected.join(lots, "id").orderBy("position")


def status_label(outcome: Column, active: Column, planned: Column) -> Column:
    """Won, Lost, Passed, Closed, Bid active, Bid planned or Watching."""
    named = {"won": "Won", "lost": "Lost", "passed": "Passed"}
    label = F
    for key, name in named.items():
        label = label.when(outcome == key, name)
    return label.when(outcome != "open", "Closed").when(active.isNotNull(), "Bid active").when(planned.isNotNull(), "Bid planned").otherwise("Watching")


def short_edition(volume: Column) -> Column:
    """A volume with its edition in short form: 'I (2nd edition)' is 'I²'."""
    return F.regexp_replace(volume, r" ?\(2nd edition\)", "²")


def want_rows(wants: DataFrame, matches: DataFrame) -> DataFrame:
    """Wants with how many lots match, those not found first, then in their order."""
    n = matches.groupBy("want_id").agg(F.count(F.lit(1)).alias("lot_count"))
    rows = wants.join(n, F.col("id") == F.col("want_id"), "left").drop("want_id").withColumn("lot_count", F.coalesce("lot_count", F.lit(0)))
    return rows.orderBy(F.col("found_lot_id").isNotNull(), "idx")


def open_wants(wants: DataFrame, matches: DataFrame) -> DataFrame:
    """Wants not found yet that some lot matches."""
    return wants.filter("found_lot_id is null").join(matches.select(F.col("want_id").alias("id")).distinct(), "id", "left_semi")


def unwanted(candidates: DataFrame, wants: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates for which no want of the same reading is there."""
    same = [F.coalesce(F.col(f"c.{k}"), F.lit("")) == F.coalesce(F.col(f"w.{k}"), F.lit("")) for k in keys]
    return candidates.alias("c").join(wants.alias("w"), same, "left_anti")


def live_drafts(drafts: DataFrame, now: Column) -> DataFrame:
    """Drafts not a day old, the newest ones of each owner."""
    alive = drafts.filter(F.unix_seconds("saved_at") + DRAFT_SECONDS > F.unix_seconds(now))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("saved_at"), F.desc("id")))
    return alive.withColumn("_place", place).filter(F.col("_place") <= DRAFTS).drop("_place")


def newest(rows: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group in an order: recent terms, diagnostics, a ledger."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_place") <= limit).drop("_place")


def month_headings(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """rows with heading, the month where it differs from that of the row before."""
    month = F.date_format(at, "yyyy-MM")
    before = F.lag(month).over(Window.partitionBy(*by).orderBy(at, "id"))
    return rows.withColumn("heading", F.when(before.isNull() | (before != month), month))


def last_action(history: Column, actions: list[str]) -> Column:
    """The last entry of a history whose action is one of these; null without any."""
    return F.try_element_at(F.filter(history, lambda x: x["action"].isin(*actions)), F.lit(-1))


def dense_exposure(exposure: DataFrame) -> DataFrame:
    """Exposure for every currency in order, zero where there is none."""
    all_of = exposure.sparkSession.createDataFrame([(c,) for c in CURRENCIES], "currency string")
    sums = exposure.filter("all_events = 1").select("currency", "binding_count", "hammer_minor")
    return all_of.join(sums, "currency", "left").fillna(0, ["binding_count", "hammer_minor"]).orderBy(currency_rank(F.col("currency")))


def remembered_zone(events: DataFrame) -> DataFrame:
    """house, zone: of each house, its name cut before the sale's number, the zone of the event updated last."""
    house = F.lower(F.trim(F.regexp_replace("name", r"[,\s]*\d.*$", "")))
    rows = events.filter("zone is not null").withColumn("house", house).filter("house <> ''")
    return rows.groupBy("house").agg(F.max_by("zone", F.struct("updated_at", "id")).alias("zone"))


def preset_for(lots: DataFrame, presets: DataFrame) -> DataFrame:
    """lots with the premium of the preset of their house, whose names compare squashed and in lower case."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    told = presets.select(key(F.col("house")).alias("_house"), F.col("premium_bps").alias("preset_bps")).groupBy("_house").agg(F.min("preset_bps").alias("preset_bps"))
    return lots.join(told, key(F.col("house")) == F.col("_house"), "left").drop("_house")


def stored_bytes(rows: DataFrame) -> DataFrame:
    """rows and bytes: how many there are, and their size as JSON."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))), F.lit(0)).alias("bytes"))


def lot_comparables(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Per group and currency how many prices are counted and their range, groups with most rows first."""
    counted = evidence.filter("exclusion_reason is null and minor is not null")
    return counted.groupBy(*by, "currency").agg(F.count(F.lit(1)).alias("n"), F.min("minor").alias("low"), F.max("minor").alias("high")).orderBy(*by, F.desc("n"), "currency")


def matched(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, status, ids: an exact title is ok; else up to five entries are candidates; else none.

    entries (query_id, id, title) are what a search gave, in order of position where they have one, else of id;
    queries (query_id, title) what was asked. Of several exact titles the first counts.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    place = F.struct(F.col("position") if "position" in entries.columns else F.lit(0), "id")
    hits = entries.select("query_id", "id", "title", place.alias("_place"))
    both = queries.select("query_id", key(F.col("title")).alias("_asked")).join(hits, "query_id", "left")
    same = F.when(key(F.col("title")) == F.col("_asked"), F.col("_place"))
    here = F.collect_set(F.when(F.col("id").isNotNull(), F.col("_place")))
    found = both.groupBy("query_id").agg(F.min(same)["id"].alias("_exact"), F.count("id").alias("_n"), F.array_distinct(F.transform(F.array_sort(here), lambda x: x["id"])).alias("_ids"))
    few = F.col("_n").between(1, 5)
    status = F.when(F.col("_exact").isNotNull(), "ok").when(few, "candidates").otherwise("none")
    return found.select("query_id", status.alias("status"), F.when(F.col("_exact").isNotNull(), F.array("_exact")).when(few, F.col("_ids")).otherwise(F.array().cast("array<string>")).alias("ids"))
