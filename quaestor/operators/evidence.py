"""Sale evidence: observations of one sale are merged, conflicts named, exclusions explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash, with_identity_keys
from .statistics import counted_half_medians

KEY = ("auction_house", "house_sale_id", "lot_number")
TEXTS = ("house_sale_id", "auction_house", "auction_name", "auction_date", "lot_number")


def with_sale_key(df: DataFrame, house: str, sale: str, lot: str, key: str = "sale_key") -> DataFrame:
    """Add the JSON array of the three normalized parts; null if any is missing (a weak identity)."""
    made = with_identity_keys(df, {f"_part_{i}": c for i, c in enumerate((house, sale, lot))})
    return made.withColumn(key, _joined([F.col(f"_part_{i}") for i in range(3)])).drop("_part_0", "_part_1", "_part_2")


def _joined(parts: list[Column]) -> Column:
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.to_json(F.array(*parts)))


def deduplicate(observations: DataFrame, listed: bool = False) -> DataFrame:
    """A row of evidence for each sale, its first observation the one of least row_idx.

    Observations without a full identity stay alone. Aggregation is by the sale's key, with
    partial sums before the shuffle; only if they are asked for are the observations listed.
    """
    # Every text is normalized once and then used by name.
    texts = observations.withColumn("_d_auction_date", F.col("auction_date").cast("string"))
    keyed = with_identity_keys(texts, {f"_n_{c}": "_d_auction_date" if c == "auction_date" else c for c in TEXTS}).withColumn("sale_key", _joined([F.col(f"_n_{c}") for c in KEY]))
    keyed = keyed.withColumn("group_key", F.coalesce(F.concat(F.lit("live:"), F.col("sale_key")), F.concat(F.lit("weak:"), F.col("obs_id"))))
    # A field is in conflict if its normalized values differ: the least and the greatest do.
    # Those of the key are the same in all rows of a sale, so only weak identities need comparing by them.
    norm = {c: F.nullif(F.col(f"_n_{c}"), F.lit("")) for c in TEXTS}
    norm |= {c: F.when(F.col("sale_key").isNull(), norm[c]) for c in KEY}
    missing = F.col("minor").isNull()
    norm["amount"] = F.when(missing, "missing").otherwise(F.concat_ws(":", "currency", F.col("minor").cast("string")))
    norm["currency"] = F.when(missing, "missing").otherwise(F.col("currency"))
    norm["price_basis"] = F.col("price_basis")
    differ = [F.when(F.min(v) != F.max(v), F.lit(c)) for c, v in norm.items()]
    order, by_hand = F.struct("row_idx", "obs_id"), F.coalesce("collector_excluded", F.lit(False))
    firsts = F.min(F.struct(order.alias("order"), "currency", "minor", "auction_house", "reference"))
    has = lambda basis: F.bool_or(F.coalesce(F.col("price_basis") == basis, F.lit(False)))
    item = F.struct("row_idx", "obs_id", "source", "price_basis", "currency", "minor", "collector_excluded", "collector_reason", *TEXTS)
    rows = keyed.groupBy("group_key").agg(
        firsts.alias("first"), F.count(F.lit(1)).alias("n"), F.array_compact(F.array(*differ)).alias("conflicts"),
        F.min_by(F.when(by_hand, F.struct(F.coalesce("collector_reason", F.lit("collector-excluded")).alias("reason"))), F.when(by_hand, order)).alias("by_hand"),
        F.bool_and(F.coalesce(F.col("price_basis") == "hammer", F.lit(False))).alias("hammer"), *(has(b).alias(f"has_{b}") for b in ("estimate", "unsold", "missing")),
        F.collect_set("source").alias("sources"), F.min("auction_date").alias("first_date"), F.max("auction_date").alias("last_date"),
        *([F.array_sort(F.collect_list(item)).alias("observations")] if listed else []),
    )
    basis = F.when(F.col("has_estimate"), "estimate").when(F.col("has_unsold"), "unsold").when(F.col("has_missing"), "missing-price").otherwise("not-comparable")
    reason = F.when(F.col("by_hand").isNotNull(), F.col("by_hand.reason")).when(F.size("conflicts") > 0, "conflict").when(F.col("hammer"), F.lit(None)).otherwise(basis)
    judged = rows.withColumn("exclusion_reason", reason)
    counted = F.col("exclusion_reason").isNull()
    return judged.select(
        "group_key", F.when(F.col("group_key").startswith("live:"), F.substr("group_key", F.lit(6))).alias("sale_key"), F.col("first.order.obs_id").alias("first_id"), "n",
        F.when(F.col("by_hand").isNull(), F.col("conflicts")).otherwise(F.array().cast("array<string>")).alias("conflict_fields"),
        F.when(counted, "included").otherwise("excluded").alias("inclusion"), "exclusion_reason", F.when(counted, F.col("first.currency")).alias("currency"),
        F.when(counted, F.col("first.minor")).alias("minor"), squash(F.col("first.auction_house").cast("string")).alias("house"), F.col("first.reference").alias("reference"),
        "sources", "first_date", "last_date", *(["observations"] if listed else []),
    )


def explained(evidence: DataFrame, currency: str, from_date: str, to_date: str, sources: list[str]) -> DataFrame:
    """Each row with the first reason that keeps it out of statistics, null if none does, in the
    fixed order: its own exclusion, source, date, currency."""
    no_source = ~F.arrays_overlap("sources", F.array(*map(F.lit, sources)))
    out_of_window = F.coalesce((F.col("first_date") < F.lit(from_date).cast("date")) | (F.col("last_date") > F.lit(to_date).cast("date")), F.lit(False))
    reason = (
        F.when(F.col("inclusion") == "excluded", F.col("exclusion_reason"))
        .when(no_source, "source-filter").when(out_of_window, "date")
        .when(F.col("minor").isNull(), "missing-price").when(F.col("currency") != currency, "currency")
    )
    return evidence.withColumn("reason", reason)


def statistics(judged: DataFrame, by: list[str]) -> DataFrame:
    """Count, medians of halves and how far to trust them, over what is not excluded."""
    rows = counted_half_medians(judged.filter("reason is null"), by, "minor")
    n = F.col("count")
    label = F.when(n < 3, "Insufficient evidence").when(n < 5, "Limited evidence").otherwise("Evidence-backed")
    return rows.withColumn("label", label)
