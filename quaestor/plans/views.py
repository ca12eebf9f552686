"""Sales, lots and auctions read from order tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2001-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def today() -> Column:
    return F.lit(TODAY).cast("date")


def currency_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("USD", "EUR", "GBP", "CHF"))), (key % 4 + 1).cast("int"))


def _minor(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def sale_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sale observation for each line of an order; returned lines are unsold, new ones estimates."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    basis = F.when(F.col("l_returnflag") == "A", "hammer").when(F.col("l_returnflag") == "N", "estimate").otherwise("unsold")
    # Lines meet their part as they are read; what is made of them is not moved.
    read = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
    met = read.join(part.select("p_partkey", F.col("p_brand").alias("reference")), F.col("l_partkey") == F.col("p_partkey"))
    return met.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("row_idx"),
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", _minor(F.col("l_extendedprice"))).alias("obs_id"),
        F.concat(F.lit("H"), F.col("l_suppkey")).alias("auction_house"), F.concat(F.lit("S"), F.col("l_orderkey")).alias("house_sale_id"),
        F.col("l_linenumber").cast("string").alias("lot_number"), F.lit(None).cast("string").alias("auction_name"), F.to_date("l_shipdate").alias("auction_date"),
        basis.alias("price_basis"), currency_of(F.col("l_suppkey")).alias("currency"), _minor(F.col("l_extendedprice")).alias("minor"),
        F.element_at(F.array(*map(F.lit, ("Fine and below", "VF", "EF", "AU/Mint State"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("grade"),
        F.when(F.col("l_linestatus") == "O", "acsearch").otherwise("coinarchives").alias("source"),
        F.lit(False).alias("collector_excluded"), F.lit(None).cast("string").alias("collector_reason"), "reference",
    )


def provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale observations as a provider's rows: amount in units, price as text, '*' where unsold."""
    unsold = F.col("price_basis") == "unsold"
    return sale_obs(spark, sf_dir).select(
        "row_idx", "obs_id", "reference", "currency", "grade", F.col("auction_date").alias("sale_date"),
        F.when(~unsold, F.col("minor") / 100).alias("amount"), F.when(unsold, "*").otherwise(F.col("minor").cast("string")).alias("price"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a watched lot."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    minor = _minor(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), key.alias("idx"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "won").otherwise("lost").alias("outcome"),
        F.when(cust % 7 != 0, cust % 200).alias("event_id"), currency_of(cust).alias("currency"),
        F.when(key % 3 == 0, minor).alias("bid_minor"), F.when(key % 3 == 1, minor).alias("planned_minor"),
        F.when(cust % 5 != 0, (cust % 25 * 100).cast("int")).alias("premium_bps"), currency_of(cust + cust % 3).alias("sheet_currency"), F.lit(1500).alias("shipping_minor"), F.lit(250).alias("payment_fee_bps"),
        F.concat(F.lit("Brand#"), key % 30).alias("reference"), F.to_date("o_orderdate").alias("created_at"),
        (cust % 50).alias("group_id"), (key % 9 + 1).cast("int").alias("priority"), minor.alias("total_minor"),
    )


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 auctions around TODAY."""
    rows = spark.range(200)
    day = F.date_add(today(), (F.col("id") * 13 % 61 - 30).cast("int"))
    return rows.select(F.col("id").alias("event"), F.when(F.col("id") % 2 == 0, "timed").otherwise("date-only").alias("precision"), F.when(F.col("id") % 4 == 0, "auction-starts").otherwise("lot-closes").alias("kind"), day.alias("local_day"), (day.cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 24).cast("int"))).alias("starts_at"))


SALE_OBS = """sale_obs AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS row_idx,
         concat_ws('.', l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS obs_id,
         'H' || l_suppkey AS auction_house, 'S' || l_orderkey AS house_sale_id, CAST(l_linenumber AS VARCHAR) AS lot_number, CAST(l_shipdate AS DATE) AS auction_date,
         CASE l_returnflag WHEN 'A' THEN 'hammer' WHEN 'N' THEN 'estimate' ELSE 'unsold' END AS price_basis,
         ['USD', 'EUR', 'GBP', 'CHF'][l_suppkey % 4 + 1] AS currency, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor,
         ['Fine and below', 'VF', 'EF', 'AU/Mint State'][l_linenumber % 4 + 1] AS grade,
         CASE l_linestatus WHEN 'O' THEN 'acsearch' ELSE 'coinarchives' END AS source, p_brand AS reference
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PROVIDER_ROWS = f"""{SALE_OBS}, provider_rows AS (
  SELECT row_idx, obs_id, reference, currency, grade, auction_date AS sale_date,
         CASE WHEN price_basis <> 'unsold' THEN minor / 100.0::DOUBLE END AS amount, CASE WHEN price_basis = 'unsold' THEN '*' ELSE CAST(minor AS VARCHAR) END AS price
  FROM sale_obs)"""

LOTS = """lots AS (
  SELECT o_orderkey AS id, o_orderkey AS idx, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'won' ELSE 'lost' END AS outcome,
         CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 200 END AS event_id, ['USD', 'EUR', 'GBP', 'CHF'][o_custkey % 4 + 1] AS currency,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS bid_minor,
         CASE WHEN o_orderkey % 3 = 1 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS planned_minor,
         CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 25 * 100 END AS premium_bps, ['USD', 'EUR', 'GBP', 'CHF'][(o_custkey + o_custkey % 3) % 4 + 1] AS sheet_currency,
         1500 AS shipping_minor, 250 AS payment_fee_bps, 'Brand#' || (o_orderkey % 30) AS reference, CAST(o_orderdate AS DATE) AS created_at,
         o_custkey % 50 AS group_id, CAST(o_orderkey % 9 + 1 AS INT) AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS total_minor
  FROM orders)"""

AUCTIONS = f"""auctions AS (
  SELECT e AS event, CASE WHEN e % 2 = 0 THEN 'timed' ELSE 'date-only' END AS precision, CASE WHEN e % 4 = 0 THEN 'auction-starts' ELSE 'lot-closes' END AS kind,
         DATE '{TODAY}' + CAST(e * 13 % 61 - 30 AS INT) AS local_day, CAST(DATE '{TODAY}' + CAST(e * 13 % 61 - 30 AS INT) AS TIMESTAMP) + to_hours(CAST(e % 24 AS INT)) AS starts_at
  FROM range(200) r(e)),
timed AS (
  SELECT *, date_diff('day', DATE '{TODAY}', local_day) AS days, epoch(starts_at) - epoch(TIMESTAMP '{TODAY} 12:00:00') AS ahead FROM auctions),
timing AS (
  SELECT event, days, CASE WHEN precision = 'timed' THEN CASE WHEN ahead > 172800 THEN 'upcoming' WHEN ahead >= 0 THEN 'soon' WHEN kind = 'auction-starts' AND days >= 0 THEN 'started' ELSE 'ended' END
         ELSE CASE WHEN days < 0 THEN 'ended' WHEN days <= 1 THEN 'soon' ELSE 'upcoming' END END AS state,
         CASE WHEN precision = 'timed' THEN starts_at ELSE CAST(local_day AS TIMESTAMP) END AS sort_at FROM timed)"""
