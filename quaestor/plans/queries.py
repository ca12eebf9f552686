"""Registered queries over the tables at hand, each with the SQL whose rows it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, grades, money, references, text
from ..operators import catalogue, evidence, merge, projections, statistics
from ..streaming import alerts
from .registry import ORACLE_SQL, QUERIES, query
from .views import AUCTIONS, LOTS, PROVIDER_ROWS, SALE_OBS, TODAY, auctions, lots, provider_rows, sale_obs, table, today

def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_SUMMARY = """count(*) AS total, count(n) AS count, count(*) >= 100 AS capped,
  round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.25), 6) AS lower_quartile, round(quantile_cont(n, 0.75), 6) AS upper_quartile,
  round(min(n), 6) AS min, round(max(n), 6) AS max, min(CASE WHEN n IS NOT NULL THEN CAST(year(sale_date) AS INT) END) AS earliest, max(CASE WHEN n IS NOT NULL THEN CAST(year(sale_date) AS INT) END) AS latest,
  count(*) FILTER (NOT regexp_matches(price, '[0-9]')) AS unpriced, count(*) FILTER (amount IS NOT NULL AND sale_date > DATE '%s') AS future""" % TODAY
_COUNTED = f"(SELECT *, CASE WHEN amount IS NOT NULL AND NOT sale_date > DATE '{TODAY}' THEN amount END AS n FROM provider_rows)"
_FIVE = ("median", "lower_quartile", "upper_quartile", "min", "max")


@query(f"WITH {PROVIDER_ROWS} SELECT currency, {_SUMMARY} FROM {_COUNTED} GROUP BY currency")
def price_summary_by_currency(spark, sf_dir):
    return _rounded(statistics.summarise(provider_rows(spark, sf_dir), ["currency"], today()), *_FIVE)


@query(f"WITH {PROVIDER_ROWS} SELECT reference, currency, {_SUMMARY} FROM {_COUNTED} GROUP BY reference, currency")
def price_summary_by_reference(spark, sf_dir):
    return _rounded(statistics.summarise(provider_rows(spark, sf_dir), ["reference", "currency"], today()), *_FIVE)


@query(f"WITH {PROVIDER_ROWS} SELECT currency, CAST(year(sale_date) AS INT) AS year, round(quantile_cont(amount, 0.5), 6) AS median, count(*) AS count FROM provider_rows WHERE amount IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def price_medians_by_year(spark, sf_dir):
    return _rounded(statistics.medians(provider_rows(spark, sf_dir).withColumn("year", F.year("sale_date")), ["currency", "year"]), "median")


@query(f"WITH {PROVIDER_ROWS} SELECT currency, grade, round(quantile_cont(amount, 0.5), 6) AS median, count(*) AS count FROM provider_rows WHERE amount IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def price_medians_by_grade(spark, sf_dir):
    # Descriptions are written from the rows, and their grades read from the descriptions.
    rows = provider_rows(spark, sf_dir)
    text = F.concat(F.lit("Nero. As. RIC "), F.col("row_idx"), F.lit(", 10.83 g. "), F.replace(F.replace(F.col("grade"), F.lit("AU/Mint State"), F.lit("NGC Choice MS 5/5 - 4/5")), F.lit(" and below"), F.lit(", porous")), F.lit("."))
    return _rounded(statistics.medians(rows.withColumn("grade", grades.grade_of(text, limit=None)), ["currency", "grade"]), "median")


@query(f"""WITH {PROVIDER_ROWS}, sides AS (
  SELECT reference, round(quantile_cont(amount, 0.5) FILTER (sale_date >= DATE '{TODAY}' - INTERVAL 2 YEAR), 6) AS recent, count(*) FILTER (sale_date >= DATE '{TODAY}' - INTERVAL 2 YEAR) AS recent_count,
         round(quantile_cont(amount, 0.5) FILTER (sale_date < DATE '{TODAY}' - INTERVAL 2 YEAR), 6) AS earlier, count(*) FILTER (sale_date < DATE '{TODAY}' - INTERVAL 2 YEAR) AS earlier_count
  FROM provider_rows WHERE amount IS NOT NULL AND sale_date <= DATE '{TODAY}' GROUP BY reference)
SELECT *, CAST(floor(abs(recent - earlier) * 100 / earlier + 0.5) AS BIGINT) AS percent,
  CASE WHEN floor(abs(recent - earlier) * 100 / earlier + 0.5) <= 5 THEN 'same' WHEN recent > earlier THEN 'up' ELSE 'down' END AS move
FROM sides WHERE recent_count >= 3 AND earlier_count >= 3""")
def price_trend_2y(spark, sf_dir):
    return _rounded(statistics.trend(provider_rows(spark, sf_dir), ["reference"], today()), "recent", "earlier")


@query(f"WITH {PROVIDER_ROWS} SELECT currency, count(*) FILTER (amount < 40000) AS below, count(*) AS count, round(40000 / quantile_cont(amount, 0.5), 6) AS ratio FROM provider_rows WHERE amount IS NOT NULL GROUP BY currency")
def price_check_below(spark, sf_dir):
    return _rounded(statistics.price_check(provider_rows(spark, sf_dir), ["currency"], F.lit(40000.0)), "ratio")


@query(f"""WITH {PROVIDER_ROWS} SELECT reference, currency, CAST(sale_date AS VARCHAR) AS sale_date, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY reference, currency ORDER BY sale_date DESC, row_idx) AS k FROM provider_rows WHERE amount IS NOT NULL) WHERE k = 1""")
def last_sale_per_reference(spark, sf_dir):
    return statistics.last_sale(provider_rows(spark, sf_dir), ["reference", "currency"], ["amount"]).withColumn("sale_date", F.col("sale_date").cast("string")).select("reference", "currency", "sale_date", "amount")


@query(f"WITH {PROVIDER_ROWS} SELECT currency, count(*) AS n, round(sum(amount), 2) AS amount FROM provider_rows WHERE sale_date >= DATE '{TODAY}' - INTERVAL 5 YEAR GROUP BY currency")
def period_filter_5y(spark, sf_dir):
    return statistics.in_period(provider_rows(spark, sf_dir), today(), 5).groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(f"WITH {PROVIDER_ROWS} SELECT obs_id, CAST(sale_date AS VARCHAR) AS sale_date FROM provider_rows WHERE sale_date > DATE '{TODAY}' OR (sale_date = DATE '{TODAY}' AND NOT regexp_matches(price, '[0-9]'))")
def upcoming_sales(spark, sf_dir):
    return statistics.upcoming(provider_rows(spark, sf_dir), today()).select("obs_id", F.col("sale_date").cast("string").alias("sale_date"))


_EVIDENCE = f"""{SALE_OBS}, keyed AS (
  SELECT *, '["' || lower(auction_house) || '","' || lower(house_sale_id) || '","' || lot_number || '"]' AS sale_key FROM sale_obs),
evidence AS (
  SELECT sale_key, min_by(obs_id, (row_idx, obs_id)) AS first_id, count(*) AS n,
    list_filter([CASE WHEN count(DISTINCT auction_date) > 1 THEN 'auction_date' END, CASE WHEN count(DISTINCT currency || minor) > 1 THEN 'amount' END,
      CASE WHEN count(DISTINCT currency) > 1 THEN 'currency' END, CASE WHEN count(DISTINCT price_basis) > 1 THEN 'price_basis' END], lambda x: x IS NOT NULL) AS conflict_fields,
    bool_and(price_basis = 'hammer') AS hammer, bool_or(price_basis = 'estimate') AS estimate, min_by(currency, (row_idx, obs_id)) AS own_currency, min_by(minor, (row_idx, obs_id)) AS own_minor,
    min_by(reference, (row_idx, obs_id)) AS reference, min(auction_date) AS first_date, max(auction_date) AS last_date, bool_or(source = 'acsearch') AS acsearch
  FROM keyed GROUP BY sale_key),
judged AS (
  SELECT *, CASE WHEN len(conflict_fields) > 0 THEN 'conflict' WHEN hammer THEN NULL WHEN estimate THEN 'estimate' ELSE 'unsold' END AS exclusion_reason FROM evidence),
explained AS (
  SELECT *, CASE WHEN exclusion_reason IS NOT NULL THEN exclusion_reason WHEN NOT acsearch THEN 'source-filter' WHEN first_date < DATE '1996-01-01' OR last_date > DATE '2000-12-31' THEN 'date'
    WHEN own_currency <> 'EUR' THEN 'currency' END AS reason FROM judged)"""


def _explained(spark, sf_dir) -> DataFrame:
    return evidence.explained(evidence.deduplicate(sale_obs(spark, sf_dir)), "EUR", "1996-01-01", "2000-12-31", ["acsearch"])


@query(f"WITH {_EVIDENCE} SELECT sale_key, first_id, n, coalesce(exclusion_reason, 'included') AS outcome, CASE WHEN exclusion_reason IS NULL THEN own_minor END AS minor FROM judged")
def evidence_dedup(spark, sf_dir):
    rows = evidence.deduplicate(sale_obs(spark, sf_dir))
    return rows.select("sale_key", "first_id", F.col("n").cast("bigint").alias("n"), F.coalesce("exclusion_reason", F.lit("included")).alias("outcome"), "minor")


@query(f"WITH {_EVIDENCE} SELECT sale_key, array_to_string(conflict_fields, ',') AS fields FROM judged WHERE len(conflict_fields) > 0")
def evidence_conflicts(spark, sf_dir):
    return evidence.deduplicate(sale_obs(spark, sf_dir)).filter(F.size("conflict_fields") > 0).select("sale_key", F.array_join("conflict_fields", ",").alias("fields"))


@query(f"WITH {_EVIDENCE} SELECT coalesce(reason, 'counted') AS reason, count(*) AS n FROM explained GROUP BY 1")
def evidence_exclusions(spark, sf_dir):
    return _explained(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("counted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EVIDENCE}, lists AS (
  SELECT year(first_date) AS year, list_sort(list(own_minor)) AS l, count(*) AS n FROM explained WHERE reason IS NULL GROUP BY 1),
halves AS (SELECT *, n // 2 AS h, l[1:n // 2] AS lo, l[n // 2 + 1 + n % 2:] AS hi FROM lists)
SELECT CAST(year AS INT) AS year, n AS count,
  CASE WHEN n >= 3 THEN CASE WHEN n % 2 = 1 THEN l[h + 1] ELSE (l[h] + l[h + 1] + 1) // 2 END END AS median,
  CASE WHEN n >= 3 THEN CASE WHEN h % 2 = 1 THEN lo[h // 2 + 1] ELSE (lo[h // 2] + lo[h // 2 + 1] + 1) // 2 END END AS lower_quartile,
  CASE WHEN n >= 3 THEN CASE WHEN h % 2 = 1 THEN hi[h // 2 + 1] ELSE (hi[h // 2] + hi[h // 2 + 1] + 1) // 2 END END AS upper_quartile,
  CASE WHEN n < 3 THEN 'Insufficient evidence' WHEN n < 5 THEN 'Limited evidence' ELSE 'Evidence-backed' END AS label FROM halves""")
def evidence_statistics(spark, sf_dir):
    return evidence.statistics(_explained(spark, sf_dir).withColumn("year", F.year("first_date")), ["year"])


@query(f"WITH {LOTS} SELECT id, CAST((CAST(total_minor AS HUGEINT) * 2250 + 5000) // 10000 AS BIGINT) AS premium, CAST(total_minor + (CAST(total_minor AS HUGEINT) * 2250 + 5000) // 10000 AS BIGINT) AS hammer_plus_premium FROM lots")
def bid_premium(spark, sf_dir):
    return lots(spark, sf_dir).select("id", money.premium(F.col("total_minor"), F.lit(2250)).alias("p")).select("id", "p.*")


_COST = """base AS (SELECT id, h, p, v, f, h + p + v + f + 1500 AS base FROM (
  SELECT id, h, p, (p * 1900 + 5000) // 10000 AS v, (h * 300 + 5000) // 10000 AS f FROM (SELECT id, CAST(total_minor AS HUGEINT) AS h, (CAST(total_minor AS HUGEINT) * 2000 + 5000) // 10000 AS p FROM lots)))"""
_FEES = {"shipping_minor": 1500, "payment_fee_bps": 250, "payment_fee_minor": 35, "premium_vat_bps": 1900, "platform_fee_bps": 300, "import_vat_bps": 500}


@query(f"""WITH {LOTS}, {_COST} SELECT id, CAST(p AS BIGINT) AS premium, CAST(h + p AS BIGINT) AS hammer_plus_premium, CAST(v AS BIGINT) AS premium_vat, CAST(f AS BIGINT) AS platform_fee,
  CAST((base * 250 + 5000) // 10000 + 35 AS BIGINT) AS payment_fee, CAST(((h + p + 1500) * 500 + 5000) // 10000 AS BIGINT) AS import_vat,
  CAST(base + (base * 250 + 5000) // 10000 + 35 + ((h + p + 1500) * 500 + 5000) // 10000 AS BIGINT) AS total FROM base""")
def bid_cost(spark, sf_dir):
    fees = {k: F.lit(v) for k, v in _FEES.items()}
    return lots(spark, sf_dir).select("id", money.bid_cost(F.col("total_minor"), F.lit(2000), fees).alias("c")).select("id", "c.*")


_TIERS = [(0, 100), (10_000, 500), (50_000, 2_000), (200_000, 10_000), (10_000_000, 100_000)]
_LADDER = "tiers(t, s) AS (VALUES " + ", ".join(f"({a}, {b})" for a, b in _TIERS) + ")"


@query(f"""WITH {LOTS}, {_LADDER}, placed AS (SELECT id, total_minor AS m, max(t) AS t, max_by(s, t) AS s FROM lots JOIN tiers ON t <= total_minor GROUP BY 1, 2)
SELECT id, s AS step, CASE WHEN (m - t) % s = 0 THEN m ELSE least(m + s - (m - t) % s, coalesce((SELECT min(x.t) FROM tiers x WHERE x.t > m), m + s)) END AS next_bid, m - (m - t) % s AS previous_bid FROM placed""")
def next_bid_on_ladder(spark, sf_dir):
    tiers, m = money.ladder(_TIERS), F.col("total_minor")
    return lots(spark, sf_dir).select("id", money.tier_at(tiers, m)["step"].alias("step"), money.next_on_ladder(tiers, m).alias("next_bid"), money.previous_on_ladder(tiers, m).alias("previous_bid"))


@query(f"""WITH RECURSIVE budgets AS (SELECT c_custkey AS id, CAST(round(greatest(c_acctbal, 0) * 100) AS BIGINT) AS budget FROM customer), {_LADDER},
search AS (SELECT id, budget, CAST(100 AS BIGINT) AS low, budget + 1 AS high, 0 AS k FROM budgets
  UNION ALL SELECT id, budget, CASE WHEN low + 1 < high AND fits THEN middle ELSE low END, CASE WHEN low + 1 < high AND NOT fits THEN middle ELSE high END, k + 1 FROM (
    SELECT *, middle + (middle * 2000 + 5000) // 10000 + 1500 <= budget AS fits FROM (SELECT *, (low + high) // 2 AS middle FROM search WHERE k < 54))),
done AS (SELECT id, budget, low FROM search WHERE k = 54), placed AS (SELECT id, budget, low, max(t) AS t, max_by(s, t) AS s FROM done JOIN tiers ON t <= low GROUP BY 1, 2, 3)
SELECT id, CASE WHEN 100 + (100 * 2000 + 5000) // 10000 + 1500 <= budget THEN low - (low - t) % s END AS hammer FROM placed""")
def affordable_bid(spark, sf_dir):
    budget = F.round(F.greatest("c_acctbal", F.lit(0.0)) * 100).cast("bigint")
    rows = table(spark, sf_dir, "customer")
    return money.with_affordable_bid(rows, "hammer", budget, F.lit(2000), money.ladder(_TIERS), 0, {"shipping_minor": F.lit(1500)}).select(F.col("c_custkey").alias("id"), "hammer")


@query(f"""WITH {LOTS}, open AS (
  SELECT currency, coalesce(CAST(event_id AS VARCHAR), 'unassigned') AS event_id, CAST(bid_minor AS HUGEINT) AS h, premium_bps, sheet_currency = currency AS own, (CAST(bid_minor AS HUGEINT) * premium_bps + 5000) // 10000 AS p
  FROM lots WHERE outcome = 'open' AND bid_minor IS NOT NULL),
cost AS (SELECT *, CASE WHEN own AND p IS NOT NULL THEN h + p + 1500 + ((h + p + 1500) * 250 + 5000) // 10000 END AS total FROM open)
SELECT currency, event_id, CAST(grouping(event_id) AS TINYINT) AS all_events, count(*) AS binding_count, CAST(sum(h) AS BIGINT) AS hammer_minor, count(*) FILTER (premium_bps IS NULL) AS unknown_premium_count,
  CAST(coalesce(sum(h + p), 0) AS BIGINT) AS known_hammer_plus_bp_minor, count(total) AS total_count, CAST(coalesce(sum(total), 0) AS BIGINT) AS known_total_minor
FROM cost GROUP BY GROUPING SETS ((currency), (currency, event_id))""")
def exposure_by_currency_event(spark, sf_dir):
    return projections.exposure(lots(spark, sf_dir))


@query(f"""WITH {LOTS}, amounts AS (
  SELECT id AS entry_id, 'hammer' AS kind, currency, total_minor AS minor, created_at FROM lots WHERE outcome = 'won' UNION ALL
  SELECT id, 'invoice', sheet_currency, total_minor + 1500, created_at FROM lots WHERE outcome = 'won' AND id % 2 = 0 UNION ALL
  SELECT id, 'cost', currency, total_minor + 700, created_at FROM lots WHERE outcome = 'won' AND id % 5 = 0)
SELECT currency, count(DISTINCT entry_id) AS entry_count, count(*) FILTER (kind = 'hammer') AS hammer_count, count(*) FILTER (kind = 'cost') AS cost_count, count(*) FILTER (kind = 'invoice') AS invoice_count,
  CAST(sum(minor) FILTER (kind = 'hammer') AS BIGINT) AS hammer_minor, CAST(sum(minor) FILTER (kind = 'cost') AS BIGINT) AS cost_minor, CAST(sum(minor) FILTER (kind = 'invoice') AS BIGINT) AS invoice_minor,
  CAST(min(year(created_at)) AS INT) AS first_year, CAST(max(year(created_at)) AS INT) AS last_year FROM amounts GROUP BY currency""")
def collection_totals(spark, sf_dir):
    won = lots(spark, sf_dir).filter("outcome = 'won'")
    kinds = F.array(
        F.struct(F.lit("hammer").alias("kind"), F.col("currency").alias("currency"), F.col("total_minor").alias("minor")),
        F.when(F.col("id") % 2 == 0, F.struct(F.lit("invoice").alias("kind"), F.col("sheet_currency").alias("currency"), (F.col("total_minor") + 1500).alias("minor"))),
        F.when(F.col("id") % 5 == 0, F.struct(F.lit("cost").alias("kind"), F.col("currency").alias("currency"), (F.col("total_minor") + 700).alias("minor"))),
    )
    rows = won.select(F.col("id").alias("entry_id"), F.year("created_at").alias("year"), F.explode(F.array_compact(kinds)).alias("a"))
    return projections.collection_totals(rows.select("entry_id", "year", "a.*"))


@query(f"""WITH {LOTS}, {SALE_OBS.replace('sale_obs AS', 'sale_obs AS', 1)}, reduced AS (SELECT lower(reference) AS k, currency AS c, count(*) AS n, min(minor) AS lo, max(minor) AS hi FROM sale_obs WHERE price_basis = 'hammer' GROUP BY 1, 2)
SELECT id, reference, currency, coalesce(n, 0) AS comparable_count, lo AS low_minor, hi AS high_minor FROM lots LEFT JOIN reduced ON lower(reference) = k AND currency = c WHERE outcome = 'won'""")
def own_comparables(spark, sf_dir):
    entries = lots(spark, sf_dir).filter("outcome = 'won'").select("id", "reference", "currency")
    found = projections.comparables(entries, sale_obs(spark, sf_dir).filter("price_basis = 'hammer'").select("reference", "currency", "minor"))
    return found.select("id", "reference", "currency", "comparable_count", "low_minor", "high_minor")


def _timed(spark, sf_dir) -> DataFrame:
    now = F.lit(f"{TODAY} 12:00:00").cast("timestamp")
    timing = dates.event_timing(F.col("precision"), F.col("kind"), F.col("local_day"), F.col("starts_at"), F.lit("UTC"), now)
    events = auctions(spark, sf_dir).select("event", timing.alias("t")).select("event", "t.*")
    return lots(spark, sf_dir).join(events, F.col("event_id") == F.col("event"), "left")


_TIMED = f"{LOTS}, {AUCTIONS}, watched AS (SELECT * FROM lots LEFT JOIN timing ON event_id = event)"


@query(f"WITH {AUCTIONS} SELECT event, state, CAST(days AS INT) AS days_until, strftime(sort_at, '%Y-%m-%d %H:%M') AS sort_at FROM timing")
def event_timing(spark, sf_dir):
    now = F.lit(f"{TODAY} 12:00:00").cast("timestamp")
    t = dates.event_timing(F.col("precision"), F.col("kind"), F.col("local_day"), F.col("starts_at"), F.lit("UTC"), now)
    return auctions(spark, sf_dir).select("event", t.alias("t")).select("event", "t.state", F.col("t.days_until").cast("int").alias("days_until"), F.date_format("t.sort_at", "yyyy-MM-dd HH:mm").alias("sort_at"))


def _queue_sql(test: str) -> str:
    return f"WITH {_TIMED} SELECT id, event_id, coalesce(state, 'unknown') AS state FROM watched WHERE {test}"


def _queue(name: str, spark, sf_dir) -> DataFrame:
    return projections.queue(_timed(spark, sf_dir), name).select("id", "event_id", F.coalesce("state", F.lit("unknown")).alias("state"))


for _name, _test in {
    "closing-soon": "outcome = 'open' AND state = 'soon'", "needs-outcome": "outcome = 'open' AND state = 'ended'", "planned": "outcome = 'open' AND planned_minor IS NOT NULL AND bid_minor IS NULL",
    "active": "outcome = 'open' AND bid_minor IS NOT NULL", "completed": "outcome <> 'open'", "needs-research": "outcome = 'open' AND trim(reference) = ''",
}.items():
    QUERIES[f"queue_{_name.replace('-', '_')}"] = lambda spark, sf_dir, name=_name: _queue(name, spark, sf_dir)
    ORACLE_SQL[f"queue_{_name.replace('-', '_')}"] = _queue_sql(_test)


@query(f"""WITH {_TIMED}, tiers AS (SELECT *, CASE WHEN state = 'ended' THEN 1 WHEN state IN ('soon', 'upcoming', 'started') THEN 2 WHEN event_id IS NULL THEN 3 END AS tier FROM watched WHERE outcome = 'open')
SELECT id, tier FROM tiers WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 2 THEN sort_at END NULLS FIRST, CASE WHEN tier = 3 THEN created_at END DESC NULLS LAST, idx LIMIT 5""")
def coins_to_watch_top5(spark, sf_dir):
    return projections.coins_to_watch(_timed(spark, sf_dir)).select("id", "tier")


@query(f"""WITH {LOTS}, g AS (SELECT id, group_id, priority, row_number() OVER (PARTITION BY group_id ORDER BY priority, id) AS k, min(priority) OVER w AS lo, max(priority) OVER w AS hi, count(*) OVER w AS n, count(DISTINCT priority) OVER w AS d FROM lots WINDOW w AS (PARTITION BY group_id))
SELECT id, group_id, CAST(CASE WHEN lo = 1 AND hi = n AND d = n THEN priority ELSE k END AS INT) AS new_priority FROM g""")
def compact_priorities(spark, sf_dir):
    return projections.compact_priorities(lots(spark, sf_dir).select("id", "group_id", "priority")).select("id", "group_id", "new_priority")


@query("""WITH keyed AS (SELECT p_partkey AS id, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number FROM part) SELECT * FROM keyed""")
def set_label_numbering(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return statistics.numbered(parts, ["name"], ["id"])


@query("""WITH w AS (SELECT p_partkey AS id, p_type AS c, p_brand AS v, p_size % 10 AS base, CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 3 = 1 THEN 'b' ELSE '' END AS bracket FROM part)
SELECT a.id AS want_id, b.id AS lot_id FROM w a JOIN w b ON a.c = b.c AND a.v = b.v AND a.base = b.base AND (a.bracket = '' OR b.bracket = '' OR a.bracket = b.bracket) WHERE a.id % 10 = 0 AND b.id % 10 <> 0""")
def want_matches(spark, sf_dir):
    bracket = F.when(F.col("p_partkey") % 3 == 0, "a").when(F.col("p_partkey") % 3 == 1, "b")
    read = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("catalogue"), F.col("p_brand").alias("volume"), F.lit(None).cast("string").alias("section"), (F.col("p_size") % 10).cast("string").alias("base"), bracket.alias("bracket"))
    return projections.want_matches(read.filter("id % 10 = 0"), read.filter("id % 10 <> 0"))


_IDENTITIES = """lots AS (SELECT o_orderkey AS id, o_orderkey AS idx, 'p' || (o_orderkey % 4000) AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 3900) ELSE '' END AS canon,
  CASE WHEN o_orderkey % 4 = 0 THEN 'i' || (o_custkey % 700) END AS ident FROM orders WHERE o_orderkey % 5 <> 0),
incoming AS (SELECT o_orderkey AS id, 'p' || (o_orderkey % 3800) AS page, '' AS canon, CASE WHEN o_orderkey % 2 = 0 THEN 'i' || (o_custkey % 700) END AS ident FROM orders WHERE o_orderkey % 5 = 0)"""


@query(f"""WITH {_IDENTITIES} SELECT candidate_id, id FROM (SELECT i.id AS candidate_id, l.id, row_number() OVER (PARTITION BY i.id ORDER BY l.idx) AS k FROM incoming i JOIN lots l
  ON (l.page = i.page OR l.canon = i.page OR l.ident = i.ident) AND coalesce(l.ident = i.ident, true)) WHERE k = 1""")
def lot_duplicates(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    page = lambda n: F.concat(F.lit("p"), key % n)
    orders = table(spark, sf_dir, "orders")
    ours = orders.filter(key % 5 != 0).select(key.alias("id"), key.alias("idx"), page(4000).alias("page_url"), F.when(key % 3 == 0, page(3900)).otherwise("").alias("canonical_url"), F.when(key % 4 == 0, F.concat(F.lit("i"), cust % 700)).alias("identity"))
    theirs = orders.filter(key % 5 == 0).select(key.alias("id"), key.alias("idx"), page(3800).alias("page_url"), F.lit("").alias("canonical_url"), F.when(key % 2 == 0, F.concat(F.lit("i"), cust % 700)).alias("identity"))
    return projections.duplicate_lots(ours, theirs)


def _sides(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), (key % 4 + 1).cast("int").alias("revision"), F.col("o_orderdate").alias("updated_at"), F.concat(F.lit("k"), key % 6000).alias("identity"), F.col("o_orderpriority").alias("title"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("minor"))
    ours = rows.filter(key % 3 != 0)
    later = F.col("updated_at") + F.make_dt_interval(days=(F.col("id") % 5 - 2).cast("int"))
    theirs = rows.filter(key % 4 != 1).select("id", (F.col("revision") + 1).alias("revision"), later.alias("updated_at"), "identity", F.when(F.col("id") % 2 == 0, F.lit("changed")).otherwise(F.col("title")).alias("title"), "minor")
    return merge.decide(ours, theirs, merge.ceiling(F.lit("2001-01-01").cast("timestamp"), F.lit("2000-06-01").cast("timestamp")), ["title", "minor"])


_MERGE = """rows AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 + 1 AS INT) AS revision, o_orderdate AS updated_at, 'k' || (o_orderkey % 6000) AS identity, o_orderpriority AS title, CAST(round(o_totalprice * 100) AS BIGINT) AS minor FROM orders),
l AS (SELECT * FROM rows WHERE id % 3 <> 0), r AS (SELECT id, revision + 1 AS revision, updated_at + to_days(CAST(id % 5 - 2 AS INT)) AS updated_at, identity, CASE WHEN id % 2 = 0 THEN 'changed' ELSE title END AS title, minor FROM rows WHERE id % 4 <> 1),
decided AS (SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'local only' WHEN l.id IS NOT NULL AND l.title = r.title AND l.minor = r.minor THEN 'kept local'
   WHEN l.id IS NOT NULL AND least(r.updated_at, TIMESTAMP '2000-06-01') <= l.updated_at THEN 'kept local' WHEN l.id IS NOT NULL THEN 'updated' WHEN r.identity IN (SELECT identity FROM l) THEN 'skipped' ELSE 'added' END AS decision,
   l.revision AS lr, r.revision AS rr, l.title AS lt, r.title AS rt FROM l FULL OUTER JOIN r ON l.id = r.id)"""


@query(f"WITH {_MERGE} SELECT id, decision, CASE decision WHEN 'updated' THEN greatest(lr, rr) + 1 WHEN 'added' THEN rr ELSE lr END AS revision, CASE WHEN decision IN ('updated', 'added') THEN rt ELSE lt END AS title FROM decided")
def merge_lww_rows(spark, sf_dir):
    return _sides(spark, sf_dir).select("id", "decision", "revision", "title")


@query(f"WITH {_MERGE} SELECT decision, count(*) AS n FROM decided GROUP BY decision")
def merge_preview_counts(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, o_custkey % 1700 AS points_to FROM orders WHERE o_custkey % 1700 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1700).alias("points_to"))
    return merge.dangling(rows, "points_to", table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0"), "c_custkey")


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status FROM orders)
SELECT id, seq, reason FROM (SELECT *, CASE WHEN NOT price < 400000 THEN 'invalid-amount' WHEN status = 'P' THEN 'invalid-status' WHEN row_number() OVER (PARTITION BY id ORDER BY seq) > 1 THEN 'duplicate-id' END AS reason FROM r)""")
def quarantine_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), "o_totalprice", "o_orderstatus")
    return merge.quarantine(rows, {"invalid-amount": ~(F.col("o_totalprice") < 400_000), "invalid-status": F.col("o_orderstatus") == "P"}, "id", ["seq"]).select("id", "seq", "reason")


@query("""SELECT user_id AS id, count(*) AS accepted, max_by(event_type, event_id) AS value FROM events GROUP BY user_id""")
def command_fold(spark, sf_dir):
    """Each event as a put whose expected revision is right; each request sent twice."""
    rows = table(spark, sf_dir, "events")
    expected = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    puts = rows.select(F.col("user_id").alias("id"), F.col("event_id").alias("request_id"), (F.col("event_id") * 2).alias("seq"), F.lit("put").alias("kind"), expected.alias("expected"), F.col("event_type").alias("value"))
    state = merge.apply_commands(puts.union(puts.withColumn("seq", F.col("seq") + 1)))
    return state.select("id", F.col("revision").cast("bigint").alias("accepted"), "value")


_LINKS = "links AS (SELECT p_partkey AS old, CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 9 ELSE p_partkey + 1 END AS new FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 50 = 40)"


@query(f"""WITH RECURSIVE {_LINKS}, kept AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 50 <> 40),
walk AS (SELECT old, new AS goal, 1 AS k FROM links UNION ALL SELECT w.old, l.new, k + 1 FROM walk w JOIN links l ON w.goal = l.old WHERE k < 64), ends AS (SELECT old, max_by(goal, k) AS goal, max(k) AS k FROM walk GROUP BY old)
SELECT old, CASE WHEN k < 64 AND goal IN (SELECT id FROM kept) THEN goal END AS target, CASE WHEN k = 64 THEN 'cycle' WHEN goal IN (SELECT id FROM kept) THEN 'ok' ELSE 'dangling' END AS status FROM ends""")
def alias_closure(spark, sf_dir):
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    links = part.filter((key % 5 != 0) | (key % 50 == 40)).select(key.alias("old"), F.when(key % 50 == 49, key - 9).otherwise(key + 1).alias("new"))
    return catalogue.resolve_redirects(links, part.filter((key % 10 == 0) & (key % 50 != 40)).select(key.alias("id")))


@query("""WITH links AS (SELECT DISTINCT o_custkey AS old, o_orderkey % 800 AS target FROM orders), b AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 20 <> 0)
SELECT old, array_to_string(list_sort(list(target)), ',') AS targets FROM links LEFT JOIN b ON target = id GROUP BY old HAVING bool_and(id IS NOT NULL)""")
def concordance_all_bundled(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("old"), (F.col("o_orderkey") % 800).alias("target"))
    found = catalogue.concordance(links, table(spark, sf_dir, "part").filter("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("id")))
    return found.select("old", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query("""WITH r AS (SELECT p_brand AS id, p_partkey AS i, p_type AS material, CAST(p_size % 3 AS INT) AS mint, CASE WHEN p_brand = 'Brand#2' THEN 7 ELSE CAST(p_size AS INT) END AS start_year FROM part),
f AS (SELECT id, material, min(i) AS i FROM r GROUP BY 1, 2) SELECT id, (SELECT string_agg(material, ',' ORDER BY i) FROM f WHERE f.id = r.id) AS material, CASE WHEN count(DISTINCT start_year) = 1 THEN min(start_year) END AS start_year, count(DISTINCT start_year) > 1 AS conflict FROM r GROUP BY id""")
def repeated_subject_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("row_idx"), F.col("p_type").alias("material"), F.when(F.col("p_brand") == "Brand#2", F.lit(7)).otherwise(F.col("p_size")).cast("int").alias("start_year"))
    return catalogue.fold_subjects(rows, "id", ["material"], ["start_year"]).withColumn("material", F.array_join("material", ","))


@query("SELECT p_size AS number, array_to_string(list_sort(list(CAST(p_partkey AS VARCHAR))), ',') AS ids FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part) GROUP BY 1")
def number_index_lookup(spark, sf_dir):
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", F.lit("RIC I"), F.concat(F.col("p_size"), F.lit("a"))).alias("title"))
    return catalogue.number_index(types).withColumn("ids", F.array_join("ids", ","))


@query("""WITH r AS (SELECT p_type AS g, p_partkey AS id, length(p_name) + 40 AS b FROM part), s AS (SELECT *, sum(b) OVER (PARTITION BY g ORDER BY id) - b AS before, sum(b) OVER (PARTITION BY g) AS total FROM r),
tried AS (SELECT g, id, b, k, least(CAST(before * k // total AS INT), k - 1) AS part FROM s, range(1, 27) c(k)),
sizes AS (SELECT g, k, max(size) AS size FROM (SELECT g, k, part, sum(b) AS size FROM tried GROUP BY ALL) GROUP BY ALL),
chosen AS (SELECT g, min(k) AS k FROM sizes WHERE size - 1 <= (SELECT max(total) // 5 FROM s) GROUP BY g)
SELECT t.g AS "group", CAST(part AS INT) AS part, count(*) AS n, min(id) AS first_id FROM tried t JOIN chosen USING (g, k) GROUP BY 1, 2""")
def shard_boundaries(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("group"), F.col("p_partkey").alias("id"), (F.length("p_name") + 40).alias("bytes"))
    limit = rows.groupBy("group").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] // 5
    return catalogue.shard_parts(rows, limit).groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


_PARAMS = "(utm_[^=&#]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid)"


@query(r"""WITH split AS (SELECT page_id, split_part(url, '#', 1) AS bare, regexp_extract(url, '(#[/!].*)$', 1) AS mark FROM pages),
parts AS (SELECT page_id, split_part(bare, '?', 1) AS path, regexp_extract(bare, '\?(.*)$', 1) AS query, mark FROM split),
kept AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid)(=|$)')) AS k FROM parts)
SELECT page_id, path || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || mark AS url FROM kept""")
def strip_tracking_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tracking(F.col("url")).alias("url"))


@query("""SELECT c_custkey AS id, '"' || CASE WHEN c_mktsegment LIKE '=%' THEN chr(39) ELSE '' END || replace(c_name, '"', '""') || '","' || c_mktsegment || '"' AS line FROM customer""")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(",", text.csv_cell(F.col("c_name")), text.csv_cell(F.col("c_mktsegment"))).alias("line"))


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0 EXCEPT SELECT p_partkey FROM part WHERE p_size < 20""")
def except_published(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return part.filter("id % 3 = 0").select("id").distinct().join(part.filter("p_size < 20").select("id"), "id", "left_anti")


@query("""SELECT id, min(side) AS side FROM (SELECT p_partkey AS id, 1 AS side FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_partkey % 2 = 0) GROUP BY id""")
def union_readings(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    both = part.filter("p_size < 20").select("id", F.lit(1).alias("side")).unionByName(part.filter("id % 2 = 0").select("id", F.lit(2).alias("side")))
    return both.groupBy("id").agg(F.min("side").alias("side"))


_TRIGGERS = """triggers AS (SELECT event_id AS trigger_id, date_trunc('second', ts) AS trigger_at, date_trunc('second', ts) + INTERVAL 15 MINUTE AS relevant_until,
  CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'delivered' WHEN 'signup' THEN 'snoozed' END AS status, date_trunc('second', ts) + INTERVAL 1 MINUTE AS claimed_at, date_trunc('second', ts) + INTERVAL 10 MINUTE AS snoozed_until, TIMESTAMP '2024-01-15 12:00:00' AS now FROM events)"""


@query(f"""WITH {_TRIGGERS} SELECT trigger_id, CASE WHEN status = 'delivered' THEN status WHEN now > relevant_until THEN 'missed' WHEN status = 'snoozed' AND now < snoozed_until THEN 'snoozed'
  WHEN status = 'claimed' AND NOT now >= claimed_at + INTERVAL 5 MINUTE THEN 'claimed' WHEN now >= trigger_at THEN 'due' ELSE 'pending' END AS status FROM triggers""")
def alert_reconcile(spark, sf_dir):
    at = F.date_trunc("second", "ts")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("trigger_id"), at.alias("trigger_at"), (at + F.expr("interval 15 minutes")).alias("relevant_until"), "event_type")
    status = F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "signup", "snoozed")
    stored = rows.filter("event_type <> 'error'").select("trigger_id", status.alias("status"), (F.col("trigger_at") + F.expr("interval 1 minute")).alias("claimed_at"), (F.col("trigger_at") + F.expr("interval 10 minutes")).alias("snoozed_until"))
    return alerts.reconcile(rows.select("trigger_id", "trigger_at", "relevant_until"), stored, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("trigger_id", "status")


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def event_tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "value")


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM runs GROUP BY user_id, k""")
def event_session_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "n")


def _values(name: str, columns: str, rows: list[tuple], make: Callable[[DataFrame], DataFrame], expected: str) -> None:
    """A query over inline inputs whose oracle states the results expected."""
    QUERIES[name] = lambda spark, sf_dir: make(spark.createDataFrame(rows, columns))
    ORACLE_SQL[name] = expected


_PRICES = [("1,200", None, 1200.0), ("1'200", None, 1200.0), ("1 200", None, 1200.0), ("1200 USD", None, 1200.0), ("$ 1,200.50", None, 1200.5), ("1.200,50", None, 1200.5), ("12.5", None, 12.5), ("950", None, 950.0), ("*", None, None), ("0", None, None), ("abc", None, None), ("200 EUR", "EUR", 200.0), ("200 EUR", "USD", None), ("1,200", "USD", 1200.0), ("Fr. 450", "CHF", 450.0), ("450 CHF", "CHF", 450.0), ("€1.250", "EUR", 1250.0), ("£ 700", "GBP", 700.0), ("€200 €150", "EUR", None), ("1200EUR", "USD", None)]
_sql = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
_table = lambda rows, names: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"
_values("parse_price_golden", "price string, currency string, n int", [(p, c, i) for i, (p, c, _) in enumerate(_PRICES)], lambda df: df.select("n", text.parse_price(F.col("price"), F.col("currency")).alias("amount")), "SELECT CAST(n AS INT) AS n, CAST(amount AS DOUBLE) AS amount FROM (" + _table([(i, v) for i, (_, _, v) in enumerate(_PRICES)], "n, amount") + ")")
_DATES = [("08.07.2026", "2026-07-08"), ("28.07.2026 14:00", "2026-07-28"), ("2024-05-01", "2024-05-01"), (" 29.02.2028 ", "2028-02-29"), ("31.02.2026", None), ("8.7.2026", None), ("2024-13-01", None), ("", None)]
_values("sale_date_golden", "t string, n int", [(t, i) for i, (t, _) in enumerate(_DATES)], lambda df: df.select("n", text.sale_date(F.col("t")).cast("string").alias("day")), "SELECT CAST(n AS INT) AS n, day FROM (" + _table([(i, d) for i, (_, d) in enumerate(_DATES)], "n, day") + ")")
_ZONES = [("2026-03-29 01:30:00", "Europe/London", "nonexistent", None), ("2026-10-25 01:30:00", "Europe/London", "ambiguous", None), ("2026-10-25 02:30:00", "Europe/Zurich", "ambiguous", None), ("2026-07-01 10:00:00", "Asia/Kathmandu", "ok", "2026-07-01 04:15:00"), ("2026-01-10 19:00:00", "America/New_York", "ok", "2026-01-11 00:00:00")]
_values("zoned_resolution_golden", "t string, zone string, n int", [(t, z, i) for i, (t, z, _, _) in enumerate(_ZONES)], lambda df: df.select("n", dates.resolve(F.col("t").cast("timestamp"), F.col("zone")).alias("r")).select("n", "r.status", F.date_format("r.instant", "yyyy-MM-dd HH:mm:ss").alias("instant")), "SELECT CAST(n AS INT) AS n, status, instant FROM (" + _table([(i, s, u) for i, (_, _, s, u) in enumerate(_ZONES)], "n, status, instant") + ")")
_FNV = [("", 2166136261), ("a", 3826002220), ("abc", 440920331), ("foobar", 3214735720)]
_values("fnv32_ids", "t string", [(t,) for t, _ in _FNV], lambda df: df.select("t", text.fnv32(F.col("t")).alias("hash")), _table(_FNV, "t, hash"))
_NINE = [9000, 11000, 13500, 16500, 18000, 21500, 24500, 31000, 45000]
_values("half_medians_golden", "minors array<bigint>, n int", [(_NINE, 9), ([100, 101, 200, 201], 4), ([5, 7], 2)], lambda df: df.select("n", *(v.alias(k) for k, v in statistics.half_medians(F.col("minors")).items())), _table([(9, 18000, 12250, 27750), (4, 151, 101, 201), (2, None, None, None)], "n, median, lower_quartile, upper_quartile"))


_REFERENCES = [("“Crawford 44/5”", "RRC", "", "", "44/5"), ("„RIC I² Nero 306“", "RIC", "I (2nd edition)", "Nero", "306"), ("RIC 972", "RIC", "", "", "972"), ("SC 2195.5c­", "SC", "", "", "2195.5c"), ("Bop Hermaeus 20", "Bop", "", "Hermaeus", "20"), ("﻿Price 23", "Price", "", "", "23"), ("HGC​ 4, 1218­", "Other", "", "", "HGC 4, 1218"), ("SC 2195.5c; SNG Spaer 1712", "SC", "", "", "2195.5c"), ("HGC 9, 1; RIC I² Nero 306", "RIC", "I (2nd edition)", "Nero", "306"), ("(Crawford 44/5)", "RRC", "", "", "44/5"), ("(Price 23)", "Price", "", "", "23"), ("(RIC I² Nero 306)", "RIC", "I (2nd edition)", "Nero", "306"), ("SG 6829 var.", "Other", "", "", "SG 6829 var."), ("sc1630.2b", "SC", "", "", "1630.2b"), ("Seleucid Coins (part 1) 1266.2", "SC", "", "", "1266.2"), ("Sear 6829", "Other", "", "", "Sear 6829")]
_values("reference_golden", "t string, n int", [(r[0], i) for i, r in enumerate(_REFERENCES)], lambda df: df.select("n", references.parse_reference(F.col("t")).alias("r")).select("n", "r.*"), "SELECT CAST(n AS INT) AS n, catalogue, volume, section, number FROM (" + _table([(i, *r[1:]) for i, r in enumerate(_REFERENCES)], "n, catalogue, volume, section, number") + ")")
_WORDS = [("Nero. AR denarius, Rome.", True), ("Group of three denarii.", True), ("Nero. Sestertius, Rome.", False), ("A denariusish thing.", False)]
_values("denomination_golden", "t string, n int", [(t, i) for i, (t, _) in enumerate(_WORDS)], lambda df: df.select("n", references.names_denomination(F.col("t"), "denarius").alias("named")), "SELECT CAST(n AS INT) AS n, named FROM (" + _table([(i, v) for i, (_, v) in enumerate(_WORDS)], "n, named") + ")")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def alert_stream_dedupe(spark, sf_dir):
    """The events as a stream of commands, each sent twice, counted once."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    sent = stream.select(F.explode(F.array(F.col("event_id"), F.col("event_id"))).alias("request_id"), ts.alias("ts"), "event_type")
    return alerts.landed(alerts.once(sent, "60 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first_id"))


from . import input_queries, lookup_queries, workspace_queries  # noqa: E402, F401  register their queries behind these
