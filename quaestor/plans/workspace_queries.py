"""Registered queries of costs, bids and the workspace, each with the SQL whose rows it must return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators import bids, evidence, projections, workspace
from .registry import query
from .views import AUCTIONS, LOTS, SALE_OBS, TODAY, auctions, lots, sale_obs, table

_WON_FEES = {"shipping_minor": 1500, "payment_fee_bps": 250, "payment_fee_minor": 35, "premium_vat_bps": 1900, "platform_fee_bps": 300, "import_vat_bps": 500}


def _won(spark, sf_dir) -> DataFrame:
    won = lots(spark, sf_dir).filter("outcome = 'won'").withColumns({"hammer": F.when(F.col("id") % 13 != 0, F.col("total_minor")), "sheet": F.when(F.col("id") % 7 != 0, F.col("sheet_currency"))})
    cost = money.won_cost(F.col("hammer"), F.col("currency"), F.col("premium_bps"), F.col("sheet"), F.col("id") % 11 == 0, {k: F.lit(v) for k, v in _WON_FEES.items()})
    return won.select("id", "hammer", cost.alias("cost"))


_WON = f"""{LOTS}, w AS (SELECT id, currency, CASE WHEN id % 13 <> 0 THEN CAST(total_minor AS HUGEINT) END AS h, premium_bps AS b, id % 11 = 0 AS none, CASE WHEN id % 11 = 0 THEN currency WHEN id % 7 <> 0 THEN sheet_currency END AS sheet FROM lots WHERE outcome = 'won'),
g AS (SELECT *, list_filter([CASE WHEN h IS NULL THEN 'hammer' END, CASE WHEN b IS NULL THEN 'premium-rate' END, CASE WHEN sheet IS NULL THEN 'fees' END, CASE WHEN h IS NOT NULL AND sheet <> currency THEN 'fee-currency' END], lambda x: x IS NOT NULL) AS missing, (h * b + 5000) // 10000 AS p FROM w),
f AS (SELECT *, CASE WHEN none THEN 0 ELSE (p * 1900 + 5000) // 10000 END AS v, CASE WHEN none THEN 0 ELSE (h * 300 + 5000) // 10000 END AS plat, CASE WHEN none THEN 0 ELSE 1500 END AS ship FROM g),
c AS (SELECT *, h + p + v + plat + ship AS base, CASE WHEN none THEN 0 ELSE ((h + p + ship) * 500 + 5000) // 10000 END AS imp FROM f),
won AS (SELECT *, base + CASE WHEN none THEN 0 ELSE (base * 250 + 5000) // 10000 + 35 END AS total, len(missing) = 0 AS whole FROM c)"""


@query(f"""WITH {_WON} SELECT id, array_to_string(missing, ',') AS missing, CAST(p AS BIGINT) AS premium, CAST(CASE WHEN whole THEN total + imp - h - p END AS BIGINT) AS fees,
  CAST(CASE WHEN whole THEN total END AS BIGINT) AS total, CAST(CASE WHEN whole THEN imp END AS BIGINT) AS import_vat FROM won""")
def won_cost(spark, sf_dir):
    return _won(spark, sf_dir).select("id", "cost.*").withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {_WON} SELECT id, CAST(CASE WHEN whole THEN total + imp WHEN missing = ['fees'] THEN h + p END AS BIGINT) AS total, missing = ['fees'] AS partial FROM won""")
def won_cost_shown(spark, sf_dir):
    return _won(spark, sf_dir).select("id", money.shown_total(F.col("cost"), F.col("hammer")).alias("s")).select("id", "s.*")


_ACTIONS = "['planned-revised', 'placed', 'settled-won', 'reopened-active', 'externally-cancelled', 'settled-lost']"


def _histories(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    action = F.element_at(F.array(*map(F.lit, ("planned-revised", "placed", "settled-won", "reopened-active", "externally-cancelled", "settled-lost"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", action.alias("action"), F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 25 * 100).cast("int")).alias("bps"))
    return line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("history"))


@query(f"""WITH h AS (SELECT l_orderkey AS id, {_ACTIONS}[l_partkey % 6 + 1] AS action, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 25 * 100 AS INT) END AS bps, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
last AS (SELECT id, max(k) FILTER (bps IS NOT NULL AND (action LIKE 'settled%' OR action LIKE 'reopened%')) AS settled, max(k) FILTER (action = 'planned-revised') AS revised FROM h GROUP BY id)
SELECT last.id, CASE WHEN last.id % 3 <> 0 AND coalesce(revised, 0) > coalesce(settled, 0) THEN CAST(last.id % 20 * 100 AS INT) WHEN settled IS NOT NULL THEN h.bps WHEN last.id % 3 <> 0 THEN CAST(last.id % 20 * 100 AS INT) END AS bps
FROM last LEFT JOIN h ON h.id = last.id AND h.k = settled""")
def bid_premium_rates(spark, sf_dir):
    planned = F.when(F.col("id") % 3 != 0, (F.col("id") % 20 * 100).cast("int"))
    return _histories(spark, sf_dir).select("id", money.bid_premium_rate(F.col("history"), planned).alias("bps"))


@query(f"""WITH h AS (SELECT l_orderkey AS id, {_ACTIONS}[l_partkey % 6 + 1] AS action, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT id, max_by(action, k) FILTER (action IN ('placed', 'externally-cancelled')) AS action FROM h GROUP BY id""")
def binding_bids(spark, sf_dir):
    return _histories(spark, sf_dir).select("id", workspace.last_action(F.col("history"), ["placed", "externally-cancelled"])["action"].alias("action"))


@query(f"WITH {LOTS} SELECT id, CASE outcome WHEN 'won' THEN 'Won' WHEN 'lost' THEN 'Lost' ELSE CASE WHEN bid_minor IS NOT NULL THEN 'Bid active' WHEN planned_minor IS NOT NULL THEN 'Bid planned' ELSE 'Watching' END END AS label FROM lots")
def lot_status_labels(spark, sf_dir):
    return lots(spark, sf_dir).select("id", workspace.status_label(F.col("outcome"), F.col("bid_minor"), F.col("planned_minor")).alias("label"))


@query(f"WITH {LOTS} SELECT id, outcome FROM lots WHERE outcome = 'won' AND year(created_at) = 1996 AND contains(lower(reference), '#2')")
def settled_lots(spark, sf_dir):
    return workspace.settled(lots(spark, sf_dir).withColumn("settled_at", F.col("created_at")), " #2 ", ["reference"], 1996, ["won"]).select("id", "outcome")


def _timed_auctions(spark, sf_dir) -> DataFrame:
    now = F.lit(f"{TODAY} 12:00:00").cast("timestamp")
    timing = dates.event_timing(F.col("precision"), F.col("kind"), F.col("local_day"), F.col("starts_at"), F.lit("UTC"), now)
    return auctions(spark, sf_dir).select("event", timing.alias("t")).select("event", "t.*")


@query(f"WITH {AUCTIONS} SELECT event, CAST(row_number() OVER (ORDER BY sort_at, event) AS INT) AS place, 'upcoming' AS side FROM timing WHERE state <> 'ended' UNION ALL SELECT event, CAST(row_number() OVER (ORDER BY sort_at DESC, event) AS INT), 'past' FROM timing WHERE state = 'ended'")
def auctions_split(spark, sf_dir):
    ahead, past = workspace.split_auctions(_timed_auctions(spark, sf_dir))
    placed = lambda df, side, *order: df.withColumn("side", F.lit(side)).select("event", F.row_number().over(Window.partitionBy("side").orderBy(*order)).alias("place"), "side")
    return placed(ahead, "upcoming", "sort_at", "event").unionByName(placed(past, "past", F.desc("sort_at"), "event"))


@query(f"WITH {LOTS} SELECT (9000 - id) // 2 AS position, id, reference FROM lots WHERE id % 2 = 0 AND id BETWEEN 2 AND 9000")
def comparison_rows(spark, sf_dir):
    selected = spark.range(4500).select(F.col("id").alias("position"), (9000 - F.col("id") * 2).alias("id"))
    return workspace.compared(lots(spark, sf_dir), selected).select("position", "id", "reference")


def _readings(spark, sf_dir) -> DataFrame:
    bracket = F.when(F.col("p_partkey") % 3 == 0, "a").when(F.col("p_partkey") % 3 == 1, "b")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("idx"), F.col("p_type").alias("catalogue"), F.col("p_brand").alias("volume"), F.lit(None).cast("string").alias("section"), F.col("p_size").cast("string").alias("base"), bracket.alias("bracket"), F.when(F.col("p_partkey") % 40 == 0, F.col("p_partkey")).alias("found_lot_id"))


_READ = """r AS (SELECT p_partkey AS id, p_type AS c, p_brand AS v, p_size AS base, CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 3 = 1 THEN 'b' ELSE '' END AS bracket, p_partkey % 40 = 0 AS found FROM part),
m AS (SELECT a.id AS want_id, b.id AS lot_id FROM r a JOIN r b ON a.c = b.c AND a.v = b.v AND a.base = b.base AND (a.bracket = '' OR b.bracket = '' OR a.bracket = b.bracket) WHERE a.id % 10 = 0 AND b.id % 10 <> 0)"""


@query(f"WITH {_READ} SELECT id, found, (SELECT count(*) FROM m WHERE want_id = id) AS lot_count FROM r WHERE id % 10 = 0")
def want_list_rows(spark, sf_dir):
    read = _readings(spark, sf_dir)
    wants = read.filter("id % 10 = 0")
    rows = workspace.want_rows(wants, projections.want_matches(wants, read.filter("id % 10 <> 0")))
    return rows.select("id", F.col("found_lot_id").isNotNull().alias("found"), "lot_count")


@query(f"WITH {_READ} SELECT id FROM r WHERE id % 10 = 0 AND NOT found AND id IN (SELECT want_id FROM m)")
def open_wants(spark, sf_dir):
    read = _readings(spark, sf_dir)
    wants = read.filter("id % 10 = 0")
    return workspace.open_wants(wants, projections.want_matches(wants, read.filter("id % 10 <> 0"))).select("id")


@query(f"WITH {_READ} SELECT id FROM r x WHERE id % 10 = 1 AND NOT EXISTS (SELECT 1 FROM r y WHERE y.id % 10 <> 1 AND y.c = x.c AND y.v = x.v AND y.base = x.base)")
def wants_without_twin(spark, sf_dir):
    read = _readings(spark, sf_dir)
    return workspace.unwanted(read.filter("id % 10 = 1"), read.filter("id % 10 <> 1"), ["catalogue", "volume", "section", "base"]).select("id")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND epoch_ms(ts) // 1000 > (SELECT max(epoch_ms(ts) // 1000) FROM events) - 86400)
SELECT event_id AS id, user_id % 10 AS owner FROM d WHERE k <= 20""")
def live_drafts(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return workspace.live_drafts(rows.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("owner"), F.col("ts").cast("timestamp").alias("saved_at")), F.lit(now).cast("timestamp")).select("id", "owner")


@query("SELECT event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 6")
def recent_terms(spark, sf_dir):
    return workspace.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 6).select(F.col("event_id").alias("id"))


@query("""WITH m AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month, lag(strftime(o_orderdate, '%Y-%m')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT id, CASE WHEN before IS NULL OR before <> month THEN month END AS heading FROM m""")
def month_headings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("at"))
    return workspace.month_headings(rows, ["o_custkey"], "at").select("id", "heading")


@query(f"""WITH {LOTS}, c(currency) AS (SELECT unnest({list(money.CURRENCIES)}))
SELECT c.currency, count(bid_minor) AS binding_count, CAST(coalesce(sum(bid_minor), 0) AS BIGINT) AS hammer_minor FROM c LEFT JOIN lots ON lots.currency = c.currency AND outcome = 'open' AND bid_minor IS NOT NULL GROUP BY 1""")
def exposure_dense(spark, sf_dir):
    return workspace.dense_exposure(projections.exposure(lots(spark, sf_dir)))


@query("""SELECT 'house ' || chr(CAST(97 + p_size % 26 AS INT)) AS house, max_by(p_type, (p_partkey % 97, p_partkey)) AS zone FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1""")
def zone_of_house(spark, sf_dir):
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("p_size") % 26 + 1).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("House "), letter, F.lit(", "), F.col("p_partkey")).alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("zone"), (F.col("p_partkey") % 97).alias("updated_at"))
    return workspace.remembered_zone(rows)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 200 < 40 THEN CAST(c_custkey % 200 * 50 AS INT) END AS preset_bps FROM customer")
def house_presets(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("House  "), F.col("c_custkey") % 200).alias("house"))
    presets = spark.range(40).select(F.concat(F.lit(" HOUSE "), F.col("id")).alias("house"), (F.col("id") * 50).cast("int").alias("premium_bps"))
    return workspace.preset_for(rows, presets).select("id", "preset_bps")


@query("SELECT count(*) AS rows, CAST(sum(strlen(CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR))) AS BIGINT) AS bytes FROM nation")
def stored_bytes(spark, sf_dir):
    return workspace.stored_bytes(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query(f"""WITH {SALE_OBS}, e AS (SELECT reference, currency, minor, price_basis, count(*) OVER (PARTITION BY auction_house, house_sale_id, lot_number) AS n FROM sale_obs)
SELECT reference, currency, count(*) AS n, min(minor) AS low, max(minor) AS high FROM e WHERE n = 1 AND price_basis = 'hammer' GROUP BY 1, 2""")
def lot_comparables(spark, sf_dir):
    """Of sales that were observed once."""
    found = evidence.deduplicate(sale_obs(spark, sf_dir)).filter("n = 1")
    return workspace.lot_comparables(found, ["reference"])


@query("""WITH q AS (SELECT c_custkey AS query_id, 'name ' || (c_custkey % 30) AS asked FROM customer), e AS (SELECT p_partkey % 1500 AS query_id, 'p' || p_partkey AS id, 'name ' || (p_size % 40) AS title FROM part),
j AS (SELECT q.query_id, count(id) AS n, min(id) FILTER (title = asked) AS exact, list_sort(list(id) FILTER (id IS NOT NULL)) AS ids FROM q LEFT JOIN e USING (query_id) GROUP BY 1)
SELECT query_id, CASE WHEN exact IS NOT NULL THEN 'ok' WHEN n BETWEEN 1 AND 5 THEN 'candidates' ELSE 'none' END AS status, CASE WHEN exact IS NOT NULL THEN exact WHEN n BETWEEN 1 AND 5 THEN array_to_string(ids, ',') ELSE '' END AS ids FROM j""")
def title_matches(spark, sf_dir):
    queries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Name  "), F.col("c_custkey") % 30).alias("title"))
    entries = table(spark, sf_dir, "part").select((F.col("p_partkey") % 1500).alias("query_id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.concat(F.lit("name "), F.col("p_size") % 40).alias("title"))
    return workspace.matched(entries, queries).withColumn("ids", F.array_join("ids", ","))


@query("SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77')")
def lots_containing(spark, sf_dir):
    return workspace.containing(table(spark, sf_dir, "customer"), "77", ["c_name", "c_mktsegment"]).select(F.col("c_custkey").alias("id"))


def _bid_commands(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    part = F.col("l_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("bid.plan", "bid.place", "bid.place", "bid.cancel", "bid.plan", "bid.place", "lot.outcome.set", "lot.delete"))), (part % 8 + 1).cast("int"))
    rows = line.withColumn("k", k).select(
        F.col("l_orderkey").alias("lot_id"), F.concat_ws(".", "l_orderkey", "k").alias("request_id"), F.col("k").alias("seq"), kind.alias("kind"), F.when(part % 7 == 0, F.col("k")).otherwise(F.col("k") - 1).alias("expected"),
        F.when(part % 5 != 0, F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("amount"), F.when(part % 2 == 0, "won").otherwise("lost").alias("outcome"),
    )
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(key.alias("id"), F.lit(0).alias("revision"), F.lit(None).cast("bigint").alias("planned"), F.lit(None).cast("bigint").alias("active"), F.lit("open").alias("outcome"), (key % 4 == 0).alias("linked"))
    return own, rows


_BIDS = """cmd AS (SELECT l_orderkey AS id, l_partkey AS p, ['bid.plan', 'bid.place', 'bid.place', 'bid.cancel', 'bid.plan', 'bid.place', 'lot.outcome.set', 'lot.delete'][l_partkey % 8 + 1] AS kind, CASE WHEN l_partkey % 5 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
s AS (SELECT o_orderkey AS id, 0 AS k, true AS live, CAST(0 AS BIGINT) AS revision, CAST(NULL AS BIGINT) AS planned, CAST(NULL AS BIGINT) AS active, 'open' AS outcome, '' AS refusals FROM orders
  UNION ALL
  SELECT id, k, live AND NOT (ok AND kind = 'lot.delete'), revision + CASE WHEN ok THEN 1 ELSE 0 END,
    CASE WHEN ok AND kind = 'bid.plan' THEN amount WHEN ok AND kind IN ('bid.place', 'lot.outcome.set') THEN NULL ELSE planned END,
    CASE WHEN ok AND kind = 'bid.place' THEN amount WHEN ok AND kind IN ('bid.cancel', 'lot.outcome.set') THEN NULL ELSE active END,
    CASE WHEN ok AND kind = 'lot.outcome.set' THEN CASE WHEN p % 2 = 0 THEN 'won' ELSE 'lost' END ELSE outcome END, CASE WHEN ok THEN refusals ELSE refusals || k || ':' || why || ' ' END
  FROM (SELECT *, why IS NULL AS ok FROM (SELECT s.id, cmd.k, cmd.kind, cmd.amount, cmd.p, live, revision, planned, active, outcome, refusals,
    CASE WHEN NOT live THEN 'not-found' WHEN revision <> CASE WHEN cmd.p % 7 = 0 THEN cmd.k ELSE cmd.k - 1 END THEN 'conflict' WHEN kind LIKE 'bid%' AND outcome <> 'open' THEN 'not-open'
      WHEN kind = 'bid.plan' AND cmd.amount IS NULL AND planned IS NULL THEN 'no-plan' WHEN kind = 'bid.cancel' AND active IS NULL THEN 'no-bid'
      WHEN kind = 'lot.delete' AND s.id % 4 = 0 THEN 'collection-link' WHEN kind = 'lot.delete' AND active IS NOT NULL THEN 'active-bid' END AS why
    FROM s JOIN cmd ON cmd.id = s.id AND cmd.k = s.k + 1)))"""


@query(f"WITH RECURSIVE {_BIDS} SELECT id, max_by(live, k) AS live, max_by(revision, k) AS revision, arg_max_null(planned, k) AS planned, arg_max_null(active, k) AS active, max_by(outcome, k) AS outcome, trim(max_by(refusals, k)) AS refusals FROM s GROUP BY id")
def bid_commands(spark, sf_dir):
    """The lines of an order as commands on it, each sent twice."""
    own, rows = _bid_commands(spark, sf_dir)
    twice = F.explode(F.array(F.col("seq") * 2, F.col("seq") * 2 + 1))
    state = bids.apply(own, rows.withColumn("seq", twice))
    text = F.array_join(F.transform("refusals", lambda x: F.concat_ws(":", F.floor(x["seq"] / 2), x["reason"])), " ")
    return state.select("id", "live", "revision", "planned", "active", "outcome", text.alias("refusals"))
