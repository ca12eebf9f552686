"""Registered queries of typed amounts, reminders and result pages, each with the SQL whose rows it must return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts, grades
from ..operators import provider, reminders
from ..streaming import alerts
from .registry import query
from .views import AUCTIONS, auctions, table


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS m, o_orderkey % 6 AS k FROM orders)
SELECT id, CASE WHEN k = 4 THEN 'ambiguous' WHEN k = 5 THEN 'invalid' ELSE 'ok' END AS status,
  CASE k WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN (m // 100 % 900 + 100) * 100000 + 12300 WHEN 3 THEN m // 100 * 100 END AS minor FROM o""")
def money_inputs(spark, sf_dir):
    minor, key = F.round(F.col("o_totalprice") * 100).cast("bigint"), F.col("o_orderkey") % 6
    units, cents = F.floor(minor / 100).cast("string"), F.lpad((minor % 100).cast("string"), 2, "0")
    some = (F.floor(minor / 100) % 900 + 100).cast("string")
    text = (
        F.when(key == 0, F.concat(units, F.lit("."), cents)).when(key == 1, F.concat(F.lit(" "), units, F.lit(","), cents)).when(key == 2, F.concat(some, F.lit(",123")))
        .when(key == 3, F.concat(units, F.lit(".0"))).when(key == 4, F.concat(some, F.lit(".123"))).otherwise(F.concat(units, F.lit(" EUR")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), amounts.parse_fixed(text, ",", 2).alias("a")).select("id", "a.*")


@query(f"""WITH {AUCTIONS}, e AS (SELECT *, CASE WHEN event % 3 = 0 THEN 9 ELSE 0 END * 3600 AS z, (CASE WHEN event % 5 < 2 THEN -7 ELSE 5.5 END * 3600)::BIGINT AS c FROM auctions),
d AS (SELECT event, z, c, k, epoch(CAST(local_day - CAST(k AS INT) AS TIMESTAMP))::BIGINT AS day FROM e, range(2) r(k) WHERE precision = 'date-only'),
w AS (SELECT *, day - z AS s, CASE WHEN k = 0 THEN day - z + 32400 ELSE day - z + 86340 END AS l FROM d),
r AS (SELECT event, k, s, l, max(CASE WHEN day + x * 86400 + 32400 - c BETWEEN s AND l THEN day + x * 86400 + 32400 - c END) AS own,
  max(CASE WHEN least(day + x * 86400 + 75600 - c, l) >= greatest(day + x * 86400 + 28800 - c, s) THEN least(day + x * 86400 + 75600 - c, l) END) AS awake FROM w, range(-2, 3) q(x) GROUP BY ALL)
SELECT event, 'day' || k AS reminder, coalesce(own, awake, CASE WHEN k = 0 THEN l ELSE s END)::BIGINT AS at FROM r
UNION ALL SELECT event, 'hour', epoch(starts_at)::BIGINT - 3600 FROM e WHERE precision = 'timed'""")
def reminder_triggers(spark, sf_dir):
    events = auctions(spark, sf_dir).withColumn("zone", F.when(F.col("event") % 3 == 0, "Asia/Tokyo").otherwise("UTC"))
    one = lambda name, kind, before: F.struct(F.lit(name).alias("reminder"), F.lit(kind).alias("kind"), F.lit(60).alias("offset_minutes"), F.lit(before).alias("days_before"), F.lit("09:00").alias("local_time"))
    own = F.when(F.col("event") % 5 < 2, "America/Phoenix").otherwise("Asia/Kolkata").alias("owner_zone")
    asked = events.select("event", own, F.explode(F.array(one("hour", "offset", 0), one("day0", "wall-time", 0), one("day1", "wall-time", 1))).alias("r")).select("event", "owner_zone", "r.*")
    return reminders.triggers(events, asked).select("event", "reminder", F.unix_seconds("trigger_at").alias("at"))


_PRICES = "['Upcoming Auction', 'To Be Posted', '*', 'about 5 USD', '1,234 EUR', '950 USD', '12,500 USD']"


@query(f"""WITH r AS (SELECT l_orderkey AS page, l_linenumber AS id, {_PRICES}[l_partkey % 7 + 1] AS price, CAST(l_shipdate AS DATE) AS day, l_partkey % 7 AS k, l_partkey FROM lineitem),
g AS (SELECT page, id, count(*) AS n, count(DISTINCT (price, day, l_partkey)) > 1 AS differ, min(k) AS k, min(day) AS day FROM r GROUP BY 1, 2),
p AS (SELECT page, sum(n) AS rendered, count(*) FILTER (NOT differ AND k > 3 AND day <= DATE '1997-01-01') AS lots, count(*) FILTER (NOT differ AND k > 4 AND day <= DATE '1997-01-01') AS usd,
  count(*) FILTER (NOT differ AND k = 0) AS upcoming, count(*) FILTER (NOT differ AND k > 3 AND day > DATE '1997-01-01') AS future, coalesce(sum(n) FILTER (differ), 0) AS conflicting FROM g GROUP BY 1)
SELECT page, CAST(rendered AS INT) AS rendered, CASE WHEN page % 10 = 9 THEN 'layout' WHEN usd > 0 THEN 'ok' WHEN lots > 0 THEN 'no-currency' ELSE 'unpriced' END AS status,
  CAST(CASE WHEN page % 10 = 9 THEN 0 ELSE lots END AS INT) AS lots, CAST(CASE WHEN page % 10 = 9 THEN 0 ELSE usd END AS INT) AS usd, CAST(CASE WHEN page % 10 = 9 THEN 0 ELSE upcoming END AS INT) AS upcoming,
  CAST(CASE WHEN page % 10 = 9 THEN 0 ELSE future END AS INT) AS future, CAST(CASE WHEN page % 10 = 9 THEN 0 ELSE conflicting END AS INT) AS conflicting FROM p""")
def provider_pages(spark, sf_dir):
    price = F.element_at(F.array(*map(F.lit, ("Upcoming Auction", "To Be Posted", "*", "about 5 USD", "1,234 EUR", "950 USD", "12,500 USD"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    row = F.format_string(
        '<tr id="%s"><td><a class="R" href="lotviewer.php?LotID=%s&amp;AucID=1&amp;Lot=%s&amp;Val=x"><div class="auctiontitle">A &amp;amp; B %s</div></a><nobr>%s</nobr></td><td class="price">%s</td></tr>',
        F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_partkey"), F.date_format("l_shipdate", "d MMM yyyy"), price,
    )
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.concat_ws("", F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("n"))
    head = F.format_string("<span class='headertext'>Your search for <b>'\"nero\" as</b>' matched %s lots from auctions added in the last six months.</span>", F.col("n") + F.when(F.col("page") % 10 == 9, 1).otherwise(0))
    made = pages.select("page", F.concat(head, F.lit("<table>"), "rows").alias("html"), F.lit("nero as").alias("term"), F.lit("a").alias("section"), F.lit("USD").alias("currency"))
    read = provider.read_pages(made, "https://results.example", F.lit("1997-01-01").cast("date"))
    many = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return read.select(
        "page", "rendered", "status", F.size("lots").alias("lots"), many(F.col("currencies"), "USD").alias("usd"), many(F.col("excluded"), "upcoming").alias("upcoming"),
        many(F.col("excluded"), "futureDate").alias("future"), many(F.col("excluded"), "conflictingId").alias("conflicting"),
    )


#: Descriptions, one for each kind of word, edge and join, and the bucket they state.
_GRADED = (
    ("Very Fine, dark patina.", "VF"), ("A fine portrait of good style.", None), ("ss-vz.", "VF"), ("Toned, otherwise nearly extremely fine.", "EF"), ("Obverse VF, reverse Fine.", "Fine and below"),
    ("Erhaltung: Stgl. Notes: vz for the type", "AU/Mint State"), ("From the BB collection. EF", "EF"), ("Aureus. AU, 7.25 g.", None), ("NGC Choice AU 5/5 - 4/5.", "AU/Mint State"),
    ("Rev. Spes advancing left. S/C.", None), ("Patina verde. qSPL.", "EF"), ("Ex Slg. MS 63.", None), ("TB à TTB.", "Fine and below"), ("Selten, s. Kommentar. vz", "EF"), ("s/ss", "Fine and below"), ("fdc", None),
    ("Fine, high-relief portrait. VF/EF (scratch).", "VF"), ("where described as \"Good VF\"", None), ("Very fine £80-£100", "VF"),
)


@query(f"""SELECT l_orderkey AS sale, l_linenumber AS lot, [{", ".join("NULL" if g is None else f"'{g}'" for _, g in _GRADED)}][l_partkey % {len(_GRADED)} + 1] AS grade, count(*) AS n FROM lineitem GROUP BY ALL""")
def lot_grades(spark, sf_dir):
    said = F.get(F.array(*(F.lit(t) for t, _ in _GRADED)), (F.col("l_partkey") % len(_GRADED)).cast("int"))
    text = F.concat_ws(" ", F.lit("Trajan. Denarius. RIC"), F.concat("l_suppkey", F.lit(".")), F.concat(F.format_number(F.col("l_quantity"), 2), F.lit(" g.")), said)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), grades.grade_of(text, limit=None).alias("grade"))
    return rows.groupBy("sale", "lot", "grade").agg(F.count(F.lit(1)).alias("n"))


_NAMED = "event_id || ':' || r || ':' || strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"


@query(f"""WITH e AS (SELECT event_id, event_id % 3 AS r, date_trunc('second', ts) AS tm, event_type AS kind FROM events),
a AS (SELECT event_id, r, CASE WHEN event_id % 7 = 0 THEN tm - INTERVAL 1 HOUR ELSE tm END AS tm, CASE kind WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'delivered' ELSE 'snoozed' END AS status, tm AS t FROM e WHERE kind <> 'error'
  UNION ALL SELECT event_id, r, tm, 'acknowledged', tm FROM e WHERE event_id % 5 = 0 AND event_id % 7 <> 0 UNION ALL SELECT event_id, r, tm, 'due', tm FROM e WHERE event_id % 35 = 0),
h AS (SELECT {_NAMED.format("tm")} AS id, max_by(status, list_position({list(alerts.RANK)}, status)) AS status, any_value(t) AS t FROM a GROUP BY 1),
w AS (SELECT {_NAMED.format("tm")} AS id, {_NAMED.format("tm - INTERVAL 1 HOUR")} AS former, tm, event_id FROM e WHERE event_id % 11 <> 0),
g AS (SELECT w.id, w.former, h.status, h.t FROM w JOIN h ON h.id = w.former WHERE event_id % 7 = 0 AND h.status NOT IN ('pending', 'due') AND NOT EXISTS (SELECT 1 FROM h x WHERE x.id = w.id)),
s AS (SELECT id, status, t, 'kept' AS how FROM h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.former = h.id) UNION ALL SELECT id, status, t, 'moved' FROM g),
j AS (SELECT coalesce(w.id, s.id) AS id, w.tm, coalesce(s.status, 'pending') AS status, s.t, CASE WHEN w.id IS NULL THEN 'vanished' ELSE coalesce(s.how, 'new') END AS change, TIMESTAMP '2024-01-15 12:00:00' AS now FROM w FULL JOIN s ON s.id = w.id),
k AS (SELECT *, CASE WHEN change = 'vanished' THEN NULL WHEN status IN ('delivered', 'acknowledged', 'missed') THEN status WHEN now > tm + INTERVAL 15 MINUTE THEN 'missed' WHEN status = 'snoozed' AND now < t + INTERVAL 10 MINUTE THEN 'snoozed'
  WHEN status = 'claimed' AND now < t + INTERVAL 6 MINUTE THEN 'claimed' WHEN now >= tm THEN 'due' ELSE 'pending' END AS is_now FROM j)
SELECT id AS trigger_id, change, is_now AS status, epoch(CASE is_now WHEN 'pending' THEN least(tm, tm + INTERVAL 901 SECOND) WHEN 'snoozed' THEN least(t + INTERVAL 10 MINUTE, tm + INTERVAL 901 SECOND) WHEN 'claimed' THEN least(t + INTERVAL 6 MINUTE, tm + INTERVAL 901 SECOND) WHEN 'due' THEN tm + INTERVAL 901 SECOND END)::BIGINT AS wake FROM k""")
def alert_adoption(spark, sf_dir):
    minutes = lambda c, n: F.timestamp_seconds(F.unix_seconds(c) + 60 * n)
    e, at = F.col("event_id"), F.col("trigger_at")
    rows = table(spark, sf_dir, "events").select("event_id", (e % 3).cast("string").alias("reminder_id"), F.date_trunc("second", "ts").alias("trigger_at"), F.col("event_type").alias("kind"))
    status = F.when(F.col("kind") == "click", "claimed").when(F.col("kind") == "view", "pending").when(F.col("kind") == "purchase", "delivered").otherwise("snoozed")
    made = lambda which, when, status: rows.filter(which).select(F.concat("event_id", status).alias("alert_id"), "event_id", "reminder_id", when.alias("trigger_at"), status.alias("status"), minutes(at, 1).alias("claimed_at"), minutes(at, 10).alias("snoozed_until"))
    stored = made("kind <> 'error'", F.when(e % 7 == 0, minutes(at, -60)).otherwise(at), status).unionByName(made("event_id % 5 = 0 AND event_id % 7 <> 0", at, F.lit("acknowledged"))).unionByName(made("event_id % 35 = 0", at, F.lit("due")))
    wanted = rows.filter("event_id % 11 <> 0").select("event_id", "reminder_id", "trigger_at", minutes(at, 15).alias("relevant_until"))
    named = lambda when: alerts.trigger_id(e, F.col("reminder_id"), when)
    moved = rows.filter("event_id % 7 = 0").select(named(at).alias("trigger_id"), named(minutes(at, -60)).alias("former_id"))
    found = alerts.adopted(wanted, stored, moved, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return found.select("trigger_id", "change", "status", F.unix_seconds("wake_at").alias("wake"))
