"""Functions, readers, writers and streams on small inputs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.functions import dates, money, references, text
from quaestor.operators import bids, catalogue, evidence, merge, projections, statistics
from quaestor.sinks import files
from quaestor.sources import documents
from quaestor.streaming import alerts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cost(h, bps, shipping):
    share = lambda m, b: (m * b + 5000) // 10000
    return h + share(h, bps) + shipping


def test_affordable_bid_is_the_highest(spark):
    tiers = [(0, 5), (100, 10), (500, 50)]
    grid = sorted({*range(0, 100, 5), *range(100, 500, 10), *range(500, 5000, 50)} - {0})
    rnd = random.Random(4)
    rows = [(rnd.randrange(4000), rnd.randrange(3000)) for _ in range(60)]
    df = spark.createDataFrame(rows, "budget long, bps int")
    found = money.with_affordable_bid(df, "h", F.col("budget"), F.col("bps"), money.ladder(tiers), 0, {"shipping_minor": F.lit(20)}).collect()
    for r in found:
        assert r.h == max((h for h in grid if cost(h, r.bps, 20) <= r.budget), default=None)


def test_money_limits(spark):
    assert one(spark, money.premium(F.lit(money.SAFE), F.lit(1))) is None
    assert one(spark, money.premium(F.lit(10), F.lit(20_000))) is None
    assert one(spark, money.share(F.lit(money.SAFE), F.lit(10_000))) == money.SAFE
    assert one(spark, money.plain_decimal(F.lit(5).cast("long"))) == "0.05"
    with pytest.raises(ValueError):
        money.ladder([(5, 1)])


def test_text_keys(spark):
    df = spark.createDataFrame([("Ｌeu   Numismatik",), ("leu  numismatik ",), (None,)], "t string")
    assert [r.k for r in text.with_identity_key(df, "t", "k").orderBy("k").collect()] == ["", "leu numismatik", "leu numismatik"]
    assert one(spark, text.greek_name(F.lit("Euthydemus"))) == "Euthydemos"
    assert one(spark, text.strip_tracking(F.lit("http://a/b?utm_source=x&q=1&gclid=2#top"))) == "http://a/b?q=1"
    assert one(spark, text.csv_cell(F.lit(' =1+"2"'))) == '"\' =1+""2"""'
    uuid = one(spark, text.stable_uuid(F.lit("live:x")))
    assert len(uuid) == 36 and uuid[14] == "4" and uuid[19] in "89ab"


def test_dates(spark):
    assert one(spark, dates.year_label(F.lit(-44), F.lit(-31))) == "44–31 BC"
    assert one(spark, dates.year_label(F.lit(-27), F.lit(14))) == "27 BC–AD 14"
    assert one(spark, dates.year_label(F.lit(64), F.lit(None).cast("int"))) == "AD 64"
    start = dates.start_of_day(F.lit("2026-09-06").cast("date"), F.lit("America/Santiago"))
    assert one(spark, F.date_format(start, "yyyy-MM-dd HH:mm")) == "2026-09-06 04:00"


def test_citations(spark):
    cited = lambda t: one(spark, references.cites(F.lit(t), ["RIC"], "306"))
    assert cited("") and cited("Nero. RIC I 306.") and cited("RIC 306; BMC 5")
    assert not cited("RIC 3061") and not cited("BMC 306") and not cited("RIC 4. 306 EUR")


def test_embedded_sales(spark):
    page = 'x<script>acsearch.initSearchResults = [{"id":"1","title":"a ]; b","price":"*"},{"id":"2","title":"c","price":"5"}];</script>'
    df = spark.createDataFrame([(1, page), (2, "nothing"), (3, None)], "page int, html string")
    assert [(r.page, r.row_idx, r.id, r.title) for r in documents.result_rows(df).collect()] == [(1, 0, "1", "a ]; b"), (1, 1, "2", "c")]


def test_feed_and_snapshot(spark, tmp_path):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>RIC I &amp; 1</title><id>a</id></entry><entry><title>B</title><id>b</id></entry></feed>'
    assert [tuple(x) for x in one(spark, documents.feed_entries(F.lit(feed)))] == [("a", "RIC I & 1"), ("b", "B")]
    (tmp_path / "s.json").write_text('{"schemaVersion": 2, "lots": [{"id": "x", "title": "t"}]}')
    assert documents.collection(documents.snapshots(spark, str(tmp_path)), "lots").first().title == "t"


def test_rdf(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<rdf><nmo:TypeSeriesItem rdf:about="http://x/id/ric.1" xml:x="1"><skos:prefLabel xml:lang="de">D</skos:prefLabel><skos:prefLabel xml:lang="en">E</skos:prefLabel><nmo:hasMint rdf:resource="http://n/id/rome"/></nmo:TypeSeriesItem></rdf>')
    row = documents.rdf_types(spark, str(tmp_path / "t.xml")).first()
    assert (row.id, row.title, row.mints) == ("ric.1", "E", ["rome"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "=a")], "id int, group string")
    files.write_csv(df, str(tmp_path / "csv"), ["id"])
    lines = [x for p in sorted((tmp_path / "csv").glob("*/part*")) for x in p.read_bytes().decode().split("\r\n") if x]
    assert lines == ['﻿"id","group"', '"1","\'=a"', '"2","b"']
    files.write_shards(df, str(tmp_path / "shards"), 10_000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2
    files.write_backup(df, str(tmp_path / "backup"), ["id"])
    assert spark.read.json(str(tmp_path / "backup")).count() == 2


def test_redirect_classes(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("x", "y"), ("y", "x"), ("m", "c"), ("m", "n"), ("k", "m")], "old string, new string")
    found = {r.old: (r.target, r.status) for r in catalogue.resolve_redirects(links, spark.createDataFrame([("c",)], "id string")).collect()}
    assert found == {"a": ("c", "ok"), "b": ("c", "ok"), "d": (None, "dangling"), "x": (None, "cycle"), "y": (None, "cycle"), "m": (None, "ambiguous"), "k": (None, "ambiguous")}


def test_redirects_of_long_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 97) for i in range(97)] + [(2000, 1000)]
    found = catalogue.resolve_redirects(spark.createDataFrame(links, "old long, new long"), spark.createDataFrame([(200,)], "id long")).collect()
    assert {r.old: (r.target, r.status) for r in found} == {a: (200, "ok") if a < 200 else (None, "cycle") for a, _ in links}


def test_half_medians_by_counts(spark):
    rnd = random.Random(6)
    rows = [(g, rnd.randrange(1, 30)) for g in range(40) for _ in range(g)] + [(None, 5)] * 7 + [(99, None)]
    df = spark.createDataFrame(rows, "g int, minor long")
    lists = df.groupBy("g").agg(F.collect_list("minor").alias("m"))
    want = lists.select("g", F.size("m").cast("long").alias("count"), *(v.alias(k) for k, v in statistics.half_medians(F.col("m")).items()))
    made = statistics.counted_half_medians(df, ["g"], "minor")
    assert made.columns == want.columns and sorted(map(repr, made.collect())) == sorted(map(repr, want.collect()))
    plan = evidence.statistics(df.withColumn("reason", F.lit(None).cast("string")), ["g"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_stream_lands_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """No row passes through the driver, nothing is cut off by time, and a failure is raised."""
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "request_id long, t string").selectExpr("request_id", "cast(t as timestamp) ts")
    df.write.parquet(str(tmp_path / "in"))
    limits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: (limits.append(timeout), wait(self, timeout))[1])
    rows = alerts.landed(alerts.once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "60 days"))
    assert sorted(r.request_id for r in rows.collect()) == [1, 2] and limits == [None]
    assert rows.inputFiles() and not spark.streams.active
    (tmp_path / "none").mkdir()
    assert alerts.landed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "none"))).count() == 0
    bad = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        alerts.landed(bad)


def test_commands(spark):
    rows = [("i", "r1", 1, "put", 0, "a"), ("i", "r1", 2, "put", 0, "z"), ("i", "r2", 3, "put", 0, "b"), ("i", "r3", 4, "put", 1, "c"), ("i", "r4", 5, "delete", 2, None)]
    state = merge.apply_commands(spark.createDataFrame(rows, "id string, request_id string, seq int, kind string, expected int, value string")).first()
    assert (state.revision, state.value, state.live, state.refused) == (3, None, False, 1)
    assert one(spark, merge.changed_fields({"a": F.lit(1), "b": F.lit(2)}, {"a": F.lit(1), "b": F.lit(3)})) == "b"


def test_exposure_refuses_unsafe_sums(spark):
    df = spark.createDataFrame([("open", "EUR", None, money.SAFE, None, None, 0)] * 2, "outcome string, currency string, event_id long, bid_minor long, premium_bps int, sheet_currency string, shipping_minor int")
    with pytest.raises(Exception, match="unsafe exposure"):
        projections.exposure(df).collect()


def test_alert_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "trigger"), (1, "2024-01-01 00:01:00", "claim"), (2, "2024-01-01 00:00:00", "trigger"), (2, "2024-01-01 00:02:00", "deliver"), (2, "2024-01-01 00:03:00", "claim")]
    df = spark.createDataFrame(rows, "trigger_id long, t string, kind string").selectExpr("trigger_id", "cast(t as timestamp) ts", "kind")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alerts.follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("alerts_followed").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    found = {}
    for r in spark.table("alerts_followed").orderBy("ts").collect():
        found.setdefault(r.trigger_id, []).append(r.status)
    assert found == {1: ["due", "claimed"], 2: ["due", "delivered"]}


def test_shards_are_even_and_within_their_limit(spark):
    """Against a walk over the records, with some nearly as large as a part may be."""
    rnd = random.Random(7)
    rows = [(g, i, rnd.choice([5, 9, 40, 90])) for g in "abcde" for i in range(rnd.randrange(1, 60))]
    want = {}
    for g in "abcde":
        own = [(i, b) for h, i, b in rows if h == g]
        total, count = sum(b for _, b in own), 1
        while True:
            part, carried, sizes, found = 0, 0, [0] * count, {}
            for n, (_, b) in enumerate(own):
                if n and sizes[part] and part + 1 < count and carried * count >= total * (part + 1):
                    part += 1
                sizes[part] += b
                found[own[n][0]] = part
                carried += b
            if max(sizes) - 1 <= 100:
                break
            count += 1
        want.update({(g, i): p for i, p in found.items()})
    df = spark.createDataFrame(rows, "group string, id int, bytes int")
    try:
        got = {(r.group, r.id): r.part for r in catalogue.shard_parts(df, 100).collect()}
    except ValueError:
        assert max(want.values()) >= catalogue.PARTS
    else:
        assert got == want
    one = df.filter("id = 0").withColumn("bytes", F.lit(90))
    assert {r.part for r in catalogue.shard_parts(one, 89).collect()} == {0}
    with pytest.raises(ValueError, match="larger than a part"):
        catalogue.shard_parts(one, 88)
    with pytest.raises(ValueError, match="letters"):
        catalogue.shard_parts(spark.range(60).selectExpr("'a' AS group", "id", "60 AS bytes"), 70)
    with pytest.raises(ValueError, match="letters"):
        catalogue.shard_parts(spark.range(4000).selectExpr("'a' AS group", "id", "60 AS bytes"), 70)
    assert catalogue.shard_parts(df.filter("id < 0")).count() == 0


def test_sale_keys_fold_compatible_characters(spark):
    df = spark.createDataFrame([("Ｌeu", "1", "５"), ("leu ", "1", "5"), (None, "1", "5")], "h string, s string, l string")
    keys = [r.sale_key for r in evidence.with_sale_key(df, "h", "s", "l").collect()]
    assert sorted(keys, key=str) == [None, '["leu","1","5"]', '["leu","1","5"]'] and set(df.columns) < {*evidence.with_sale_key(df, "h", "s", "l").columns}
    assert {r.k for r in text.ruler_key(spark.createDataFrame([("Euthydème",), ("euthydeme",)], "n string"), "n", "k").collect()} == {"euthydeme"}


def test_prices_and_references_in_doubt(spark):
    price = lambda t, c=None: one(spark, text.parse_price(F.lit(t), F.lit(c).cast("string")))
    assert [price(t) for t in ("1.234.567,8", "12,345.6", "1234,567", "1,2,3", "1 234.5", "5,", ",5", "1..5", "USD 1'000", "1.234.567", "12.34.5")] == [1234567.8, 12345.6, None, None, 1234.5, None, None, None, 1000.0, 1234567.0, None]
    read = lambda t: tuple(one(spark, references.parse_reference(F.lit(t))) or ())
    assert [read(t) for t in ("RIC XI Nero 1", "RIC hello 5", "RIC II.2 Hadrian 5", "Crawfrd 44/5", "Lot 80: RIC 972", "cf. RIC 972", "972", "hello", "Price", "Good VF, 3.21 g, 6h, lot 42, bought in Vienna 1990")] == [()] * 10
    assert read("RIC V, part II Probus 12") == ("RIC", "V, Part 2", "Probus", "12") and read("Euthydemus I Bop. 24A") == ("Bop", "", "Euthydemus I", "24A")
    assert read("ric hadrian 5") == ("RIC", "", "hadrian", "5") and read("SNG von Aulock 5960, 5961, 5962, 5963, 5964, 5965, 5966") == ("Other", "", "", "SNG von Aulock 5960, 5961, 5962, 5963, 5964, 5965, 5966")
    assert read("RIC II, Part 3 Hadrian 1009") == ("RIC", "II, Part 3", "Hadrian", "1009")
    assert read("RIC 5.1 Gallienus 12 (aureus)") == ("RIC", "V, Part 1", "Gallienus", "12 (aureus)")
    assert read("RIC I (2nd ed.) Nero 306") == ("RIC", "I (2nd edition)", "Nero", "306")
    assert read("ric vol. VII, Antioch, 1") == ("RIC", "VII", "Antioch", "1")
    assert read("Bopearachchi Série 6C") == ("Bop", "", "", "6C") and read("Bopearachchi & Rahman 268")[0] == "Other"
    assert read("Ricci 5")[0] == "Other" and read("") == () and read("Price") == ()


def test_bid_commands_for_no_lot(spark):
    lots = spark.createDataFrame([(1, 0, None, None, "open", False)], "id long, revision long, planned long, active long, outcome string, linked boolean")
    sent = spark.createDataFrame([(1, "a", 1, "bid.place", 0, 500, None), (1, "b", 2, "lot.outcome.set", 1, None, "won"), (2, "c", 3, "bid.place", 0, 9, None)], "lot_id long, request_id string, seq long, kind string, expected long, amount long, outcome string")
    state = bids.apply(lots, sent).first()
    assert (state.revision, state.active, state.outcome, [tuple(b) for b in state.bids]) == (2, None, "won", [("placed", 500), ("settled-won", 500)])
    assert [r.lot_id for r in bids.orphans(lots, sent).collect()] == [2]


def test_pages_are_cut_by_bytes(spark):
    sale = 'acsearch.initSearchResults = [{"id":"1"}]'
    pages = spark.createDataFrame([(1, "é" * 1_000_000 + sale), (2, "é" * 1_050_000 + sale), (3, None)], "page int, html string")
    assert [r.page for r in documents.result_rows(pages).collect()] == [1]


def test_hits_keep_their_order(spark):
    from quaestor.operators import workspace

    hits = spark.createDataFrame([(1, "b", "x", 1), (1, "a", "y", 2), (2, "d", " Asked ", 1), (2, "c", "asked", 2), (3, None, None, 1)], "query_id int, id string, title string, position int")
    asked = spark.createDataFrame([(1, "none"), (2, "asked"), (3, "asked"), (4, None)], "query_id int, title string")
    found = {r.query_id: (r.status, r.ids) for r in workspace.matched(hits, asked).collect()}
    assert found == {1: ("candidates", ["b", "a"]), 2: ("ok", ["d"]), 3: ("none", []), 4: ("none", [])}
    assert {r.query_id: r.ids for r in workspace.matched(hits.drop("position"), asked).collect()}[2] == ["c"]
