"""Alerts whose triggers are new, moved or gone; and the timer of a claim in a stream."""

from pyspark.sql import functions as F

from quaestor.streaming import alerts


def test_adoption(spark):
    ts = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    times = lambda df: df.withColumns({c: F.col(c).cast("timestamp") for c in df.columns if c in ("trigger_at", "relevant_until", "claimed_at", "snoozed_until")})
    triggers = times(spark.createDataFrame([(e, "r", ts(12), ts(13)) for e in "abcdefg"] + [("h", "r", ts(9), ts(10)), ("i", "r", ts(11), ts(13))], "event_id string, reminder_id string, trigger_at string, relevant_until string"))
    stored = times(spark.createDataFrame([
        (1, "a", "r", ts(12), "pending", None, None), (2, "b", "r", ts(8), "acknowledged", None, None), (3, "c", "r", ts(8), "due", None, None), (4, "d", "r", ts(8), "snoozed", None, ts(12, 30)), (5, "d", "r", ts(12), "pending", None, None),
        (6, "e", "r", ts(12), "due", None, None), (7, "e", "r", ts(12), "acknowledged", None, None), (8, "z", "r", ts(12), "pending", None, None), (9, "f", "r", ts(8), "claimed", ts(11, 58), None), (10, "i", "r", ts(11), "claimed", ts(11, 1), None),
    ], "alert_id int, event_id string, reminder_id string, trigger_at string, status string, claimed_at string, snoozed_until string"))
    name = lambda e, h: f"{e}:r:2024-01-01T{h:02d}:00:00.000Z"
    moved = spark.createDataFrame([(name(e, 12), name(e, 8)) for e in "bcdf"] + [(name("y", 12), name("b", 8))], "trigger_id string, former_id string")
    found = alerts.adopted(triggers, stored, moved, F.lit(ts(12)).cast("timestamp"))
    got = {r.trigger_id: (r.change, r.status, r.wake and r.wake[11:16]) for r in found.withColumn("wake", F.col("wake_at").cast("string")).collect()}
    assert got == {
        name("a", 12): ("kept", "due", "13:00"), name("b", 12): ("moved", "acknowledged", None), name("c", 8): ("vanished", None, None), name("c", 12): ("new", "due", "13:00"),
        name("d", 8): ("vanished", None, None), name("d", 12): ("kept", "due", "13:00"), name("e", 12): ("kept", "acknowledged", None), name("z", 12): ("vanished", None, None),
        name("f", 12): ("moved", "claimed", "12:03"), name("g", 12): ("new", "due", "13:00"), name("h", 9): ("new", "missed", None), name("i", 11): ("kept", "due", "13:00"),
    }
    none = alerts.adopted(triggers.limit(0), stored.limit(0), moved.limit(0), F.lit(ts(12)).cast("timestamp"))
    assert none.collect() == []


def test_an_unanswered_claim_is_due_again(spark, tmp_path):
    """One file a batch: the timer of the first key fires once later events have moved the watermark past it; an answered claim has none."""
    batches = [[(1, "2024-01-01 00:00:00", "trigger"), (1, "2024-01-01 00:00:30", "claim"), (2, "2024-01-01 00:00:30", "claim")], [(2, "2024-01-01 00:02:00", "deliver")], [(3, "2024-01-01 02:00:00", "trigger")], [(4, "2024-01-01 04:00:00", "trigger")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "trigger_id long, t string, kind string").selectExpr("trigger_id", "cast(t as timestamp) ts", "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trigger_id bigint, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {}
    for r in alerts.landed(alerts.follow(stream)).orderBy("ts").collect():
        found.setdefault(r.trigger_id, []).append(r.status)
    assert found[1] == ["due", "claimed", "due"] and found[2] == ["claimed", "delivered"] and found[3] == ["due"] == found[4]
