"""The alert machine, in batch and as a stream, and exactly-once commands.

A trigger is pending until its time, then due; claimed while delivery is tried and again
due five minutes later; missed once its relevance has ended; acknowledged or snoozed by
hand. Time is a column or the event time, never the clock.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder

RETRY_SECONDS = 300
DONE = ("delivered", "acknowledged", "missed")


def status_at(status: Column, trigger_at: Column, claimed_at: Column, snoozed_until: Column, relevant_until: Column, now: Column) -> Column:
    """An alert's status at a moment, from what is stored of it."""
    retry = F.unix_seconds(claimed_at) + RETRY_SECONDS <= F.unix_seconds(now)
    return (
        F.when(status.isin(*DONE), status)
        .when(now > relevant_until, "missed")
        .when((status == "snoozed") & (now < snoozed_until), "snoozed")
        .when((status == "claimed") & ~F.coalesce(retry, F.lit(False)), "claimed")
        .when(now >= trigger_at, "due")
        .otherwise("pending")
    )


def reconcile(triggers: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Triggers against stored alerts by trigger_id: new ones are added, vanished ones dropped,
    and every status brought up to now; wake_at is when the alert is to be looked at next."""
    both = triggers.join(alerts.select("trigger_id", "status", "claimed_at", "snoozed_until"), "trigger_id", "left")
    status = status_at(F.coalesce("status", F.lit("pending")), F.col("trigger_at"), F.col("claimed_at"), F.col("snoozed_until"), F.col("relevant_until"), now)
    after = F.timestamp_seconds(F.unix_seconds("relevant_until") + 1)
    wake = F.when(F.col("status_now") == "pending", F.col("trigger_at")).when(F.col("status_now") == "snoozed", F.col("snoozed_until")).when(F.col("status_now") == "claimed", F.timestamp_seconds(F.unix_seconds("claimed_at") + RETRY_SECONDS)).when(F.col("status_now") == "due", after)
    return both.withColumn("status_now", status).withColumn("wake_at", F.least(wake, after)).select("trigger_id", "trigger_at", F.col("status_now").alias("status"), F.when(~F.col("status_now").isin(*DONE), F.col("wake_at")).alias("wake_at"))


#: How much a status says of what the collector did: of two alerts that come to one trigger the higher stays.
RANK = ("pending", "due", "claimed", "delivered", "missed", "snoozed", "acknowledged")
#: Statuses that hold a decision or a delivery, which stays when the reminder moves.
SETTLED = ("claimed", "delivered", "missed", "snoozed", "acknowledged")


def trigger_id(event: Column, reminder: Column, at: Column) -> Column:
    """The name of a trigger: its event, its reminder and its instant in UTC."""
    return F.concat_ws(":", event, reminder, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def adopted(triggers: DataFrame, alerts: DataFrame, moved: DataFrame, now: Column) -> DataFrame:
    """trigger_id, change, status, wake_at of every trigger and every alert that has none any more.

    triggers: event_id, reminder_id, trigger_at, relevant_until. alerts: alert_id, event_id, reminder_id, trigger_at, status,
    claimed_at, snoozed_until; they are named anew by their own fields, and of several with one name that of the
    highest RANK stays, the least alert_id of these. moved: trigger_id, former_id of reminders whose instant is no longer what it was: a
    SETTLED alert at the former one goes along, unless the new one has an alert or is no trigger.
    change is new, kept, moved or vanished; what vanished has no status. Settled alerts do not ring again by moving.
    """
    named = lambda df: df.withColumn("trigger_id", trigger_id(F.col("event_id"), F.col("reminder_id"), F.col("trigger_at")))
    wanted = named(triggers).select("trigger_id", "trigger_at", "relevant_until")
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("status"))
    state = F.struct("status", "claimed_at", "snoozed_until")
    held = named(alerts).groupBy("trigger_id").agg(F.min_by(state, F.struct(-rank, F.col("alert_id"))).alias("s")).select("trigger_id", "s.*")
    goes = moved.join(held.filter(F.col("status").isin(*SETTLED)).withColumnRenamed("trigger_id", "former_id"), "former_id")
    goes = goes.join(wanted.select("trigger_id"), "trigger_id", "left_semi").join(held.select("trigger_id"), "trigger_id", "left_anti")
    goes = goes.groupBy("former_id").agg(F.min(F.struct("trigger_id", "status", "claimed_at", "snoozed_until")).alias("s"))
    stays = held.join(goes.select(F.col("former_id").alias("trigger_id")), "trigger_id", "left_anti").withColumn("how", F.lit("kept"))
    stored = stays.unionByName(goes.select("s.*").withColumn("how", F.lit("moved")))
    both = wanted.withColumn("here", F.lit(True)).join(stored, "trigger_id", "full_outer")
    change = F.when(F.col("here").isNull(), "vanished").otherwise(F.coalesce("how", F.lit("new")))
    status = status_at(F.coalesce("status", F.lit("pending")), F.col("trigger_at"), F.col("claimed_at"), F.col("snoozed_until"), F.col("relevant_until"), now)
    both = both.withColumn("status", F.when(F.col("here"), status))
    return both.select("trigger_id", change.alias("change"), "status", _wake(both))


def _wake(rows: DataFrame) -> Column:
    """When an alert is to be looked at next: its trigger, the end of a snooze or of a claim, but no later than just past its relevance; null once it is done."""
    after = F.timestamp_seconds(F.unix_seconds("relevant_until") + 1)
    status = rows["status"]
    next_ = F.when(status == "pending", F.col("trigger_at")).when(status == "snoozed", F.col("snoozed_until")).when(status == "claimed", F.timestamp_seconds(F.unix_seconds("claimed_at") + RETRY_SECONDS))
    return F.when(status.isNotNull() & ~status.isin(*DONE), F.least(F.coalesce(next_, after), after)).alias("wake_at")


def once(commands: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Commands without repeats of a request_id within the delay of their event time."""
    return commands.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def landed(stream: DataFrame) -> DataFrame:
    """The rows of a stream over all there is now, as a Parquet table in the shared folder.

    It is waited for without a limit, and a stream that fails raises.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # A stream without input writes nothing, so the table is there before it.
    spark.createDataFrame([], stream.schema).write.parquet(f"{place}/rows")
    writer = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def follow(events: DataFrame) -> DataFrame:
    """Stream of (trigger_id, ts, kind) to (trigger_id, ts, status): each key's state follows its
    events in order of event time, with a timer that makes an unanswered claim due again."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "pending"
        out = []
        if state.hasTimedOut:
            if status == "claimed":
                status = "due"
                out.append((key[0], pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"), status))
        else:
            known = pd.concat(list(rows)).sort_values("ts", kind="stable")
            moves = {"trigger": "due", "claim": "claimed", "deliver": "delivered", "ack": "acknowledged", "snooze": "snoozed", "miss": "missed"}
            for ts, kind in zip(known["ts"], known["kind"], strict=True):
                new = status if status in DONE else moves.get(kind, status)
                if new != status:
                    status = new
                    out.append((key[0], ts, status))
            if status == "claimed":
                state.setTimeoutTimestamp(max(int(known["ts"].max().timestamp() * 1000) + RETRY_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))
        state.update((status,))
        yield pd.DataFrame(out, columns=["trigger_id", "ts", "status"]).astype({"ts": "datetime64[ns]"})

    return events.withWatermark("ts", "10 minutes").groupBy("trigger_id").applyInPandasWithState(step, "trigger_id bigint, ts timestamp, status string", "status string", "append", GroupStateTimeout.EventTimeTimeout)
