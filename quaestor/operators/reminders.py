"""When the reminders of auctions go off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import candidates, resolve, start_of_day

#: Waking hours, and when the business of a sale's day starts.
WAKING, MORNING = ("08:00", "21:00"), "09:00"
CLOCK = r"^([01]\d|2[0-3]):[0-5]\d$"


def _wall(day: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat_ws(" ", day.cast("string"), time))


def ring(sale_day: Column, days_before: Column, time: Column, zone: Column, own: Column) -> Column:
    """The instant at which a reminder for a day rings on its owner's clock; null for a time that is none.

    The window is the day days_before the sale, in the auction's zone: on the sale's day up to 9:00, else up to its last minute. In it
    the latest instant that reads as time in the owner's zone is taken; without any the latest
    minute of the owner's waking hours; without these 9:00 on the sale's day, else the window's start. Where 9:00 is skipped,
    an hour later counts. Zones must be names that Spark knows.
    """
    day = F.date_sub(sale_day, days_before)
    start = F.unix_seconds(start_of_day(day, zone))
    nine = F.coalesce(F.array_min(candidates(_wall(day, F.lit(MORNING)), zone)), F.array_min(candidates(_wall(day, F.lit("10:00")), zone)))
    last = F.when(days_before == 0, nine).otherwise(F.unix_seconds(start_of_day(F.date_add(day, 1), zone)) - 60)
    days = [F.date_add(day, k) for k in range(-2, 3)]
    same = F.array_max(F.filter(F.flatten(F.array(*(candidates(_wall(d, time), own) for d in days))), lambda u: u.between(start, last)))

    def awake(d: Column) -> Column:
        opens, closes = (candidates(_wall(d, F.lit(t)), own) for t in WAKING)
        end = F.least(F.array_max(closes), last)
        return F.when((end >= F.array_min(opens)) & (end >= start), end)

    waking = F.array_max(F.array(*(awake(d) for d in days)))
    return F.when(time.rlike(CLOCK), F.timestamp_seconds(F.coalesce(same, waking, F.when(days_before == 0, last).otherwise(start))))


def triggers(events: DataFrame, reminders: DataFrame) -> DataFrame:
    """trigger_id, event, reminder, trigger_at of every reminder that can be placed.

    events: event, precision, starts_at, local_day, zone. reminders: event, reminder, kind (offset or wall-time),
    offset_minutes, days_before, local_time, owner_zone. Offsets belong to timed events, wall times to those with
    a day only: on the owner's clock where their zone is known, else at that one instant in
    the auction's zone. Reminders without an event, or of the other kind, give no row.
    """
    both = events.select("event", "precision", "starts_at", "local_day", "zone").join(reminders, "event")
    offset = F.timestamp_seconds(F.unix_seconds("starts_at") - F.col("offset_minutes") * 60)
    plain = resolve(_wall(F.date_sub("local_day", F.col("days_before")), F.col("local_time")), F.col("zone"))["instant"]
    on_clock = ring(F.col("local_day"), F.col("days_before"), F.col("local_time"), F.col("zone"), F.col("owner_zone"))
    wall = (F.col("kind") == "wall-time") & (F.col("precision") == "date-only")
    at = F.when((F.col("kind") == "offset") & (F.col("precision") == "timed"), offset).when(wall & F.col("owner_zone").isNotNull(), on_clock).when(wall, plain)
    placed = both.withColumn("trigger_at", at).filter("trigger_at is not null")
    key = F.concat_ws(":", "event", "reminder", F.date_format("trigger_at", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
    return placed.select(key.alias("trigger_id"), "event", "reminder", "trigger_at")
