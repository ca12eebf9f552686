"""Wall times in zones, resolved exactly: a gap or an overlap is told, not shifted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOON_SECONDS = 48 * 3600


def candidates(local: Column, zone: Column) -> Column:
    """All instants (epoch seconds, ascending) that read as local in zone: none in a gap, two in an overlap.

    local is a timestamp read as wall time in a UTC session. The zone's offsets around it
    are tried, and those that read back stay.
    """
    wall = F.unix_seconds(local)
    offsets = F.array_distinct(F.transform(F.array(*(F.lit(d * 86400).cast("bigint") for d in range(-2, 3))), lambda d: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(wall + d), zone)) - wall - d))
    return F.array_sort(F.filter(F.transform(offsets, lambda o: wall - o), lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone)) == wall))


def resolve(local: Column, zone: Column) -> Column:
    """struct<status, instant>: 'ok' with its one instant, else 'nonexistent' or 'ambiguous'."""
    found = candidates(local, zone)
    size = F.size(found)
    status = F.when(size == 1, "ok").when(size == 0, "nonexistent").otherwise("ambiguous")
    return F.struct(status.alias("status"), F.when(size == 1, F.timestamp_seconds(F.get(found, F.lit(0)))).alias("instant"))


def start_of_day(date: Column, zone: Column) -> Column:
    """The later of midnight's instants; where midnight is skipped, the day's first instant an hour on."""
    found = candidates(date.cast("timestamp"), zone)
    later = candidates(date.cast("timestamp") + F.expr("interval 1 hour"), zone)
    return F.timestamp_seconds(F.coalesce(F.array_max(found), F.array_min(later)))


def local_date(instant: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def event_timing(precision: Column, kind: Column, local_day: Column, starts_at: Column, zone: Column, now: Column) -> Column:
    """struct<state, days_until, sort_at> of an auction at a given moment.

    A timed one is soon within 48 hours and ended when it has begun, or started as long as
    the day of a live sale lasts; a day alone is soon from the day before.
    """
    days = F.date_diff(local_day, local_date(now, zone))
    timed = (precision == "timed") & starts_at.isNotNull()
    left = F.unix_seconds(starts_at) - F.unix_seconds(now)
    by_time = F.when(left > SOON_SECONDS, "upcoming").when(left >= 0, "soon").when((kind == "auction-starts") & (days >= 0), "started").otherwise("ended")
    by_day = F.when(days < 0, "ended").when(days <= 1, "soon").otherwise("upcoming")
    state = F.when(local_day.isNull(), "unknown").when(timed, by_time).otherwise(by_day)
    midnight = resolve(local_day.cast("timestamp"), zone)["instant"]
    return F.struct(state.alias("state"), days.alias("days_until"), F.when(timed, starts_at).otherwise(F.coalesce(midnight, local_day.cast("timestamp"))).alias("sort_at"))


def year_label(start: Column, end: Column) -> Column:
    """Signed years in words: '27 BC', '44–31 BC', 'AD 64–68', '27 BC–AD 14'; one year may be absent."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    era = lambda y: F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BC"))).otherwise(F.concat(F.lit("AD "), y.cast("string")))
    joined = lambda x, y: F.concat(x, F.lit("–"), y)
    return (
        F.when(a == b, era(a))
        .when((a < 0) & (b < 0), F.concat(joined((-a).cast("string"), (-b).cast("string")), F.lit(" BC")))
        .when((a > 0) & (b > 0), joined(era(a), b.cast("string")))
        .otherwise(joined(era(a), era(b)))
    )
