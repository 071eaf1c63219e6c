"""Column expressions for time. "Now" is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as fv


def moment(now: datetime | str | Column) -> Column:
    if isinstance(now, Column):
        return now
    return F.to_timestamp(F.lit(str(now)))


def parse_mixed(raw: Column) -> Column:
    """RFC 822 or ISO 8601 text to an instant; a value without zone is UTC."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    day_first = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    day_first = F.regexp_replace(day_first, r"\s+", " ")
    day_first = F.regexp_replace(day_first, r" \([A-Za-z ]+\)$", "")
    day_first = F.regexp_replace(day_first, " (GMT|UT|UTC|Z)$", " +0000")
    day_first = F.regexp_replace(day_first, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})( [+-]\d{4})?$", "$1:00$2")
    day_first = F.when(day_first.rlike(r"[+-]\d{4}$"), day_first).otherwise(F.concat(day_first, F.lit(" +0000")))
    rfc = F.try_to_timestamp(day_first, F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.regexp_replace(text, "Z$", "+00:00")
    has_zone = iso.rlike(r"[+-]\d{2}:?\d{2}$") & iso.rlike(r"\d{2}:\d{2}")
    iso_zoned = F.when(has_zone, iso).otherwise(
        F.concat(iso, F.when(iso.rlike(r"\d{2}:\d{2}"), F.lit("+00:00")).otherwise(F.lit("T00:00:00+00:00")))
    )
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(iso_zoned)).otherwise(rfc)


def repair_clock(published: Column, true_zone: Column) -> Column:
    """Some feeds label a wall time with the wrong zone: keep the wall time, read it in the zone it really is in."""
    known = true_zone.isin("utc", "-03:00", "-04:00")
    zone = F.when(true_zone == "utc", F.lit("+00:00")).otherwise(true_zone)
    return F.when(known & published.isNotNull(), F.to_utc_timestamp(published, zone)).otherwise(published)


def admitted_time(published: Column, now: Column) -> Column:
    """No date or a date more than two hours ahead counts as now."""
    latest = now + F.expr("INTERVAL 2 HOURS")
    return F.when(published.isNull() | (published > latest), now).otherwise(published)


def local(ts: Column, zone: str = fv.DISPLAY_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_day(ts: Column, zone: str = fv.DISPLAY_ZONE) -> Column:
    return F.date_format(local(ts, zone), "yyyy-MM-dd")


def local_hour(ts: Column, zone: str = fv.DISPLAY_ZONE) -> Column:
    return F.hour(local(ts, zone))


def age_hours(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3_600_000_000.0)
