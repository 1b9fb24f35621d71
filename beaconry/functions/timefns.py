"""Timestamp expressions. All of them return UTC instants or text, never session-local time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.constants import DISPLAY_ZONE

RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?"
    r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
)
_WEEKDAY = r"(?i)^\s*(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
# Named zones allowed in feed dates (fixed values).
_NAMED_ZONES = {
    "UTC": "+0000", "UT": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
MICROS_PER_DAY = 86_400_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0


def strict_time(text: Column) -> Column:
    """Instant of a text that names its zone; naive, date-only and malformed text give null."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def lenient_time(text: Column) -> Column:
    """Like ``strict_time`` but naive text counts as UTC."""
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"[T ]")
    return F.try_to_timestamp(F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))))


def feed_time(text: Column) -> Column:
    """Feed dates: ISO 8601 first, then RFC 822 with numeric or named zones; naive means UTC."""
    cleaned = F.trim(text)
    iso = F.when(cleaned.rlike(r"^\d{4}-\d{2}-\d{2}"), lenient_time(cleaned))
    rfc = F.regexp_replace(F.regexp_replace(cleaned, _WEEKDAY, ""), r"\s+", " ")
    for name, offset in _NAMED_ZONES.items():
        rfc = F.regexp_replace(rfc, rf" {name}$", f" {offset}")
    # Two-digit seconds are optional and a missing zone means UTC.
    rfc = F.regexp_replace(rfc, r"^(\d{1,2} \w{3} \d{4} \d{2}:\d{2})(?= |$)(?!:)", "$1:00")
    rfc = F.when(rfc.rlike(r"[+-]\d{4}$"), rfc).otherwise(F.concat(rfc, F.lit(" +0000")))
    return F.coalesce(iso, F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))


def micros(instant: Column) -> Column:
    return F.unix_micros(instant)


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY)


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(MICROS_PER_HOUR)


def display_label(instant: Column) -> Column:
    """``YYYY-MM-DD HH:MM CST`` in the display zone."""
    local = F.from_utc_timestamp(instant, DISPLAY_ZONE)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(" CST"))


def iso_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd")
