"""Date functions that give null instead of failing on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyy-MM-dd HH:mm:ss"
_WIDTH = 19  # length of a formatted timestamp
_ZONE_NAME = rf"(?s)^.{{{_WIDTH}}}( [A-Za-z][A-Za-z_/]*)?$"


def parse_timestamp(text: Column, zone: bool = True) -> Column:
    """A time; with `zone` one zone name may follow, which changes nothing. Null for any other tail."""
    fits = F.rlike(text, F.lit(_ZONE_NAME)) if zone else F.length(text) == _WIDTH
    return F.when(fits, F.try_to_timestamp(F.substring(text, 1, _WIDTH), F.lit(FORMAT)))


def format_timestamp(moment: Column) -> Column:
    return F.date_format(moment, FORMAT)


def drop_zone(text: Column) -> Column:
    """Rewrite "date time zone" as "date time"; null if it is no timestamp."""
    return format_timestamp(parse_timestamp(text))


def age_seconds(moment: Column, as_of: Column | None = None) -> Column:
    """Seconds since an event; `moment` may be a timestamp or ISO text."""
    now = F.current_timestamp() if as_of is None else as_of
    return now.cast("timestamp").cast("double") - moment.try_cast("timestamp").cast("double")


def within_age(moment: Column, max_age: float = 60.0, as_of: Column | None = None) -> Column:
    """True while the event is no older than `max_age`; the exact limit still passes."""
    return age_seconds(moment, as_of) <= F.lit(max_age)
