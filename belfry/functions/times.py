"""Times of day as integer minutes since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belfry.functions.text import let, strip

DAY_MINUTES = 24 * 60
LAST_MINUTE = DAY_MINUTES - 1

# The accepted time spellings.
MERIDIEM_HOURS = r"^\d{1,2}(:\d{2})?$"
CLOCK_FORM = r"^\d{1,2}:\d{2}$"
MILITARY_FORM = r"^\d{4}$"


def clean_time(text: Column) -> Column:
    """Trimmed time text with ``a.m.`` / ``p.m.`` spellings made ``AM`` / ``PM``."""
    raw = strip(text)
    spelled = raw
    for letter in "ap":
        spelled = F.regexp_replace(spelled, rf"(?i){letter}\.m\.?(?=\s|$)", f"{letter.upper()}M")
    return F.when(F.lower(raw).contains(".m"), spelled).otherwise(raw)


def minutes_of_clean(raw: Column) -> Column:
    """Minutes of an already cleaned time text; see :func:`minutes_of_day`."""
    def parts(clock: Column) -> tuple[Column, Column]:
        return (F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int"),
                F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("int"))

    def checked(h: Column, m: Column) -> Column:
        return F.when((h <= 23) & (m <= 59), h * 60 + m)

    half = F.upper(F.right(raw, F.lit(2)))
    body = strip(F.left(raw, F.length(raw) - 2))
    hour, minute = parts(body)
    hour24 = F.when(half == "PM", F.when(hour == 12, 12).otherwise(hour + 12)).otherwise(
        F.when(hour == 12, 0).otherwise(hour))
    military = (raw.substr(1, 2).try_cast("int"), raw.substr(3, 2).try_cast("int"))
    return (F.when(half.isin("AM", "PM"), F.when(body.rlike(MERIDIEM_HOURS), hour24 * 60 + F.coalesce(minute, F.lit(0))))
            .when(raw.rlike(CLOCK_FORM), checked(*parts(raw)))
            .when(raw.rlike(MILITARY_FORM), checked(*military))
            .when(F.lower(raw) == "midnight", F.lit(0))
            .when(F.lower(raw) == "noon", F.lit(720)))


def minutes_of_day(text: Column) -> Column:
    """Free-form time text to minutes, null when unreadable.

    Meridiem spellings are not range-checked (``8:75 AM`` is 555): the loader's
    range rule deals with what comes out above 1439.
    """
    return let(clean_time(text), minutes_of_clean)


def _hm(minutes: Column) -> tuple[Column, Column]:
    return F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _hour12(h: Column) -> Column:
    return F.when(h == 0, 12).when(h > 12, h - 12).otherwise(h).cast("string")


def format_time(minutes: Column) -> Column:
    """``7:30 AM``."""
    h, m = _hm(minutes)
    return F.concat(_hour12(h), F.lit(":"), two_digits(m), F.when(h < 12, " AM").otherwise(" PM"))


def format_time_lower(minutes: Column) -> Column:
    """``7:30 a.m.``; whole hours lose their ``:00``."""
    h, m = _hm(minutes)
    return F.concat(_hour12(h), F.when(m == 0, "").otherwise(F.concat(F.lit(":"), two_digits(m))),
                    F.when(h < 12, " a.m.").otherwise(" p.m."))


def format_time_range(start: Column, end: Column) -> Column:
    return F.concat_ws(" – ", format_time_lower(start), format_time_lower(end))


def to_hhmm(minutes: Column) -> Column:
    h, m = _hm(minutes)
    return F.concat(two_digits(h), two_digits(m))


def from_hhmm(text: Column, fallback: int) -> Column:
    """``HHMM`` with hour up to 24, clamped to the last minute; anything else is ``fallback``."""
    def read(raw: Column) -> Column:
        h, m = raw.substr(1, 2).try_cast("int"), raw.substr(3, 2).try_cast("int")
        ok = raw.rlike(MILITARY_FORM) & (h <= 24) & (m < 60)
        return F.when(ok, F.least(h * 60 + m, F.lit(LAST_MINUTE)))
    return F.coalesce(let(strip(text), read), F.lit(fallback))
