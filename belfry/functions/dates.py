"""Dates: normalisation, free-text search, next occurrence, display and sort keys.

Stored dates are ``yyyy-MM-dd`` text.  "Today" is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from belfry.functions.text import empty_to_null, let, strip, title_case
from belfry.functions.times import two_digits

# Month and weekday names, date spellings, the evening boundary.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december"]
MONDAY_FIRST = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
SUNDAY_FIRST = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
MONTH_ALTERNATIVES = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    "sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
ISO_SHAPE = r"^(\d{4})-(\d{2})-(\d{2})$"
LONG_DATE = r"(?i)^([a-z]+)\s+(\d{1,2}),\s+(\d{4})$"
SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
MONTH_DAY = rf"({MONTH_ALTERNATIVES})\s+(\d{{1,2}})(?:\s+(\d{{2,4}}))?"
DAY_MONTH = rf"(\d{{1,2}})\s+({MONTH_ALTERNATIVES})(?:\s+(\d{{2,4}}))?"
YEAR_FIRST = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
YEAR_LAST = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})"
NO_YEAR = r"(\d{1,2})[-/.](\d{1,2})"
EVENING_START = 16 * 60
NEARBY_DAYS = 7


def _group(text: Column, pattern: str, i: int) -> Column:
    return empty_to_null(F.regexp_extract(text, pattern, i))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Date, or null when the parts name no calendar day."""
    y, m, d = (c.cast("int") for c in (year, month, day))
    text = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two_digits(m), F.lit("-"), two_digits(d))
    return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), text.try_cast("date"))


def month_number(name: Column) -> Column:
    """Full name or the customary abbreviation (``sept`` too) to 1..12, else null."""
    word = F.lower(name)
    full = F.array(*[F.lit(m) for m in MONTHS])
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    hit = F.greatest(F.array_position(full, word), F.array_position(short, word),
                     F.when(word == "sept", 9).otherwise(0))
    return F.when(hit > 0, hit.cast("int"))


def iso_shape(text: Column) -> Column:
    """Trimmed text when it looks like ``dddd-dd-dd``; the calendar is not consulted."""
    clean = strip(text)
    return F.when(clean.rlike(ISO_SHAPE), clean)


def event_date(text: Column) -> Column:
    """Written date to ISO text: ISO, ``April 5, 2026``, ``Apr 5, 2026``, ``4/5/2026``, ``4/5/26``."""
    return let(strip(text), event_date_of_clean)


def event_date_of_clean(raw: Column) -> Column:
    """:func:`event_date` of already trimmed text."""
    word = F.lower(F.regexp_extract(raw, LONG_DATE, 1))
    month = F.when(word != "sept", month_number(word))
    long = safe_date(_group(raw, LONG_DATE, 3), month, _group(raw, LONG_DATE, 2))
    y = _group(raw, SLASH_DATE, 3)
    century = F.when(F.length(y) == 4, 0).when(y.cast("int") >= 69, 1900).otherwise(2000)
    slash = safe_date(y.cast("int") + century, _group(raw, SLASH_DATE, 1), _group(raw, SLASH_DATE, 2))
    iso = F.when(~raw.startswith("0000"), raw.try_cast("date"))
    return (F.when(raw.rlike(ISO_SHAPE), iso).when(raw.contains("/"), slash).otherwise(long)).cast("string")


def normalize_year(text: Column, reference: Column) -> Column:
    year = empty_to_null(text).cast("int")
    return F.coalesce(F.when(F.length(text) == 2, year + 2000).otherwise(year), F.year(reference))


def yearless_date(month: Column, day: Column, reference: Column) -> Column:
    """The day nearest to ``reference`` among last, this and next year; the earlier one on ties."""
    found = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                        lambda shift: safe_date(F.year(reference) + shift, month, day))
    ranked = F.transform(F.filter(found, lambda d: d.isNotNull()),
                         lambda d: F.struct(F.abs(F.datediff(d, reference)).alias("gap"), d.alias("day")))
    return F.array_min(ranked)["day"]


def relaxed_date(text: Column, reference: Column) -> Column:
    """First plausible date anywhere in free text.

    Spellings are tried in a fixed order; within one spelling the first match that
    names a real day wins.
    """
    n = F.regexp_replace(F.lower(text), r"(\d+)(st|nd|rd|th)", "$1")
    n = strip(F.regexp_replace(F.replace(n, F.lit(","), F.lit(" ")), r"(?U)\s+", " "))
    return let(n, lambda clean: _first_date(clean, reference))


def _first_date(n: Column, reference: Column) -> Column:
    def first(pattern: str, build) -> Column:
        hits = F.transform(F.regexp_extract_all(n, F.lit(pattern), F.lit(0)),
                           lambda m: build(lambda i: F.regexp_extract(m, pattern, i)))
        return F.get(F.filter(hits, lambda d: d.isNotNull()), F.lit(0))

    def named(month_at: int, day_at: int):
        def build(g):
            month, day = month_number(F.substring(g(month_at), 1, 3)), g(day_at)
            dated = safe_date(normalize_year(g(3), reference), month, day)
            return F.when(g(3) != "", dated).otherwise(yearless_date(month, day, reference))
        return build

    return F.when(n.rlike(r"\d"), F.coalesce(
        first(MONTH_DAY, named(1, 2)),
        first(DAY_MONTH, named(2, 1)),
        first(YEAR_FIRST, lambda g: safe_date(g(1), g(2), g(3))),
        first(YEAR_LAST, lambda g: safe_date(normalize_year(g(3), reference), g(1), g(2))),
        first(NO_YEAR, lambda g: yearless_date(g(1), g(2), reference))))


def relaxed_date_multi(texts: list[Column], reference: Column) -> Column:
    """Date of the first text that holds one."""
    return F.aggregate(F.array(*texts), F.lit(None).cast("date"),
                       lambda found, text: F.coalesce(found, relaxed_date(text, reference)))


def within_days(day: Column, reference: Column, days: int = NEARBY_DAYS) -> Column:
    return F.abs(F.datediff(day, reference)) <= days


def weekday_index(name: Column) -> Column:
    """Monday-first index of a weekday name, null when unknown."""
    at = F.array_position(F.array(*[F.lit(d) for d in MONDAY_FIRST]), F.lower(name))
    return F.when(at > 0, (at - 1).cast("int"))


def rolled_date(text: Column) -> Column:
    """ISO-shaped text as a date where surplus days and months roll over (Feb 31 -> Mar 3)."""
    clean = strip(text)
    y, m, d = [F.coalesce(_group(clean, ISO_SHAPE, i).cast("int"), F.lit(1)) for i in (1, 2, 3)]
    y = F.when(y < 100, y + 1900).otherwise(y)
    start = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1)
    return F.when(clean.rlike(ISO_SHAPE), F.date_add(start, d - 1))


def next_weekly(day_name: Column, today: Column) -> Column:
    """The next day with that weekday; today counts."""
    ahead = F.pmod(weekday_index(day_name) - F.weekday(today), F.lit(7))
    return F.date_add(today, ahead)


def next_specific(text: Column, today: Column) -> Column:
    day = rolled_date(text)
    return F.when(day >= today, day)


def next_occurrence(kind, day_of_week, date, start_time, cancelled, today, zone: str = "UTC") -> Column:
    """ISO instant of the next occurrence, null when cancelled, past or unreadable."""
    day = (F.when((kind == "weekly") & (day_of_week != ""), next_weekly(day_of_week, today))
           .when((kind == "specific_date") & (date != ""), next_specific(date, today)))
    clock = F.concat(two_digits(F.floor(start_time / 60)), F.lit(":"), two_digits(start_time % 60))
    local = F.concat(day.cast("string"), F.lit("T"), clock, F.lit(":00.000Z"))
    if zone != "UTC":
        utc = F.to_utc_timestamp(F.concat(day.cast("string"), F.lit(" "), clock).cast("timestamp_ntz"), zone)
        local = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(~F.coalesce(cancelled.cast("boolean"), F.lit(False)), local)


def lastmod_date(text: Column) -> Column:
    return empty_to_null(F.regexp_extract(strip(text), r"^(\d{4}-\d{2}-\d{2})", 1))


def format_date(text: Column) -> Column:
    """``Tuesday, March 17th``; the text must name a real day."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    n = F.dayofmonth(day)
    suffix = (F.when(n.between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd")
              .when(n % 10 == 3, "rd").otherwise("th"))
    return F.concat(F.date_format(day, "EEEE, MMMM d"), suffix)


def format_day(kind: Column, day_of_week: Column, date: Column) -> Column:
    """Plural weekday for weekly rows, written date for dated rows, else empty."""
    return (F.when((kind == "weekly") & (day_of_week != ""), F.concat(title_case(day_of_week), F.lit("s")))
            .when(date != "", format_date(date)).otherwise(""))


def schedule_key(kind, day_of_week, date, start_time) -> Column:
    """Struct that sorts events in church-week order.

    Sunday first, then Saturday evening, then the other weekdays, then dated rows.
    The arithmetic interleaves late evenings with the next early morning on purpose.
    """
    dated = F.coalesce((kind == "specific_date") & (date != ""), F.lit(False))
    weekly_name = F.when((kind == "weekly") & (day_of_week != ""), F.lower(day_of_week))
    date_name = F.lower(F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "EEEE"))
    name = F.coalesce(weekly_name, F.when(date != "", date_name))
    index = F.array_position(F.array(*[F.lit(d) for d in SUNDAY_FIRST]), name) - 1
    key = (F.when(name == "sunday", start_time)
           .when((name == "saturday") & (start_time >= EVENING_START), 1000 + start_time)
           .otherwise(2000 + index * 1000 + start_time))
    group = F.when(dated, 2).when(name.isNull(), 1).otherwise(0)
    return F.struct(
        group.cast("int").alias("group"),
        F.when(group == 0, key.cast("int")).otherwise(0).alias("key"),
        F.when(dated, date).otherwise("").alias("date"),
        F.when(dated, start_time.cast("int")).otherwise(0).alias("start"))
