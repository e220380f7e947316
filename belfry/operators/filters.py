"""Row filters of the serving and work-list jobs, and the saved-filter codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belfry.functions import dates, times
from belfry.functions.text import empty_to_null, is_blank, strip, title_case
from belfry.functions.urls import query_value
from belfry.schemas import EVENT_TYPES, PROVIDERS

# Filter defaults, URL day names, place-result kinds, page cap.
DEFAULT_TYPE = "mass"
DAY_ABBREVIATIONS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
FILTER_PARAMS = ["type", "days", "from", "to"]
PLACE_TYPES = ["building", "street", "suburb", "district", "postcode", "city", "county", "state"]
ZIP_LIKE = r"^\d{2,5}(-\d{0,4})?$"
NEEDS_ID = ["parishes_online", "discover_mass"]
MAX_PAGES = 10
ALWAYS_SLOT, UNKNOWN_SLOT = 7, 8


# --- event predicate ---------------------------------------------------------------------------

def day_slot() -> Column:
    """Weekday index of an event; 7 when the weekday filter does not apply, 8 when it cannot match."""
    weekly = (F.col("event_kind") == "weekly") & (F.col("day_of_week") != "")
    dated = (F.col("event_kind") == "specific_date") & (F.col("date") != "")
    rolled = F.weekday(dates.rolled_date(F.col("date")))
    return (F.when(weekly, F.coalesce(dates.weekday_index(F.col("day_of_week")), F.lit(UNKNOWN_SLOT)))
            .when(dated, F.coalesce(rolled, F.lit(UNKNOWN_SLOT))).otherwise(ALWAYS_SLOT))


def event_matches(days: list[int], time_from: int | None, time_to: int | None) -> Column:
    """Not cancelled, weekday selected (or not applicable), start inside the inclusive range."""
    ok = F.col("cancelled") == 0
    if days:
        ok = ok & day_slot().isin(*days, ALWAYS_SLOT)
    if time_from is not None and time_to is not None:
        ok = ok & F.col("start_time").between(time_from, time_to)
    return ok


def of_types(types: list[str]) -> Column:
    """An empty list means every type."""
    return F.col("event_type").isin(*(types or EVENT_TYPES))


def time_range(time_from: Column, time_to: Column) -> tuple[Column, Column]:
    """The pair of bounds, both null when they cover the whole day."""
    full = (time_from <= 0) & (time_to >= times.LAST_MINUTE)
    return F.when(~full, time_from), F.when(~full, time_to)


# --- saved filters -----------------------------------------------------------------------------

def decode_filters(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add event_type, days, time_from, time_to read from a saved URL."""
    u = F.col(url)
    kind = query_value(u, "type")
    tokens = F.transform(F.split(query_value(u, "days"), ","), lambda t: F.lower(strip(t)))
    names = F.array(*[F.lit(a) for a in DAY_ABBREVIATIONS])
    indices = F.transform(tokens, lambda t: F.array_position(names, t).cast("int") - 1)
    days = F.array_sort(F.array_distinct(F.filter(indices, lambda i: i >= 0)))
    return urls.withColumns({
        "event_type": F.when(kind.isin(*EVENT_TYPES), kind).otherwise(DEFAULT_TYPE),
        "days": F.coalesce(days, F.array().cast("array<int>")),
        "time_from": times.from_hhmm(query_value(u, "from"), 0),
        "time_to": times.from_hhmm(query_value(u, "to"), times.LAST_MINUTE),
    })


def encode_filters(base_url: Column | None = None) -> Column:
    """Query text of a decoded filter: foreign parameters kept, defaults left out."""
    foreign = F.lit(None).cast("string")
    if base_url is not None:
        pairs = F.split(F.regexp_extract(base_url, r"\?([^#]*)", 1), "&")
        foreign = empty_to_null(F.array_join(F.filter(
            pairs, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*FILTER_PARAMS)), "&"))
    names = F.array(*[F.lit(a) for a in DAY_ABBREVIATIONS])
    days = F.array_join(F.transform(F.col("days"), lambda i: F.get(names, i)), "%2C")
    return F.concat_ws(
        "&", foreign,
        F.when(F.col("event_type") != DEFAULT_TYPE, F.concat(F.lit("type="), F.col("event_type"))),
        F.when(F.size("days") > 0, F.concat(F.lit("days="), days)),
        F.when(F.col("time_from") > 0, F.concat(F.lit("from="), times.to_hhmm(F.col("time_from")))),
        F.when(F.col("time_to") < times.LAST_MINUTE, F.concat(F.lit("to="), times.to_hhmm(F.col("time_to")))))


def distinct_filters(filters: DataFrame) -> DataFrame:
    """One row per different filter; the smallest filter_id stands for its equals."""
    return (filters.groupBy("event_type", "days", "time_from", "time_to")
            .agg(F.min("filter_id").alias("filter_id"), F.count(F.lit(1)).alias("n_saved")))


def filter_label() -> Column:
    """Short text of a decoded filter, null for the default view."""
    full = (F.col("time_from") <= 0) & (F.col("time_to") >= times.LAST_MINUTE)
    default = (F.col("event_type") == DEFAULT_TYPE) & (F.size("days") == 0) & full
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    listed = F.array_join(F.transform(F.col("days"), lambda i: F.get(names, i)), " · ")
    days = (F.when(F.size("days") == 0, None).when(F.size("days") <= 3, listed)
            .otherwise(F.concat(F.size("days").cast("string"), F.lit(" days"))))
    span = F.when(~full, times.format_time_range(F.col("time_from"), F.col("time_to")))
    return F.when(~default, F.concat_ws(" · ", title_case(F.col("event_type")), days, span))


def match_filters(events: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter_id, church_id, n_events) for many saved filters at once.

    Events shrink to one row per church, type, weekday slot and minute before they meet
    the filters; a filter becomes the (type, slot, hour) cells it covers, so the meeting
    is an equality join with a final range test instead of a nested loop.
    """
    cells = (events.where(F.col("cancelled") == 0)
             .groupBy("church_id", "event_type", day_slot().alias("slot"), "start_time")
             .agg(F.count(F.lit(1)).alias("n"))
             .withColumn("hour", F.floor(F.col("start_time") / 60).cast("int")))
    every_slot = F.sequence(F.lit(0), F.lit(UNKNOWN_SLOT))
    slots = F.when(F.size("days") == 0, every_slot).otherwise(F.concat("days", F.array(F.lit(ALWAYS_SLOT))))
    hours = F.sequence(F.floor(F.col("time_from") / 60).cast("int"), F.floor(F.col("time_to") / 60).cast("int"))
    covered = (filters.where(F.col("time_from") <= F.col("time_to"))
               .select("filter_id", "event_type", "time_from", "time_to", F.explode(slots).alias("slot"),
                       hours.alias("hours"))
               .withColumn("hour", F.explode("hours")).drop("hours"))
    hit = F.col("start_time").between(F.col("time_from"), F.col("time_to"))
    return (cells.join(covered, ["event_type", "slot", "hour"]).where(hit)
            .groupBy("filter_id", "church_id").agg(F.sum("n").alias("n_events")))


# --- work lists and lookups --------------------------------------------------------------------

def has_coords() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def coords_in_range() -> Column:
    return F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)


def pending_provider(parish: DataFrame, limit: int | None = None) -> DataFrame:
    """Parishes without a provider, by id, optionally only the first ``limit``."""
    pending = parish.where(is_blank(F.col("bulletin_provider")))
    return pending.orderBy("id").limit(limit) if limit is not None else pending


def pending_process(latest: DataFrame) -> DataFrame:
    """Unprocessed rows of an already ranked latest-per-parish frame."""
    return latest.where(F.col("processed_at").isNull())


def by_parish_name(df: DataFrame, parish: DataFrame, name: str | None) -> DataFrame:
    """Rows of the one parish with that exact name; everything when no name is given."""
    if name is None:
        return df
    chosen = parish.where(F.col("name") == name).select(F.col("slug").alias("parish_slug"))
    return df.join(chosen, "parish_slug", "left_semi")


def fetch_source() -> Column:
    """Struct (provider, fetch_id) of a parish that can be fetched, else null."""
    provider = strip(F.coalesce("bulletin_provider", F.lit("")))
    ident = F.when(provider.isin(*NEEDS_ID), strip(F.col("provider_id"))).otherwise(strip(F.col("homepage_url")))
    return F.when(provider.isin(*PROVIDERS) & (F.coalesce(ident, F.lit("")) != ""),
                  F.struct(provider.alias("provider"), ident.alias("fetch_id")))


def page_cap(page_no: Column, max_pages: int) -> Column:
    """The first ``max_pages`` pages of a document (``MAX_PAGES`` is the customary cap)."""
    return page_no <= max_pages


def one_by_slug(church: DataFrame, slug: str) -> DataFrame:
    """The church with that slug."""
    return church.where(F.col("slug") == slug)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when a small lookup result is empty."""
    if df.isEmpty():
        raise LookupError(message)
    return df


def searchable_places(places: DataFrame) -> DataFrame:
    """Place-search results worth showing: id, title, subtitle, lat, lng, result_type."""
    kind = F.coalesce("result_type", F.lit("unknown"))
    title = F.when(F.col("result_type") == "postcode", F.coalesce("postcode", "formatted")).otherwise(
        F.coalesce("address_line1", "name", "formatted"))
    parts = F.concat_ws(", ", *[empty_to_null(F.col(c)) for c in ("city", "state", "postcode")])
    return (places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & kind.isin(*PLACE_TYPES))
            .select(F.coalesce("place_id", F.concat(F.col("lat").cast("string"), F.lit("-"),
                                                    F.col("lon").cast("string"), F.lit("-"), title)).alias("id"),
                    title.alias("title"),
                    empty_to_null(F.coalesce("address_line2", parts)).alias("subtitle"),
                    "lat", F.col("lon").alias("lng"), kind.alias("result_type"))
            .where(F.coalesce("title", F.lit("")) != ""))


def place_query_eligible(query: Column) -> Column:
    clean = strip(query)
    return clean.rlike(ZIP_LIKE) | (F.length(clean) >= 3)
