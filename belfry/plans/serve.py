"""Map, search and church-page queries over a published snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belfry.functions.dates import SUNDAY_FIRST, next_occurrence, schedule_key
from belfry.operators import filters
from belfry.schemas import EVENT_TYPES

# Fixed value: popup length when a church has dated events only.
SOONEST = 5
CHURCH_FIELDS = ["id", "parish_id", "slug", "name", "address_line1", "address_line2", "city", "state",
                 "postal_code", "latitude", "longitude"]


def with_occurrence(events: DataFrame, today: Column, zone: str = "UTC") -> DataFrame:
    c = F.col
    return events.withColumn("next_occurrence", next_occurrence(
        c("event_kind"), c("day_of_week"), c("date"), c("start_time"), c("cancelled"), today, zone))


def sort_key() -> Column:
    return schedule_key(F.col("event_kind"), F.col("day_of_week"), F.col("date"), F.col("start_time"))


def event_summary() -> list[Column]:
    """Public fields of an event that already has ``next_occurrence``."""
    return [F.col("id"), F.col("event_type").alias("type"), F.col("event_kind").alias("kind"),
            F.col("day_of_week"), F.col("date"), F.col("start_time"), F.col("end_time"),
            (F.col("cancelled") == 1).alias("cancelled"), F.col("next_occurrence"), F.col("page_number"), F.col("note")]


def matching_events(event: DataFrame, types: list[str], days: list[int], time_from: int | None,
                    time_to: int | None) -> DataFrame:
    return event.where(filters.of_types(types) & filters.event_matches(days, time_from, time_to))


def popup_weekly(events: DataFrame) -> DataFrame:
    """First event (by id) per church, weekday and start among weekly rows; spans event types."""
    weekly = events.where((F.col("event_kind") == "weekly") & (F.col("day_of_week") != ""))
    rest = [c for c in events.columns if c not in ("church_id", "start_time")]
    first = F.min_by(F.struct(*rest), "id").alias("w")
    return (weekly.groupBy("church_id", F.lower("day_of_week").alias("day"), "start_time").agg(first)
            .select("church_id", "start_time", "w.*").select(*events.columns))


def popup_soonest(events: DataFrame, n: int = SOONEST) -> DataFrame:
    """The ``n`` earliest occurrences per church, earlier id first on ties; needs ``next_occurrence``."""
    order = Window.partitionBy("church_id").orderBy("next_occurrence", "id")
    return (events.where(F.col("next_occurrence").isNotNull())
            .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn"))


def popup_events(events: DataFrame, today: Column, zone: str = "UTC") -> DataFrame:
    """Popup rows of every church: its weekly rows, or the soonest dated ones when it has none.

    Both branches are small per church (distinct weekly slots, or five rows).
    """
    weekly = popup_weekly(events)
    soonest = popup_soonest(with_occurrence(events, today, zone))
    fallback = soonest.join(weekly.select("church_id").distinct(), "church_id", "left_anti")
    return with_occurrence(weekly, today, zone).withColumn("rank_key", sort_key()).unionByName(
        fallback.withColumn("rank_key", F.struct(
            F.lit(0).alias("group"), F.lit(0).alias("key"), F.col("next_occurrence").alias("date"),
            F.lit(0).alias("start"))))


def map_query(church: DataFrame, event: DataFrame, today: Column, *, types: list[str] | None = None,
              days: list[int] | None = None, time_from: int | None = None, time_to: int | None = None,
              zone: str = "UTC") -> DataFrame:
    """Churches with at least one matching event: fields, event_types and the popup schedule."""
    hits = matching_events(event, types or [], days or [], time_from, time_to)
    kinds = hits.groupBy("church_id").agg(F.array_sort(F.collect_set("event_type")).alias("event_types"))
    entry = F.struct("rank_key", *event_summary())
    popup = popup_events(hits, today, zone).groupBy("church_id").agg(
        F.array_sort(F.collect_list(entry)).alias("upcoming_events"))
    return (church.select(*CHURCH_FIELDS).join(kinds.withColumnRenamed("church_id", "id"), "id")
            .join(popup.withColumnRenamed("church_id", "id"), "id", "left")
            .withColumn("upcoming_events", F.coalesce(
                F.transform("upcoming_events", lambda e: e.dropFields("rank_key")),
                F.array().cast("array<struct<id:bigint,type:string,kind:string,day_of_week:string,date:string,"
                               "start_time:int,end_time:int,cancelled:boolean,next_occurrence:string,"
                               "page_number:int,note:string>>"))))


def church_for_search(church: DataFrame) -> DataFrame:
    """Churches with coordinates by name."""
    return church.select(*CHURCH_FIELDS).where(filters.has_coords()).orderBy("name", "id")


def church_detail(church: DataFrame, slug: str) -> DataFrame:
    """The one church with that slug; an unknown slug is an error."""
    return filters.require_rows(filters.one_by_slug(church, slug), f"Church not found: {slug}")


def upcoming(event: DataFrame, today: Column, types: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """Events with a next occurrence, with ``rank_key`` for church-week order."""
    rows = with_occurrence(event.where(filters.of_types(types or [])), today, zone)
    return rows.where(F.col("next_occurrence").isNotNull()).withColumn("rank_key", sort_key())


def church_events(church: DataFrame, event: DataFrame, slug: str, today: Column,
                  types: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """Public event rows of one church in schedule order."""
    mine = event.join(filters.one_by_slug(church, slug).select(F.col("id").alias("church_id")), "church_id")
    return upcoming(mine, today, types, zone).orderBy("rank_key", "id").select(*event_summary())


def church_page(church: DataFrame, event: DataFrame, slug: str, today: Column) -> tuple[DataFrame, DataFrame]:
    return church_detail(church, slug), church_events(church, event, slug, today)


def partition_by_type_day(events: DataFrame) -> DataFrame:
    """Public event rows with their page section: weekday name, or ``specific_date``.

    Weekly rows with an unknown weekday belong to no section and vanish; everything that
    is not weekly-with-weekday is dated.  Sort each section by (sort_date, sort_start, id).
    """
    weekly = F.coalesce((F.col("event_kind") == "weekly") & (F.col("day_of_week") != ""), F.lit(False))
    section = F.when(weekly, F.lower("day_of_week")).otherwise("specific_date")
    return (events.withColumn("section", section)
            .where(F.col("section").isin(*SUNDAY_FIRST, "specific_date") & F.col("event_type").isin(*EVENT_TYPES))
            .withColumn("sort_date", F.when(weekly, "").otherwise(F.coalesce("date", F.lit(""))))
            .withColumn("sort_start", F.when(weekly, F.col("start_time")).otherwise(0)))
