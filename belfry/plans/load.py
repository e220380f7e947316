"""Raw files to the four typed tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from belfry.functions.dates import event_date_of_clean
from belfry.functions.text import blank_to_null, bound, strip
from belfry.functions.times import clean_time, minutes_of_clean
from belfry.operators import unique
from belfry.operators.quality import range_problem
from belfry.sources import versions


def load_parishes(raw: DataFrame, now: str) -> DataFrame:
    """Unique slug and unique homepage, first accepted wins; ids follow file order."""
    kept = unique.greedy_unique(raw, "slug", "homepage_url", ["name"])
    return kept.select((F.col("idx") + 1).alias("id"), "slug", "name", "homepage_url",
                       "bulletin_provider", "provider_id", F.lit(now).alias("created_at"))


def load_churches(raw: DataFrame, parish: DataFrame, now: str) -> DataFrame:
    """Churches of known parishes, unique slug, first wins."""
    known = parish.select(F.col("slug").alias("parish_slug"), F.col("id").alias("parish_id"))
    kept = unique.first_wins(raw.join(known, "parish_slug").where(F.col("name").isNotNull()), ["slug"])
    return kept.select((F.col("idx") + 1).alias("id"), "parish_id", "slug", "name", "address_line1",
                       "address_line2", "city", "state", "postal_code", "latitude", "longitude",
                       "name_verified", "address_verified", F.lit(now).alias("created_at"))


def load_bulletins(metadata: DataFrame, parish: DataFrame) -> DataFrame:
    """Bulletins of known parishes, unique (parish, URL) with null URLs never in conflict."""
    known = parish.select(F.col("slug").alias("parish_slug"), F.col("id").alias("parish_id"))
    kept = unique.first_wins_null_free(metadata.join(known, "parish_slug"), ["parish_id", "source_url"], "source_url")
    return kept.select((F.col("idx") + 1).alias("id"), "parish_id", "source_url", "pdf_path",
                       "published_date", "fetched_at", "processed_at", "content_hash")


def load_reason(church_id: Column) -> Column:
    """Why a raw event row cannot be loaded, null when it can.

    Expects ``start_minutes``, ``end_minutes`` and ``iso_date`` next to the raw columns.
    """
    dated = F.col("event_kind") == "specific_date"
    return (F.when(F.coalesce("church_slug", F.lit("")) == "", "no church slug")
            .when(church_id.isNull(), "unknown church")
            .when(F.col("start_minutes").isNull(), "unreadable start_time")
            .when(dated & F.col("iso_date").isNull(), "unreadable date")
            .otherwise(range_problem(F.col("start_minutes"), F.col("end_minutes"), F.lit(0))))


def typed_events(raw: DataFrame, church: DataFrame, bulletin: DataFrame) -> DataFrame:
    """Every raw row with its typed columns and ``reason`` (null = loadable).

    The bulletin is looked up under the church's own parish; no match leaves it null.
    """
    places = church.select(F.col("slug").alias("church_slug"), F.col("id").alias("church_id"), "parish_id")
    issues = bulletin.where(F.col("source_url").isNotNull()).select(
        "parish_id", F.col("source_url").alias("bulletin_source_url"), F.col("id").alias("bulletin_id"))
    # cleaned text becomes columns first: the parsers mention it many times
    clean = raw.withColumns({"start_time": clean_time(F.col("start_time")), "end_time": clean_time(F.col("end_time")),
                             "date": strip(F.col("date"))})
    typed = bound(clean, read=F.struct(minutes_of_clean(F.col("start_time")).alias("start_minutes"),
                                       minutes_of_clean(F.col("end_time")).alias("end_minutes"),
                                       event_date_of_clean(F.col("date")).alias("iso_date")))
    typed = typed.withColumn("event_kind", F.coalesce("event_kind", F.lit(""))).select(
        "idx", "church_slug", "bulletin_source_url", "event_type", "event_kind", "day_of_week", "cancelled", "page_number", "note", "read.*")
    joined = typed.join(places, "church_slug", "left").join(issues, ["parish_id", "bulletin_source_url"], "left")
    dated = F.col("event_kind") == "specific_date"
    return joined.select(
        "idx", "church_slug", "church_id", "bulletin_id", F.coalesce("event_type", F.lit("")).alias("event_type"),
        "event_kind", "day_of_week", F.when(dated, F.col("iso_date")).alias("date"),
        F.col("start_minutes").alias("start_time"), F.col("end_minutes").alias("end_time"),
        F.coalesce(F.col("cancelled").cast("int"), F.lit(0)).alias("cancelled"), "page_number",
        blank_to_null(F.col("note")).alias("note"), load_reason(F.col("church_id")).alias("reason"))


def load_events(raw: DataFrame, church: DataFrame, bulletin: DataFrame,
                strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(event rows, quarantined rows with reason).

    With ``strict`` a row that violates a range rule fails the job, as the table's own
    check would.
    """
    typed = typed_events(raw, church, bulletin)
    if strict:
        bad = F.col("reason").endswith("out of range")
        typed = typed.withColumn("reason", F.when(
            bad, F.raise_error(F.concat(F.lit("event "), F.col("idx").cast("string"), F.lit(": "), F.col("reason")))
        ).otherwise(F.col("reason")))
    good = typed.where(F.col("reason").isNull()).drop("reason", "church_slug").withColumnRenamed("idx", "id")
    return good, typed.where(F.col("reason").isNotNull()).select("idx", "church_slug", "reason")


def rebuild_tables(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Replace all tables under ``root`` at once; (table, n) counts of what was written.

    Every table goes to a directory of its own, then one commit names them all: a reader never
    meets tables of two rebuilds, and a rebuild that fails changes nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    number = versions.latest(spark, root)[0]
    dirs = {name: versions.fresh(name) for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{dirs[name]}")
    schemas = {name: df.schema.json() for name, df in tables.items()}
    versions.commit(spark, root, {"tables": dirs, "schemas": schemas}, number)
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")) for name, df in open_tables(spark, root).items()]
    return reduce(DataFrame.unionByName, counts)


def open_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest rebuild."""
    content = versions.latest(spark, root)[1]
    if not content:
        raise FileNotFoundError(f"No tables under {root}")
    return {name: spark.read.schema(StructType.fromJson(json.loads(content["schemas"][name]))).parquet(f"{root}/{at}")
            for name, at in content["tables"].items()}


def table_counts(attempted_parishes: DataFrame, church: DataFrame, bulletin: DataFrame, event: DataFrame) -> DataFrame:
    """Loader counts: parishes count attempted rows, the other tables count stored rows."""
    frames = {"parishes": attempted_parishes, "churches": church, "bulletins": bulletin, "events": event}
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["load_bulletins", "load_churches", "load_events", "load_parishes",
           "open_tables", "rebuild_tables", "table_counts", "typed_events"]
