"""Published snapshot: the newest bulletin's events per parish, and the gate in front of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.operators import latest
from belfry.operators.keyfilter import MANY_BITS, likely
from belfry.sources.files import path_exists, read_or_empty

# Gate thresholds in percent.
MAX_EVENT_DELTA = 10.0
MIN_WEEKLY_MATCH = 90.0

CHURCH_COLUMNS = ["id", "parish_id", "slug", "name", "address_line1", "address_line2", "city", "state",
                  "postal_code", "latitude", "longitude"]
EVENT_COLUMNS = ["id", "church_id", "event_type", "event_kind", "day_of_week", "date", "start_time",
                 "end_time", "cancelled", "page_number", "note"]


def snapshot_church(church: DataFrame, parish: DataFrame, bulletin: DataFrame) -> DataFrame:
    """Churches with their parish's homepage and newest bulletin URL."""
    homes = parish.select(F.col("id").alias("parish_id"), "homepage_url")
    return (church.select(*CHURCH_COLUMNS)
            .join(homes, "parish_id", "left")
            .join(latest.url_for_snapshot(bulletin), "parish_id", "left")
            .select(*CHURCH_COLUMNS, "homepage_url", "bulletin_url"))


def snapshot_event(event: DataFrame, bulletin: DataFrame) -> DataFrame:
    """Events of each parish's newest bulletin; events without a bulletin are not published."""
    shown = latest.for_snapshot(bulletin).select(F.col("id").alias("bulletin_id"))
    return likely(event, shown, "bulletin_id", size=MANY_BITS).join(shown, "bulletin_id").select(*EVENT_COLUMNS)


def weekly_keys(event: DataFrame) -> DataFrame:
    """Distinct (church, type, weekday or empty, start) of the weekly rows."""
    return event.where(F.lower("event_kind") == "weekly").select(
        "church_id", "event_type", F.coalesce("day_of_week", F.lit("")).alias("day_of_week"),
        "start_time").distinct()


def gate_counts(cur_church, cur_event, prev_church, prev_event) -> DataFrame:
    """One row of counts over both snapshots; the weekly keys are compared in one pass."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")

    both = weekly_keys(cur_event).withColumn("cur", F.lit(1)).withColumn("prev", F.lit(0)).unionByName(
        weekly_keys(prev_event).withColumn("cur", F.lit(0)).withColumn("prev", F.lit(1)))
    keys = both.groupBy("church_id", "event_type", "day_of_week", "start_time").agg(
        F.max("cur").alias("cur"), F.max("prev").alias("prev"))
    weekly = keys.agg(
        F.coalesce(F.sum("cur"), F.lit(0)).alias("weekly_current"),
        F.coalesce(F.sum("prev"), F.lit(0)).alias("weekly_previous"),
        F.coalesce(F.sum(F.col("cur") * F.col("prev")), F.lit(0)).alias("weekly_matching"))
    weekly = weekly.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in weekly.columns])).alias("m")).select("m.*")
    metrics = (rows(cur_church, "churches_current").unionByName(rows(prev_church, "churches_previous"))
               .unionByName(rows(cur_event, "events_current")).unionByName(rows(prev_event, "events_previous"))
               .unionByName(weekly))
    names = ["churches_current", "churches_previous", "events_current", "events_previous",
             "weekly_current", "weekly_previous", "weekly_matching"]
    return metrics.agg(*[F.max(F.when(F.col("metric") == n, F.col("n"))).alias(n) for n in names])


def gate(cur_church, cur_event, prev_church, prev_event) -> DataFrame:
    """Counts, percentages and pass flags in one row; ``passed`` decides the publication."""
    cur, prev = F.col("events_current"), F.col("events_previous")
    delta = F.when(prev > 0, F.abs(cur - prev) / F.nullif(prev, F.lit(0)) * 100.0).otherwise(
        F.when(cur == 0, 0.0).otherwise(100.0))
    w_cur, w_prev = F.col("weekly_current"), F.col("weekly_previous")
    match = F.when(w_prev > 0, F.col("weekly_matching") / F.nullif(w_prev, F.lit(0)) * 100.0).otherwise(
        F.when(w_cur == 0, 100.0).otherwise(0.0))
    return (gate_counts(cur_church, cur_event, prev_church, prev_event)
            .withColumn("event_delta_pct", delta).withColumn("weekly_match_pct", match)
            .withColumn("churches_passed", F.col("churches_current") == F.col("churches_previous"))
            .withColumn("events_passed", F.col("event_delta_pct") <= MAX_EVENT_DELTA)
            .withColumn("weekly_passed", F.col("weekly_match_pct") >= MIN_WEEKLY_MATCH)
            .withColumn("passed", F.col("churches_passed") & F.col("events_passed") & F.col("weekly_passed")))


# --- versions on storage -------------------------------------------------------------------------
# A version directory is complete before anyone is told about it; publishing appends one row to
# the ``published`` table, so readers always see a whole snapshot.

PUBLISHED = "version bigint, published_at string"


def version_dir(root: str, version: int) -> str:
    return f"{root}/v={version}"


def write_version(church: DataFrame, event: DataFrame, root: str, version: int) -> None:
    church.write.mode("overwrite").parquet(f"{version_dir(root, version)}/church")
    event.write.mode("overwrite").parquet(f"{version_dir(root, version)}/event")


def publish(spark: SparkSession, root: str, version: int, now: str) -> None:
    spark.createDataFrame([(version, now)], PUBLISHED).write.mode("append").parquet(f"{root}/published")


def published_versions(spark: SparkSession, root: str) -> list[int]:
    """The two newest published versions, newest first."""
    rows = (read_or_empty(spark, f"{root}/published", PUBLISHED)
            .groupBy("version").agg(F.max("published_at")).orderBy(F.desc("version")).limit(2).collect())
    return [r["version"] for r in rows]


def read_version(spark: SparkSession, root: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(church, event) of a stored version; a version that was never written is an error."""
    base = version_dir(root, version)
    if not path_exists(spark, f"{base}/church/_SUCCESS") or not path_exists(spark, f"{base}/event/_SUCCESS"):
        raise FileNotFoundError(f"Snapshot not found: {base}")
    return spark.read.parquet(f"{base}/church"), spark.read.parquet(f"{base}/event")


def gate_versions(spark: SparkSession, root: str, current: int, previous: int) -> dict:
    """Gate result as a dictionary; a missing snapshot is a failed gate with a message."""
    try:
        frames = [*read_version(spark, root, current), *read_version(spark, root, previous)]
    except FileNotFoundError as err:
        return {"passed": False, "errors": [str(err)]}
    return {**gate(*frames).first().asDict(), "errors": []}


def refresh(church: DataFrame, parish: DataFrame, bulletin: DataFrame, event: DataFrame,
            root: str, now: str) -> dict:
    """Write the next version, gate it against the published one, publish only when it passes."""
    spark = church.sparkSession
    shown = published_versions(spark, root)
    version = (shown[0] if shown else 0) + 1
    write_version(snapshot_church(church, parish, bulletin), snapshot_event(event, bulletin), root, version)
    result = gate_versions(spark, root, version, shown[0]) if shown else {"passed": True, "errors": []}
    if result["passed"]:
        publish(spark, root, version, now)
    return {"version": version, **result}
