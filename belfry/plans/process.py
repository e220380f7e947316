"""Process stage: pending documents -> cached or fresh extraction -> merged events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belfry.functions.payload import guarded_result
from belfry.functions.text import cache_version, is_blank
from belfry.operators import filters, latest
from belfry.operators.keyfilter import MANY_BITS, likely
from belfry.plans.extractors import all_outcomes
from belfry.session import written
from belfry.sources.documents import work_items


def compact(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """Keep the rows whose document is some parish's shown document (null URL matches null)."""
    keep = latest.to_show(metadata, ["source_url"]).select(F.col("source_url").alias("keep_url")).distinct()
    events = likely(events, keep, "bulletin_source_url", "keep_url", MANY_BITS)  # rows of other documents never move
    return events.join(keep, F.col("bulletin_source_url").eqNullSafe(F.col("keep_url")), "left_semi")


def flatten(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Result structs to raw event rows; documents flagged as the wrong bulletin give none."""
    rows = results.where(~F.coalesce("result.wrong_bulletin", F.lit(False))).select(
        *(keep or []), F.col("source_url").alias("bulletin_source_url"), F.explode("result.events").alias("e"))
    return rows.where(F.col("e.church_slug").isNotNull()).select(
        *(keep or []), "e.church_slug", "bulletin_source_url", F.col("e.type").alias("event_type"),
        F.col("e.kind").alias("event_kind"), "e.day_of_week", "e.date", "e.start_time", "e.end_time",
        "e.cancelled", "e.page_number", "e.note")


def event_count() -> Column:
    """Rows a result struct contributes; none when it is the wrong document."""
    rows = F.size(F.filter("result.events", lambda e: e["church_slug"].isNotNull()))
    return F.when(F.coalesce("result.wrong_bulletin", F.lit(False)), 0).otherwise(rows).cast("bigint")


def cache_of(cache: DataFrame, name: str, version: str) -> DataFrame:
    """(content_hash, result) of one extractor version; both columns are partition columns."""
    return cache.where((F.col("classifier") == name) & (F.col("version") == cache_version(F.lit(version)))).select(
        "content_hash", "result")


def split_by_cache(entries: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with result, misses); rows without a hash never hit."""
    return (entries.join(cached, "content_hash"),
            entries.join(cached.select("content_hash"), "content_hash", "left_anti"))


def merge_metadata(metadata: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Mark processed documents; a published date found by the extractor replaces the old one.

    ``results``: idx, result.  Documents flagged as wrong are marked too.
    """
    found = results.select("idx", F.lit(True).alias("done"), F.col("result.published_date").alias("found_date"))
    usable = F.when(~is_blank(F.col("found_date")), F.col("found_date"))
    return (metadata.join(found, "idx", "left")
            .withColumn("published_date", F.coalesce(usable, "published_date"))
            .withColumn("processed_at", F.when(F.col("done"), F.lit(now)).otherwise(F.col("processed_at")))
            .drop("done", "found_date"))


def needs_review(results: DataFrame) -> DataFrame:
    """Parishes whose extraction asks for a look at the church list."""
    return results.where("result.church_list_needs_review").select("parish_slug").distinct()


@dataclass
class Processed:
    metadata: DataFrame
    events: DataFrame
    new_results: DataFrame
    outcomes: DataFrame
    review: DataFrame
    summary: DataFrame


def process_bulletins(metadata: DataFrame, events: DataFrame, parish: DataFrame, church: DataFrame,
                      documents: DataFrame | str, cache: DataFrame, extractor, *, now: str, today: date,
                      parish_name: str | None = None, parallelism: int | None = None) -> Processed:
    """Extract every parish's latest pending document and merge the result.

    Extractor outcomes are written once before anything is derived from them: they are
    expensive and need not be repeatable.
    """
    carry = ["idx", "source_url", "pdf_path", "content_hash", "processed_at"]
    pending = filters.pending_process(latest.to_process(metadata, carry))
    pending = filters.by_parish_name(pending, parish, parish_name)
    hits, misses = split_by_cache(pending, cache_of(cache, extractor.name, extractor.version))
    items = written(work_items(misses.select("idx", "parish_slug", "pdf_path"), parish, church, documents), "work-items")
    done = written(all_outcomes(items, documents, extractor, today, parallelism), "outcomes")
    fresh = done.where(F.col("status") == "extracted").select("idx", guarded_result(F.col("result_json")).alias("result"))
    fresh = misses.join(fresh, "idx").select("idx", "parish_slug", "source_url", "content_hash", "result")
    results = written(hits.select("idx", "parish_slug", "source_url", "content_hash", "result", F.lit(True).alias("hit"))
                      .unionByName(fresh.withColumn("hit", F.lit(False))), "results")
    merged = merge_metadata(metadata, results, now)
    rows = flatten(results)
    kept = compact(compact(events, metadata).unionByName(rows), merged)
    version = cache_version(F.lit(extractor.version))
    new_results = results.where(~F.col("hit") & (F.col("content_hash") != "")).select(
        F.lit(extractor.name).alias("classifier"), version.alias("version"), "content_hash", "result")
    return Processed(merged, kept, new_results, done, needs_review(results), process_summary(results))


def process_summary(results: DataFrame) -> DataFrame:
    """processed_bulletins, inserted_events, cache_hits; one zero row for an empty run."""
    return results.agg(F.count(F.lit(1)).alias("processed_bulletins"),
                       F.coalesce(F.sum(event_count()), F.lit(0)).alias("inserted_events"),
                       F.count_if("hit").alias("cache_hits"))
