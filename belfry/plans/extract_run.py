"""Experimental extractor run: rebuild events of all latest documents from cached results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions.payload import guarded_result
from belfry.functions.text import cache_version
from belfry.operators import filters, latest
from belfry.plans.extractors import all_outcomes
from belfry.plans.process import cache_of, event_count, flatten, split_by_cache
from belfry.session import written
from belfry.sources.documents import work_items


@dataclass
class Run:
    events: DataFrame
    manifest: DataFrame
    errors: DataFrame
    summary: DataFrame
    new_results: DataFrame


def served_manifest(results: DataFrame) -> DataFrame:
    """Per served document: number of event rows (zero kept) and the wrong-document flag."""
    return results.select(F.col("source_url").alias("bulletin_source_url"), "pdf_path", "parish_slug",
                          "published_date", event_count().alias("event_count"),
                          F.coalesce("result.wrong_bulletin", F.lit(False)).alias("wrong_bulletin"))


def run_summary(statuses: DataFrame, manifest_rows: str = "event_count") -> DataFrame:
    """One row of totals from (status, event_count); an empty run gives zeros."""
    def n(*states: str):
        return F.count_if(F.col("status").isin(*states))

    return statuses.agg(
        F.count(F.lit(1)).alias("bulletins_total"), n("hit", "extracted").alias("bulletins_served"),
        n("hit").alias("cache_hits"), n("extracted").alias("cache_misses"), n("skipped").alias("skipped"),
        n("error").alias("errors"), F.coalesce(F.sum(manifest_rows), F.lit(0)).alias("events_written"))


def extract_run(metadata: DataFrame, parish: DataFrame, church: DataFrame, documents: DataFrame | str,
                cache: DataFrame, extractor, *, today: date, parish_name: str | None = None,
                parallelism: int | None = None) -> Run:
    """Run one extractor over every parish's latest document; production tables stay untouched."""
    carry = ["idx", "source_url", "pdf_path", "content_hash", "published_date"]
    candidates = filters.by_parish_name(latest.to_process(metadata, carry), parish, parish_name)
    hashed = F.coalesce("content_hash", F.lit("")) != ""
    hits, misses = split_by_cache(candidates.where(hashed), cache_of(cache, extractor.name, extractor.version))
    items = written(work_items(misses.select("idx", "parish_slug", "pdf_path"), parish, church, documents), "work-items")
    done = written(all_outcomes(items, documents, extractor, today, parallelism), "run-outcomes")
    fresh = done.where(F.col("status") == "extracted").select("idx", guarded_result(F.col("result_json")).alias("result"))
    columns = ["idx", "parish_slug", "source_url", "pdf_path", "published_date", "content_hash", "result", "status"]
    results = written(hits.withColumn("status", F.lit("hit")).select(*columns).unionByName(
        misses.join(fresh, "idx").withColumn("status", F.lit("extracted")).select(*columns)), "run-results")
    manifest = served_manifest(results)
    nothing = F.lit(None).cast("bigint")
    statuses = (results.select("status", event_count().alias("event_count"))
                .unionByName(candidates.where(~hashed).select(F.lit("skipped").alias("status"), nothing.alias("event_count")))
                .unionByName(done.where(F.col("status").isin("skipped", "error")).select("status", nothing.alias("event_count"))))
    errors = misses.join(done.where(F.col("status") == "error").select("idx", "error"), "idx").select("source_url", "error")
    version = cache_version(F.lit(extractor.version))
    new_results = results.where(F.col("status") == "extracted").select(
        F.lit(extractor.name).alias("classifier"), version.alias("version"), "content_hash", "result")
    named = F.lit(extractor.name).alias("classifier")
    summary = run_summary(statuses).select(named, F.lit(extractor.version).alias("classifier_version"), "*")
    return Run(flatten(results, ["idx"]).select("*", named), manifest.select("*", named), errors, summary, new_results)


def write_run(run: Run, root: str, name: str, ran_at: str, wall_seconds: float) -> None:
    """Events, manifest and summary of a run under ``root``, replacing that run's partitions only."""
    summary = run.summary.withColumn("ran_at", F.lit(ran_at)).withColumn("wall_seconds", F.lit(wall_seconds))
    for table, df in (("events", run.events), ("manifest", run.manifest), ("summary", summary)):
        df.drop("classifier").write.mode("overwrite").parquet(f"{root}/{table}/classifier={name}")
