"""Extractor runs: three tables partitioned by ``classifier``, or JSON documents of one directory per run.

JSON documents are read as VARIANT: a value of another type than its field's counts as missing, elements that
are no objects are passed over, and a manifest or summary that does not parse is ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.functions.payload import as_map, int_of, items_of, text_of, truthy
from belfry.functions.text import bound
from belfry.schemas import METADATA, RAW_EVENT
from belfry.sources.files import path_exists, read_or_empty, variant_rows

EVENTS = f"idx bigint, {RAW_EVENT}, classifier string"
MANIFEST = ("bulletin_source_url string, pdf_path string, parish_slug string, published_date string, "
            "event_count bigint, wrong_bulletin boolean, classifier string")
SUMMARY = ("classifier_version string, ran_at string, bulletins_total bigint, bulletins_served bigint, "
           "cache_hits bigint, cache_misses bigint, skipped bigint, errors bigint, events_written bigint, "
           "wall_seconds double, classifier string")


def read_runs(spark: SparkSession, root: str, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, manifest, summaries) of the named runs.

    A run without an events table is an error; manifest and summary may be absent.  Rows
    without a document URL are dropped.
    """
    missing = [n for n in names if not path_exists(spark, f"{root}/events/classifier={n}")]
    if missing:
        raise FileNotFoundError(f"No events for classifier(s) {missing} under {root}; run the extraction first")
    chosen = F.col("classifier").isin(*names)
    events, manifest, summary = [read_or_empty(spark, f"{root}/{t}", s).where(chosen) for t, s in (
        ("events", EVENTS), ("manifest", MANIFEST), ("summary", SUMMARY))]
    named = F.col("bulletin_source_url").isNotNull()
    return events.where(named), manifest.where(named), summary


def _as_text(v: Column) -> Column:
    """Text as it is, numbers and booleans spelled out."""
    return F.coalesce(text_of(v), F.try_variant_get(v, "$", "string"))


def _field(name: str) -> Column:
    """A field of the object ``v``; null where it has none, and of values that are no objects."""
    return F.try_variant_get(F.col("v"), f"$.{name}", "variant")


def _text_fields(*names: str) -> list[Column]:
    return [text_of(_field(n)).alias(n) for n in names]


def _document(spark: SparkSession, root: str, name: str, stem: str) -> DataFrame | None:
    """Values of ``stem``.json, or of ``stem``.jsonl; None where there is neither."""
    path = next((p for p in (f"{root}/{name}/{stem}.json", f"{root}/{name}/{stem}.jsonl") if path_exists(spark, p)), None)
    return path and variant_rows(spark, path)


def metadata_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata of a JSON file in its order; entries without a text URL are passed over."""
    names = [c.split(" ")[0] for c in METADATA.split(", ")][1:]
    return variant_rows(spark, path).select("idx", *_text_fields(*names)).where("source_url is not null")


def read_run_documents(spark: SparkSession, root: str, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, manifest, summaries) of runs stored as events, bulletins and run documents, as :func:`read_runs` gives them.

    A manifest entry names its document by ``bulletin_source_url``, or else by ``source_url``.
    """
    found = {n: _document(spark, root, n, "events") for n in names}
    missing = [n for n in names if found[n] is None]
    if missing:
        raise FileNotFoundError(f"No events for classifier(s) {missing} under {root}; run the extraction first")
    empty = {kind: spark.createDataFrame([], schema) for kind, schema in (("events", EVENTS), ("manifest", MANIFEST), ("summary", SUMMARY))}
    events, manifests, summaries = [empty["events"]], [empty["manifest"]], [empty["summary"]]
    for name in names:
        run = F.lit(name).alias("classifier")
        rows = bound(found[name], bulletin_source_url=text_of(_field("bulletin_source_url"))).select(
            "idx", "bulletin_source_url", *[_as_text(_field(c)).alias(c) for c in ("church_slug", "event_type", "event_kind", "start_time")],
            *_text_fields("day_of_week", "date", "end_time", "note"),
            truthy(_field("cancelled")).alias("cancelled"), int_of(_field("page_number")).alias("page_number"), run)
        events.append(rows.where("bulletin_source_url is not null").select(*empty["events"].columns))
        listed = _document(spark, root, name, "bulletins")
        if listed is not None:
            first = _field("bulletin_source_url")
            url = F.when(truthy(first), text_of(first)).otherwise(text_of(_field("source_url")))
            rows = bound(listed, bulletin_source_url=url).select("bulletin_source_url", *_text_fields("pdf_path", "parish_slug", "published_date"),
                                           int_of(_field("event_count")).cast("bigint").alias("event_count"), truthy(_field("wrong_bulletin")).alias("wrong_bulletin"), run)
            manifests.append(rows.where("bulletin_source_url is not null").select(*empty["manifest"].columns))
        path = f"{root}/{name}/run.json"
        if path_exists(spark, path):
            whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where(as_map(F.col("v")).isNotNull())
            counts = ["bulletins_total", "bulletins_served", "cache_hits", "cache_misses", "skipped", "events_written"]
            errors = F.coalesce(int_of(_field("errors")).cast("bigint"), F.size(items_of(_field("errors"))).cast("bigint"))
            rows = whole.select(*_text_fields("classifier_version", "ran_at"), *[int_of(_field(c)).cast("bigint").alias(c) for c in counts],
                                errors.alias("errors"), F.try_variant_get(_field("wall_seconds"), "$", "double").alias("wall_seconds"), run)
            summaries.append(rows.select(*empty["summary"].columns))
    return tuple(reduce(DataFrame.unionByName, frames) for frames in (events, manifests, summaries))
