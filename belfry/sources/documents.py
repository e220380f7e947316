"""Document bytes: content-addressed storage and work items for the extractors.

A store is a table (path, content) clustered by path, or a folder of files.  Work items are settled on
paths alone, so contents are read only for what will be extracted: the clustered table meets its work items
bucket by bucket, without moving contents; from a folder only the files asked for are opened.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.functions.text import format_address
from belfry.operators.keyfilter import likely

BUCKETS = 64
SLICE = 50_000  # files opened by one scan of a folder; their work items are broadcast to it
MISSING, UNREADABLE, UNKNOWN = "document missing", "document unreadable", "unknown parish"


def open_store(spark: SparkSession, location: str, buckets: int = BUCKETS) -> DataFrame:
    """The clustered table at ``location`` (made where there is none)."""
    name = "store_" + hashlib.md5(f"{location} {buckets}".encode()).hexdigest()
    spark.sql(f"create table if not exists {name} (path string, content binary) using parquet "
              f"clustered by (path) into {buckets} buckets location '{location}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def add_to_store(blobs: DataFrame, location: str, buckets: int = BUCKETS) -> DataFrame:
    """Append (path, content) rows: one move of the new contents, one file per bucket."""
    store = open_store(blobs.sparkSession, location, buckets)
    name = "store_" + hashlib.md5(f"{location} {buckets}".encode()).hexdigest()
    blobs.select("path", "content").repartition(buckets, "path").write.insertInto(name)
    return store


def _binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(paths))


def _root(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def paths_of(spark: SparkSession, documents: DataFrame | str) -> DataFrame:
    """The paths of a store; contents are not read.  Paths of a folder start at the folder."""
    if isinstance(documents, str):
        root = _root(spark, documents)
        return _binary(spark, documents).select(F.substr("path", F.lit(len(root) + 1)).alias("path"))
    return documents.select("path").distinct()


def _from_folder(ready: DataFrame, folder: str) -> DataFrame:
    """Ready items with the contents of their files.

    Spark lists a folder's files on the driver, so the paths asked for (a part of them) may be there, too.
    """
    spark = ready.sparkSession
    root = _root(spark, folder)
    asked = sorted(r["pdf_path"] for r in ready.select("pdf_path").distinct().collect())
    parts = []
    for low in range(0, len(asked), SLICE):
        some = asked[low:low + SLICE]
        files = _binary(spark, [root + re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in some])
        items = ready.where((F.col("pdf_path") >= some[0]) & (F.col("pdf_path") <= some[-1]))
        held = files.select(F.substr("path", F.lit(len(root) + 1)).alias("pdf_path"), "content")
        parts.append(held.join(F.broadcast(items), "pdf_path"))
    empty = ready.withColumn("content", F.lit(None).cast("binary")).limit(0)
    return reduce(DataFrame.unionByName, parts, empty)


def with_content(items: DataFrame, documents: DataFrame | str) -> DataFrame:
    """The ready items with ``content``; items whose document cannot be read any more are left out or have null."""
    ready = items.where(F.col("status") == "ready")
    if isinstance(documents, str):
        return _from_folder(ready, documents)
    wanted = likely(documents.select("path", "content"), ready, "path", "pdf_path")
    # the narrow side is hashed: contents are neither sorted nor, in a clustered store, moved
    return wanted.join(ready.hint("shuffle_hash"), F.col("path") == F.col("pdf_path")).drop("path")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def church_list(church: DataFrame) -> DataFrame:
    """(parish_id, churches): array of (id, slug, name, address) structs by id."""
    address = format_address(*[F.col(c) for c in (
        "address_line1", "address_line2", "city", "state", "postal_code")])
    entry = F.struct("id", "slug", "name", address.alias("address"))
    return church.groupBy("parish_id").agg(F.array_sort(F.collect_list(entry)).alias("churches"))


def churches_json(churches: Column) -> Column:
    """The church list as extractors receive it."""
    plain = F.transform(churches, lambda c: F.struct(c["slug"].alias("slug"), c["name"].alias("name"),
                                                     c["address"].alias("address")))
    return F.to_json(F.coalesce(plain, F.array().cast("array<struct<slug:string,name:string,address:string>>")))


def work_items(entries: DataFrame, parish: DataFrame, church: DataFrame, documents: DataFrame | str) -> DataFrame:
    """Entries plus parish_id, churches_json and a status: ready, or skipped with the reason.

    ``documents`` is a table (path, content) or a folder; only its paths are looked at.
    """
    known = parish.select(F.col("slug").alias("parish_slug"), F.col("id").alias("parish_id"))
    there = paths_of(entries.sparkSession, documents).select(F.col("path").alias("pdf_path"), F.lit(True).alias("there"))
    joined = (entries.join(known, "parish_slug", "left")
              .join(church_list(church), "parish_id", "left").join(there, "pdf_path", "left"))
    reason = F.when(F.col("there").isNull(), MISSING).when(F.col("parish_id").isNull(), UNKNOWN)
    return (joined.withColumn("churches_json", churches_json(F.col("churches"))).withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason").isNull(), "ready").otherwise("skipped"))
            .drop("churches", "there"))


def prompt(template: str, churches: Column, today: Column) -> Column:
    """Request text: ``{churches_json}``, ``{today_iso}`` and ``{today_day_of_week}`` filled in."""
    text = F.lit(template)
    for name, value in (("churches_json", churches), ("today_iso", today.cast("string")),
                        ("today_day_of_week", F.date_format(today, "EEEE"))):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def store_documents(fetched: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new blobs, metadata rows) for fetched documents.

    ``fetched``: parish_slug, source_url (no two alike), content, fetched_at.  A blob is kept once per
    parish and hash; ``stored`` holds the paths already there.
    """
    digest = content_hash(F.col("content"))
    placed = fetched.withColumn("content_hash", digest).withColumn(
        "pdf_path", F.concat(F.lit("/"), F.col("parish_slug"), F.lit("/"), F.col("content_hash"), F.lit(".pdf")))
    # which row hands its bytes over is settled on paths and URLs; contents move once, to the store's buckets
    first = (placed.groupBy(F.col("pdf_path").alias("path")).agg(F.min("source_url").alias("first_url"))
             .join(stored.select("path"), "path", "left_anti"))
    held = placed.select(F.col("pdf_path").alias("path"), "source_url", "content").repartition(BUCKETS, "path")
    blobs = (held.join(first.hint("shuffle_hash"), "path").where(F.col("source_url").eqNullSafe(F.col("first_url")))
             .select("path", "content"))
    nothing = F.lit(None).cast("string")
    rows = placed.select("parish_slug", "source_url", "pdf_path", "content_hash", "fetched_at",
                         nothing.alias("processed_at"), nothing.alias("published_date"))
    return blobs, rows
