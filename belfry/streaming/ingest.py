"""Incremental variants of the batch jobs as micro-batch streams.

State is found by data, never by batch number: winners and events are logs whose newest manifest names what
counts, cached results lie in the bucket of their hash.  A batch that is replayed, or a stream that starts over
with a new checkpoint, meets what is there already and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from belfry.operators import latest
from belfry.operators.keyfilter import MANY_BITS, likely
from belfry.plans import snapshot
from belfry.session import written
from belfry.sources import versions
from belfry.sources.files import read_or_empty


def new_urls(stream: DataFrame) -> DataFrame:
    """First-seen source URLs only; rows without a URL never conflict.

    URLs are known forever, so the keyed state has no watermark.
    """
    named = stream.where(F.col("source_url").isNotNull()).dropDuplicates(["source_url"])
    return named.unionByName(stream.where(F.col("source_url").isNull()))


def start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything available in micro-batches, then stop."""
    return (df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- logs: one directory per batch, folded level by level ---------------------------------------------

FOLD = 16  # directories of one level before they become one of the next


def folded(dirs: list[list], fold: Callable[[list[str]], str]) -> list[list]:
    """[level, directory] pairs with at most ``FOLD`` of a level, so a row is rewritten once per level only."""
    level = 0
    while sum(at == level for at, _ in dirs) > FOLD:
        merged = fold([d for at, d in dirs if at == level])
        dirs = [x for x in dirs if x[0] != level] + [[level + 1, merged]]
        level += 1
    return dirs


# --- keyed winners -------------------------------------------------------------------------------------

WINNER = ("parish_slug string, idx bigint, source_url string, published_date string, fetched_at string, "
          "processed_at string")
CARRY = ["idx", "source_url", "published_date", "fetched_at", "processed_at"]


def _winners_of(rows: DataFrame) -> DataFrame:
    names = [c.split(" ")[0] for c in WINNER.split(", ")]
    return latest.to_show(rows.select(*names).withColumn("pdf_path", F.lit("")), CARRY).select(*names)


def current_winners(spark: SparkSession, root: str) -> DataFrame:
    """Each parish's shown document over all batches so far."""
    dirs = versions.latest(spark, root)[1].get("dirs", [])
    return _winners_in(spark, root, [d for _, d in dirs]) if dirs else spark.createDataFrame([], WINNER)


def _winners_in(spark: SparkSession, root: str, dirs: list[str]) -> DataFrame:
    return _winners_of(spark.read.schema(WINNER).parquet(*[f"{root}/{d}" for d in dirs]))


def winner_upsert(root: str) -> Callable[[DataFrame, int], None]:
    """Keep each parish's shown document as rows arrive in any order: an old issue never wins late.

    A batch writes the winners among its own rows and nothing else.  Winners of winners are the winners of all
    rows, and a row counted twice changes nothing, so replays and new checkpoints are harmless.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number, held = versions.latest(spark, root)
        delta = versions.fresh("delta")
        _winners_of(batch).write.parquet(f"{root}/{delta}")
        dirs = folded([*held.get("dirs", []), [0, delta]], lambda some: fold(spark, some))
        versions.commit(spark, root, {"dirs": dirs}, number)

    def fold(spark: SparkSession, some: list[str]) -> str:
        base = versions.fresh("base")
        _winners_in(spark, root, some).write.parquet(f"{root}/{base}")
        return base

    return handle


# --- result cache in buckets of the content hash -----------------------------------------------------

CACHE = "content_hash string, result_json string, bucket int"
CACHE_BUCKETS = 64


def cached_results(spark: SparkSession, cache_root: str) -> DataFrame:
    return read_or_empty(spark, cache_root, CACHE)


def unseen_hashes(cache_root: str, extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Extract only content hashes that are not cached yet.

    ``extract`` maps (content_hash, ...) rows to (content_hash, result_json).  A batch reads the buckets of its
    own hashes only, and adds to them; nothing cached is ever written again.
    """
    bucket = F.pmod(F.xxhash64("content_hash"), F.lit(CACHE_BUCKETS)).cast("int").alias("bucket")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = written(batch.where(F.col("content_hash") != "").dropDuplicates(["content_hash"]).select("*", bucket), "asked-hashes")
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # CACHE_BUCKETS at most
        known = cached_results(spark, cache_root).where(F.col("bucket").isin(buckets)).select("content_hash")
        fresh = extract(asked.join(known, "content_hash", "left_anti").drop("bucket"))
        (fresh.select("content_hash", "result_json", bucket).repartition("bucket")
         .write.partitionBy("bucket").mode("append").parquet(cache_root))
    return handle


# --- published events, kept up to date bucket by bucket -----------------------------------------------
# The event log is a list of directories, one per batch, split by the bucket of the document.  The view is a
# manifest: which directory holds which bucket, the documents it shows, and the log it was made from.

VIEW_BUCKETS = 16
EVENT_BITS = 27  # 16 MB: some events a shown document


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(VIEW_BUCKETS)).cast("int")


def append_events(log_root: str, batch: DataFrame) -> None:
    """Add a batch to the event log.  An event may be there already: the view counts each id once."""
    spark = batch.sparkSession
    number, held = versions.latest(spark, log_root)
    rows = batch.withColumn("arrival", F.lit(number + 1).cast("bigint")).withColumn("bucket", _bucket("bulletin_id"))

    def stored(df: DataFrame) -> str:
        part = versions.fresh("events")
        df.write.partitionBy("bucket").parquet(f"{log_root}/{part}")
        return part

    part = stored(rows)  # where it lies: a batch has few splits, and directories are folded into whole buckets
    touched = spark.read.schema(rows.schema).parquet(f"{log_root}/{part}").select("bucket").distinct().collect()  # VIEW_BUCKETS at most
    schema = rows.schema.json()
    dirs = folded([*held.get("dirs", []), [0, part]], lambda some: stored(_each_once(spark, log_root, some, schema).repartition("bucket")))
    last = {**held.get("last", {}), **{str(r["bucket"]): number + 1 for r in touched}}
    versions.commit(spark, log_root, {"dirs": dirs, "schema": schema, "last": last}, number)


def _each_once(spark: SparkSession, log_root: str, dirs: list[str], schema: str, buckets: list[int] | None = None,
               shown: DataFrame | None = None) -> DataFrame:
    """Every event of the directories once, as it arrived first; with ``shown`` only those that may be of its documents.

    An event may name one document first and another later, so its rows are taken or left together.
    """
    kind = StructType.fromJson(json.loads(schema))
    rows = reduce(DataFrame.unionByName, [spark.read.schema(kind).parquet(f"{log_root}/{d}") for d in dirs])
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if shown is not None:
        rows = likely(rows, likely(rows, shown, "bulletin_id", size=MANY_BITS), "id", size=EVENT_BITS)
    columns = [c for c in rows.columns if c not in ("id", "arrival")]
    return rows.groupBy("id").agg(F.min(F.struct("arrival", *columns)).alias("e")).select("id", "e.*").select(*kind.names)


def logged_events(spark: SparkSession, log_root: str, buckets: list[int], shown: DataFrame | None = None) -> DataFrame:
    """The events of some buckets, or those of them that may be of ``shown`` documents; the other buckets' files are not read."""
    log = versions.latest(spark, log_root)[1]
    return _each_once(spark, log_root, [d for _, d in log["dirs"]], log["schema"], buckets, shown)


def published(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(church, event) of the published view; events with the number of the log they arrived in."""
    content = versions.latest(spark, root)[1]
    if not content:
        raise FileNotFoundError(f"Nothing published under {root}")
    held = spark.read.parquet(f"{root}/{content['church']}")
    schema = StructType.fromJson(json.loads(content["schema"]))
    paths = [f"{root}/{d}/bucket={b}" for b, d in content["buckets"].items() if d]
    event = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return held, event


def publish_view(church: DataFrame, parish: DataFrame, bulletin: DataFrame, log_root: str, root: str, now: str) -> dict:
    """Bring the published view up to the log and the documents now shown, if the gate lets it pass.

    Only buckets with new events, or with a document that came to be shown or no longer is, are made anew.  The gate
    compares the published events with those of the new view that had arrived by then: late arrivals are no
    drift, lost events are.  What is refused stays in the log and is tried again with the next batch.
    """
    spark = church.sparkSession
    log_number, log = versions.latest(spark, log_root)
    number, view = versions.latest(spark, root)
    shown_dir, event_dir, church_dir = (versions.fresh(n) for n in ("shown", "view", "church"))
    shown = latest.for_snapshot(bulletin).select(F.col("id").alias("bulletin_id"))
    shown.write.parquet(f"{root}/{shown_dir}")
    shown = spark.read.schema(shown.schema).parquet(f"{root}/{shown_dir}")
    last = {int(b): at for b, at in log.get("last", {}).items()}  # the log's newest entry for each bucket
    todo = {b for b, at in last.items() if at > view.get("log", 0)}
    if view:
        before = spark.read.schema(shown.schema).parquet(f"{root}/{view['shown']}")
        both = shown.withColumn("side", F.lit(1)).unionByName(before.withColumn("side", F.lit(-1)))
        changed = both.groupBy("bulletin_id").agg(F.sum("side").alias("side")).where("side <> 0")
        todo |= {r["b"] for r in changed.select(_bucket("bulletin_id").alias("b")).distinct().collect()}
    buckets = {str(b): view.get("buckets", {}).get(str(b)) for b in sorted(last)}
    todo = sorted(todo & set(last))
    if todo:
        rows = logged_events(spark, log_root, todo, shown).join(shown, "bulletin_id").select(*snapshot.EVENT_COLUMNS, "arrival", "bucket")
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{event_dir}")
        stored = spark.read.schema(rows.schema).parquet(f"{root}/{event_dir}")
        filled = {r["bucket"] for r in stored.select("bucket").distinct().collect()}
        buckets |= {str(b): event_dir if b in filled else None for b in todo}
        schema = StructType([f for f in rows.schema if f.name != "bucket"]).json()
    elif view:
        schema = view["schema"]
    else:
        return {"version": 0, "passed": False, "errors": ["no events"]}
    snapshot.snapshot_church(church, parish, bulletin).write.parquet(f"{root}/{church_dir}")
    content = {"buckets": buckets, "schema": schema, "shown": shown_dir, "church": church_dir, "log": log_number, "published_at": now}
    result = {"passed": True, "errors": []}
    if view:
        old_church, old_event = published(spark, root)
        paths = [f"{root}/{d}/bucket={b}" for b, d in buckets.items() if d]
        new_event = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths).where(F.col("arrival") <= view["log"])
        row = snapshot.gate(spark.read.parquet(f"{root}/{church_dir}"), new_event, old_church, old_event).first()
        result = {**row.asDict(), "errors": []}
    if result["passed"]:
        number = versions.commit(spark, root, content, number)
    return {"version": number, **result}


def snapshot_refresh(events: DataFrame, church: DataFrame, parish: DataFrame, bulletin: DataFrame, log_root: str,
                     root: str, checkpoint: str, now: str) -> StreamingQuery:
    """Publish with every batch of arriving events."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        append_events(log_root, batch)
        publish_view(church, parish, bulletin, log_root, root, now)

    return start(events, handle, checkpoint)


__all__ = ["append_events", "cached_results", "current_winners", "new_urls", "publish_view", "published", "snapshot_refresh",
           "start", "unseen_hashes", "winner_upsert", "write_parquet"]
