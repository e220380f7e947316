"""Source and sink checks: what is written must read back as the tables it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from belfry import schemas
from belfry.plans import load, snapshot
from belfry.session import scratch_path, shuffles_freed
from belfry.sources import documents as docs
from belfry.sources import files, pages, sinks, versions
from catalog.registry import define, query


def parish_file(d) -> str:
    path = scratch_path(d.spark, "parishes.csv")
    sinks.write_csv(d.parish.withColumn("website", F.col("homepage_url")), path, schemas.PARISH_CSV)
    return path


def church_file(d) -> str:
    path = scratch_path(d.spark, "churches.csv")
    flag = lambda c: F.when(F.col(c) == 1, " True ").otherwise("")
    rows = d.church.select(F.concat(F.lit("p-"), F.col("parish_id").cast("string")).alias("parish_id"), "slug", "name",
                           F.col("address_line1").alias("line1"), F.col("address_line2").alias("line2"), "city", "state", "postal_code",
                           flag("name_verified").alias("name_verified"), flag("address_verified").alias("address_verified"), "latitude", "longitude")
    sinks.write_csv(rows, path, schemas.CHURCH_CSV)
    return path


@query("src_parish_csv", "select slug, name, homepage_url, nullif(trim(bulletin_provider), '') as bulletin_provider, provider_id from parish")
def _(d):
    return files.parish_csv(d.spark, parish_file(d)).drop("idx")


@query("src_church_csv", """select 'p-' || parish_id as parish_slug, slug, name, nullif(address_line1, '') as address_line1, address_line2, city, state, postal_code,
    name_verified, address_verified, latitude, longitude from church""")
def _(d):
    return files.church_csv(d.spark, church_file(d)).drop("idx")


@query("snk_csv_atomic", "select count(*) as n, count(distinct slug) as slugs, sum(case when name like 'New %' then 1 else 0 end) as renamed from (select slug, 'New ' || name as name from parish)")
def _(d):
    path = parish_file(d)
    again = d.parish.withColumn("website", F.col("homepage_url")).withColumn("name", F.concat(F.lit("New "), F.col("name")))
    sinks.write_csv(again, path, schemas.PARISH_CSV)
    return files.parish_csv(d.spark, path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slug").alias("slugs"),
                                               F.count_if(F.col("name").startswith("New ")).alias("renamed"))


@query("src_csv_header_check", "select 'churches.csv: missing required columns: [''city'', ''line1'']' as message, count(*) as n from church")
def _(d):
    path = scratch_path(d.spark, "half") + "/churches.csv"
    sinks.write_csv(d.church.withColumn("line1", F.col("address_line1")), path, ["parish_id", "slug", "name", "state", "postal_code"])
    try:
        files.church_csv(d.spark, path)
        message = ""
    except ValueError as err:
        message = str(err)
    rows = d.spark.read.option("header", True).csv(versions.current_dir(d.spark, path))
    return rows.agg(F.lit(message).alias("message"), F.count(F.lit(1)).alias("n"))


@query("src_json_list", "select idx, church_slug, bulletin_source_url, date, start_time, cancelled, page_number, note from raw_event")
def _(d):
    path = scratch_path(d.spark, "events") + "/events.jsonl"
    with shuffles_freed(d.spark):
        sinks.write_json(d.view("raw_event").withColumnRenamed("idx", "source_idx"), path, "gzip")
    rows = files.json_list(d.spark, path, f"source_idx bigint, {schemas.RAW_EVENT}").drop("idx")
    return rows.select(F.col("source_idx").alias("idx"), "church_slug", "bulletin_source_url", "date", "start_time", "cancelled", "page_number", "note")


@query("snk_json", "select idx, parish_slug, source_url, processed_at from metadata")
def _(d):
    path = scratch_path(d.spark, "metadata.json")
    sinks.write_json(d.metadata, path)
    return d.spark.read.schema(schemas.METADATA).json(path).select("idx", "parish_slug", "source_url", "processed_at")


@query("src_json_dict", "select slug, bulletin_provider, provider_id from detected")
def _(d):
    from catalog.relations import detected
    path = scratch_path(d.spark, "detect") + "/results.jsonl"
    one = F.to_json(F.create_map("slug", F.struct("bulletin_provider", "provider_id")))
    detected(d).select(one.alias("value")).write.text(path)
    rows = files.json_dict(d.spark, path, "struct<bulletin_provider:string,provider_id:string>")
    return rows.select("slug", "value.bulletin_provider", "value.provider_id")


@query("src_snapshot", "select 'church' as tbl, count(*) as n, sum(id) as total from snap_church union all select 'event', count(*), sum(id % 1000003) from snapshot_event")
def _(d):
    root = stored_snapshot(d)
    church, event = snapshot.read_version(d.spark, root, snapshot.published_versions(d.spark, root)[0])
    return church.agg(F.lit("church").alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("total")).unionByName(
        event.agg(F.lit("event").alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum(F.col("id") % 1000003).alias("total")))


def stored_snapshot(d) -> str:
    root = scratch_path(d.spark, "snapshot")
    snapshot.refresh(d.church, d.parish, d.bulletin, d.event, root, "2001-01-01T00:00:00Z")
    return root


_SHOWN = ", ".join(snapshot.EVENT_COLUMNS)


@query("snk_snapshot", f"select 1 as version, {_SHOWN} from snapshot_event union all select 2, {_SHOWN} from snapshot_event")
def _(d):
    root = stored_snapshot(d)
    snapshot.refresh(d.church, d.parish, d.bulletin, d.event, root, "2001-01-08T00:00:00Z")
    out = None
    for v in snapshot.published_versions(d.spark, root):
        one = snapshot.read_version(d.spark, root, v)[1].select(F.lit(v).alias("version"), *snapshot.EVENT_COLUMNS)
        out = one if out is None else out.unionByName(one)
    return out


_TABLES = {"parish": ("slug", "name", "homepage_url"), "church": ("parish_id", "slug", "name", "city"), "bulletin": ("parish_id", "source_url", "content_hash"),
           "event": ("church_id", "bulletin_id", "event_type", "date", "start_time", "note")}


@query("snk_rebuild_tables", " union all ".join(f"""select '{name}' as "table", id, concat_ws('|', {", ".join(f"coalesce({c}::varchar, '-')" for c in columns)}) as content from {name}"""
                                                for name, columns in _TABLES.items()))
def _(d):
    tables = {"parish": d.parish, "church": d.church, "bulletin": d.bulletin, "event": d.event}
    root = scratch_path(d.spark, "tables")
    load.rebuild_tables({name: df.limit(0) for name, df in tables.items()}, root)
    load.rebuild_tables(tables, root)
    out = None
    for name, df in load.open_tables(d.spark, root).items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _TABLES[name]])
        one = df.select(F.lit(name).alias("table"), "id", text.alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk_drop_tables", "select true as first, false as second, count(*) as n from parish")
def _(d):
    root = scratch_path(d.spark, "dropped")
    n = load.rebuild_tables({"parish": d.parish}, root)
    stored = n.first()["n"]
    first, second = sinks.drop_dir(d.spark, root), sinks.drop_dir(d.spark, root)
    return d.parish.agg(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(stored).alias("n"))


@query("snk_cache", "select content_hash, 1 as n from bulletin where content_hash is not null group by content_hash")
def _(d):
    from belfry.functions.text import cache_version
    path = scratch_path(d.spark, "cache")
    results = d.bulletin.select(F.lit("stub").alias("classifier"), cache_version(F.lit("v1")).alias("version"), "content_hash",
                                F.struct(F.lit("x").alias("payload")).alias("result"))
    schema = "content_hash string, result struct<payload:string>, classifier string, version string"
    for part in (results.where("length(content_hash) % 2 = 0"), results):
        sinks.append_cache(part, files.read_or_empty(d.spark, path, schema), path)
    return d.spark.read.schema(schema).parquet(path).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


define("fetched_doc", "select 'p-' || (doc_id % 97) as parish_slug, 'https://d.example.org/' || doc_id as source_url, sha256(text) as digest from documents")


@query("snk_content_addressed", """select '/' || parish_slug || '/' || digest || '.pdf' as path, count(*) as n_rows, 1 as n_blobs from fetched_doc group by 1""")
def _(d):
    fetched = d.documents.select(F.expr("'p-' || (doc_id % 97)").alias("parish_slug"), F.expr("'https://d.example.org/' || doc_id").alias("source_url"),
                                 F.encode("text", "UTF-8").alias("content"), F.lit("2001-01-01T00:00:00Z").alias("fetched_at"))
    nothing = d.spark.createDataFrame([], "path string, content binary")
    blobs, rows = docs.store_documents(fetched, nothing)
    path = scratch_path(d.spark, "blobs")
    blobs.write.parquet(path)
    stored = d.spark.read.parquet(path)
    again, _ = docs.store_documents(fetched, stored)
    again.write.mode("append").parquet(path)
    per = d.spark.read.parquet(path).groupBy("path").agg(F.count(F.lit(1)).alias("n_blobs"))
    return rows.groupBy(F.col("pdf_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows")).join(per, "path")


@query("src_pages", "select a.page_id, md5(a.html || coalesce(chr(10) || b.html, '')) as digest from pages a left join pages b on b.page_id = a.page_id + 1 and a.page_id % 2 = 0 where a.page_id % 2 = 0")
def _(d):
    parts = d.pages.select((F.col("page_id") - F.col("page_id") % 2).alias("page_id"), (F.col("page_id") % 2).alias("part_no"), "html")
    return pages.page_html(parts).select("page_id", F.md5("html").alias("digest"))
