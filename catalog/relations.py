"""Filters, joins, windows, sets and aggregates over the base tables and the snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from belfry.operators import filters, latest, quality, unique
from belfry.plans import load, merge, process, snapshot, verify
from belfry.session import scratch_path, written
from belfry.sources import documents as docs
from catalog.functions import d_address, d_address_key, d_event_date, d_minutes
from catalog.registry import define, query

SHOWN = "coalesce(published_date, '') desc, coalesce(fetched_at, '') desc, coalesce(processed_at, '') desc"

define("shown_bulletin", f"""select parish_id, id from (select *, row_number() over (partition by parish_id
    order by {SHOWN}, id desc) as rn from bulletin) where rn = 1""")
define("shown_url", f"""select parish_id, source_url as bulletin_url from (select *, row_number() over (partition by parish_id
    order by {SHOWN}, id desc) as rn from bulletin where source_url is not null) where rn = 1""")
define("work_choice", """select * from (select *, row_number() over (partition by parish_slug
    order by coalesce(fetched_at, '') desc, coalesce(published_date, '') desc, idx desc) as rn from metadata where pdf_path <> '') where rn = 1""")
define("shown_meta", f"""select * from (select *, row_number() over (partition by parish_slug order by {SHOWN}, idx desc) as rn
    from metadata where processed_at <> '') where rn = 1""")
define("verify_choice", """select parish_id, id, pdf_path from (select *, row_number() over (partition by parish_id
    order by fetched_at desc nulls last, id desc) as rn from bulletin where pdf_path is not null) where rn = 1""")


# --- latest ----------------------------------------------------------------------------------

@query("win_latest_snapshot", "select parish_id, id from shown_bulletin")
def _(d):
    return latest.for_snapshot(d.bulletin)


@query("win_latest_url", "select parish_id, bulletin_url from shown_url")
def _(d):
    return latest.url_for_snapshot(d.bulletin)


@query("win_latest_fetched", "select parish_slug, idx, source_url, processed_at from work_choice")
def _(d):
    return latest.to_process(d.metadata, ["idx", "source_url", "processed_at"])


@query("win_latest_published", "select parish_slug, idx, source_url from shown_meta")
def _(d):
    return latest.to_show(d.metadata, ["idx", "source_url"])


@query("win_latest_verify", "select parish_id, id, pdf_path from verify_choice")
def _(d):
    return latest.to_verify(d.bulletin)


# --- filters and work lists ------------------------------------------------------------------

@query("flt_has_coords", "select id, slug, name, latitude, longitude from church where latitude is not null and longitude is not null")
def _(d):
    return d.church.where(filters.has_coords()).orderBy("name", "id").select("id", "slug", "name", "latitude", "longitude")


@query("flt_coord_range", "select idx, latitude, longitude from geo_result where latitude between -90 and 90 and longitude between -180 and 180")
def _(d):
    return d.geo_result.where(filters.coords_in_range()).select("idx", "latitude", "longitude")


@query("flt_pending_provider", "select id, slug from parish where trim(coalesce(bulletin_provider, '')) = '' order by id")
def _(d):
    return filters.pending_provider(d.parish).orderBy("id").select("id", "slug")


@query("lim_n", "select id, slug from parish where trim(coalesce(bulletin_provider, '')) = '' order by id limit 25")
def _(d):
    return filters.pending_provider(d.parish, 25).select("id", "slug")


@query("flt_pending_process", "select parish_slug, idx from work_choice where processed_at is null")
def _(d):
    return filters.pending_process(latest.to_process(d.metadata, ["idx", "processed_at"])).select("parish_slug", "idx")


@query("flt_by_parish_name", "select m.* from metadata m join parish p on m.parish_slug = p.slug where p.name = 'Customer#000000007'")
def _(d):
    return filters.by_parish_name(d.metadata, d.parish, "Customer#000000007")


@query("flt_fetchable", """select id, trim(bulletin_provider) as provider, case when bulletin_provider in ('parishes_online', 'discover_mass')
    then trim(provider_id) else homepage_url end as fetch_id from parish
    where trim(bulletin_provider) in ('ecatholic', 'parishes_online', 'discover_mass', 'other')
      and (bulletin_provider not in ('parishes_online', 'discover_mass') or trim(coalesce(provider_id, '')) <> '')""")
def _(d):
    return d.parish.select("id", filters.fetch_source().alias("s")).where("s is not null").select("id", "s.provider", "s.fetch_id")


@query("flt_page_cap", """select doc_id, page_no, md5(page) as digest from (select doc_id, unnest(string_split(text, chr(10))) as page,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) as page_no from documents) where page_no <= 10""")
def _(d):
    pages = d.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "page"))
    return pages.withColumn("page_no", F.col("pos") + 1).where(filters.page_cap(F.col("page_no"), filters.MAX_PAGES)).select(
        "doc_id", "page_no", F.md5("page").alias("digest"))


@query("flt_slug_lookup", "select id, parish_id, slug, name, city from church where slug = 'c-10'")
def _(d):
    return filters.require_rows(filters.one_by_slug(d.church, "c-10"), "Church not found: c-10").select(
        "id", "parish_id", "slug", "name", "city")


_PLACE = """select 'pl-' || page_id as place_id, case page_id % 5 when 0 then 'city' when 1 then 'postcode' when 2 then 'amenity'
    when 3 then null else 'street' end as result_type, case when page_id % 7 <> 0 then page_id * 0.5::double end as lat, page_id * 0.25::double as lon,
    case when page_id % 4 = 0 then 'line ' || page_id end as address_line1, case when page_id % 6 = 0 then 'second' end as address_line2,
    case when page_id % 3 = 0 then 'place ' || page_id end as name, url as formatted, case when page_id % 2 = 0 then 'Town' end as city,
    '' as state, case when page_id % 8 < 6 then '1' || page_id end as postcode from pages"""
define("place_row", _PLACE)


@query("flt_searchable_place", """select * from (select place_id as id, case when result_type = 'postcode' then coalesce(postcode, formatted)
    else coalesce(address_line1, name, formatted) end as title,
    nullif(coalesce(address_line2, concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(postcode, ''))), '') as subtitle,
    lat, lon as lng, result_type from place_row
    where lat is not null and result_type in ('building','street','suburb','district','postcode','city','county','state')) where title <> ''""")
def _(d):
    e = F.expr
    places = d.pages.select(
        e("'pl-' || page_id as place_id"),
        e("case page_id % 5 when 0 then 'city' when 1 then 'postcode' when 2 then 'amenity' when 3 then null else 'street' end as result_type"),
        e("case when page_id % 7 <> 0 then page_id * cast(0.5 as double) end as lat"), e("page_id * cast(0.25 as double) as lon"),
        e("case when page_id % 4 = 0 then 'line ' || page_id end as address_line1"),
        e("case when page_id % 6 = 0 then 'second' end as address_line2"),
        e("case when page_id % 3 = 0 then 'place ' || page_id end as name"), F.col("url").alias("formatted"),
        e("case when page_id % 2 = 0 then 'Town' end as city"), F.lit("").alias("state"),
        e("case when page_id % 8 < 6 then '1' || page_id end as postcode"))
    return filters.searchable_places(places)


@query("flt_query_eligible", r"""select doc_id, regexp_matches(q, '^\d{2,5}(-\d{0,4})?$') or length(q) >= 3 as eligible
    from (select doc_id, trim(case doc_id % 4 when 0 then ' ' || doc_id when 1 then doc_id || '-12' when 2 then lang else source end) as q from documents)""")
def _(d):
    typed = F.expr("case doc_id % 4 when 0 then ' ' || doc_id when 1 then doc_id || '-12' when 2 then lang else source end")
    return d.documents.select("doc_id", filters.place_query_eligible(typed).alias("eligible"))


@query("prj_church_for_prompt", f"""select parish_id, '[' || string_agg('"slug":"' || slug || '","name":"' || name || '","address":"' || {d_address()} || '"', ';' order by id) || ']' as listed
    from church group by parish_id""")
def _(d):
    line = lambda c: F.concat(F.lit('"slug":"'), c["slug"], F.lit('","name":"'), c["name"], F.lit('","address":"'), c["address"], F.lit('"'))
    return docs.church_list(d.church).select("parish_id", F.concat(
        F.lit("["), F.array_join(F.transform("churches", line), ";"), F.lit("]")).alias("listed"))


@query("srt_parish_list", "select id, slug, name, homepage_url, bulletin_provider, provider_id from parish order by id")
def _(d):
    return d.parish.orderBy("id")


@query("srt_names", "select id, slug, name, city, state from church order by city nulls first, name nulls first, id")
def _(d):
    return d.church.orderBy("city", "name", "id").select("id", "slug", "name", "city", "state")


# --- loader joins ----------------------------------------------------------------------------

# each joined table also gets rows whose key has no partner
@query("join_church_parish", """select c.id, c.slug, p.id as parish_id from (select id, slug, 'p-' || parish_id as parish_slug from church
    union all select -id, slug, 'gone-' || id from church where id % 8 = 0) c join parish p on c.parish_slug = p.slug""")
def _(d):
    known = d.parish.select(F.col("slug").alias("parish_slug"), F.col("id").alias("parish_id"))
    named = d.church.selectExpr("id", "slug", "'p-' || parish_id as parish_slug").unionByName(
        d.church.where("id % 8 = 0").selectExpr("-id as id", "slug", "'gone-' || id as parish_slug"))
    return named.join(known, "parish_slug").select("id", "slug", "parish_id")


@query("join_bulletin_parish", """select m.idx, p.id as parish_id from (select idx, parish_slug from metadata
    union all select -1 - idx, 'gone-' || idx from metadata where idx % 8 = 0) m join parish p on m.parish_slug = p.slug""")
def _(d):
    known = d.parish.select(F.col("slug").alias("parish_slug"), F.col("id").alias("parish_id"))
    named = d.metadata.select("idx", "parish_slug").unionByName(
        d.metadata.where("idx % 8 = 0").selectExpr("-1 - idx as idx", "'gone-' || idx as parish_slug"))
    return named.join(known, "parish_slug").select("idx", "parish_id")


@query("join_event_church", """select r.idx, c.id as church_id, c.parish_id from (select idx, church_slug from raw_event
    union all select -1 - idx, 'gone-' || idx from raw_event where idx % 8 = 0) r join church c on r.church_slug = c.slug""")
def _(d):
    known = d.church.select(F.col("slug").alias("church_slug"), F.col("id").alias("church_id"), "parish_id")
    named = d.raw_event.select("idx", "church_slug").unionByName(
        d.raw_event.where("idx % 8 = 0").selectExpr("-1 - idx as idx", "'gone-' || idx as church_slug"))
    return named.join(known, "church_slug").select("idx", "church_id", "parish_id")


@query("join_event_bulletin", """select r.idx, b.id as bulletin_id from raw_event r join church c on r.church_slug = c.slug
    left join bulletin b on b.parish_id = c.parish_id and b.source_url = r.bulletin_source_url""")
def _(d):
    places = d.church.select(F.col("slug").alias("church_slug"), "parish_id")
    issues = d.bulletin.where("source_url is not null").select(
        "parish_id", F.col("source_url").alias("bulletin_source_url"), F.col("id").alias("bulletin_id"))
    return (d.raw_event.select("idx", "church_slug", "bulletin_source_url").join(places, "church_slug")
            .join(issues, ["parish_id", "bulletin_source_url"], "left").select("idx", "bulletin_id"))



define("loadable", f"""select r.idx, r.church_slug, c.id as church_id, b.id as bulletin_id, r.event_type, r.event_kind, r.day_of_week,
    case when r.event_kind = 'specific_date' then {d_event_date('r.date')} end as date, {d_minutes('r.start_time')} as start_time,
    {d_minutes('r.end_time')} as end_time, cast(r.cancelled as int) as cancelled, r.page_number, nullif(trim(r.note), '') as note
    from raw_event r left join church c on r.church_slug = c.slug
    left join bulletin b on b.parish_id = c.parish_id and b.source_url = r.bulletin_source_url""")
_GOOD = "start_time between 0 and 1439 and church_id is not null and (event_kind <> 'specific_date' or date is not null)"


@query("pipe_load_events", f"""select idx as id, church_id, bulletin_id, event_type, event_kind, day_of_week, date, start_time, end_time,
    cancelled, page_number, note from loadable where {_GOOD}""")
def _(d):
    return load.load_events(d.view("raw_event"), d.view("church"), d.view("bulletin"))[0].select(
        "id", "church_id", "bulletin_id", "event_type", "event_kind", "day_of_week", "date", "start_time", "end_time",
        "cancelled", "page_number", "note")


@query("src_event_json", f"""select coalesce(case when church_id is null then 'unknown church' when start_time is null then 'unreadable start_time'
      when event_kind = 'specific_date' and date is null then 'unreadable date' when start_time > 1439 then 'start_time out of range' end, 'loaded') as outcome,
    count(*) as n from loadable group by 1""")
def _(d):
    typed = load.typed_events(d.raw_event, d.church, d.bulletin)
    return typed.groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("dml_range_check", """select idx, case when start_time is null then 'start_time missing' when start_time > 1439 then 'start_time out of range' end as problem
    from loadable where start_time is null or start_time > 1439""")
def _(d):
    from belfry.functions.times import minutes_of_day
    bad = quality.range_problem(minutes_of_day(F.col("start_time")), minutes_of_day(F.col("end_time")), F.col("cancelled").cast("int"))
    return d.raw_event.select("idx", bad.alias("problem")).where("problem is not null")


# Church rows of which some repeat a slug, bulletin rows of which some repeat (parish, url).
define("church_rows", "select id as idx, 'c-' || (id - case when id % 8 = 5 then 3 else 0 end) as slug, parish_id, name from church")
define("bulletin_rows", """select id as idx, parish_id, case when source_url is not null then 'https://b.example.org/' || (id % 400) || '.pdf' end as source_url from bulletin""")


@query("dml_unique", "select slug, min(idx) as idx from church_rows group by slug")
def _(d):
    rows = d.church.select(F.col("id").alias("idx"), F.expr("'c-' || (id - case when id % 8 = 5 then 3 else 0 end)").alias("slug"), "parish_id", "name")
    return unique.first_wins(rows, ["slug"]).select("slug", "idx")


@query("dml_unique_nullable", """select min(idx) as idx, parish_id, source_url from bulletin_rows where source_url is not null group by parish_id, source_url
    union all select idx, parish_id, source_url from bulletin_rows where source_url is null""")
def _(d):
    rows = d.bulletin.select(F.col("id").alias("idx"), "parish_id", F.expr(
        "case when source_url is not null then 'https://b.example.org/' || (id % 400) || '.pdf' end").alias("source_url"))
    return unique.first_wins_null_free(rows, ["parish_id", "source_url"], "source_url")


@query("src_bulletin_meta", """select parish_id, source_url, min(idx) + 1 as id from (select m.idx, p.id as parish_id,
      case when m.source_url is not null then 'https://b.example.org/' || (m.idx % 400) || '.pdf' end as source_url
      from metadata m join parish p on m.parish_slug = p.slug) where source_url is not null group by parish_id, source_url
    union all select p.id, null, m.idx + 1 from metadata m join parish p on m.parish_slug = p.slug where m.source_url is null""")
def _(d):
    rows = d.metadata.withColumn("source_url", F.expr(
        "case when source_url is not null then 'https://b.example.org/' || (idx % 400) || '.pdf' end"))
    return load.load_bulletins(rows, d.parish).select("parish_id", "source_url", "id")


# row by row, in order: a row is taken when neither of its keys is
@query("win_greedy_unique", """select * from (with recursive o as (select row_number() over (order by id) as rn, id as idx, 's' || (id - id % 3) as slug, 'u' || (id - id % 4) as homepage_url from parish),
    step as (select 0::bigint as rn, null::bigint as idx, null::varchar as slug, null::varchar as homepage_url, []::varchar[] as taken
      union all select o.rn, case when ok then o.idx end, o.slug, o.homepage_url, case when ok then (s.taken || [o.slug, o.homepage_url])[-40:] else s.taken end
      from (select step.rn, step.taken, not list_contains(step.taken, n.slug) and not list_contains(step.taken, n.homepage_url) as ok from step join o n on n.rn = step.rn + 1) s join o on o.rn = s.rn + 1)
    select idx, slug, homepage_url from step where idx is not null)""")
def _(d):
    rows = d.parish.select(F.col("id").alias("idx"), F.expr("'s' || (id - id % 3)").alias("slug"),
                           F.expr("'u' || (id - id % 4)").alias("homepage_url"), "name")
    return unique.greedy_unique(rows, "slug", "homepage_url", ["name"]).select("idx", "slug", "homepage_url")


define("church_and_strays", "select id, parish_id from church union all select -id, -id from church where id % 50 = 3")
define("bulletin_and_strays", "select id, parish_id from bulletin union all select -id, -id from bulletin where id % 50 = 3")


@query("dml_fk_check", """select 'church.parish_id' as edge, c.id from church_and_strays c where c.parish_id not in (select id from parish)
    union all select 'bulletin.parish_id', b.id from bulletin_and_strays b where b.parish_id not in (select id from parish)
    union all select 'event.church_id', e.id from event e where e.church_id not in (select id from church)
    union all select 'event.bulletin_id', e.id from event e where e.bulletin_id is not null and e.bulletin_id not in (select id from bulletin)""")
def _(d):
    church, bulletin = (df.select("id", "parish_id").unionByName(df.where("id % 50 = 3").selectExpr("-id as id", "-id as parish_id"))
                        for df in (d.church, d.bulletin))
    return quality.orphans(d.parish, church, bulletin, d.event)


@query("dml_upsert_results", """select parish_id as slug, case when parish_id % 3 = 0 then 'fresh' else 'stored' end as source
    from (select distinct parish_id from church where parish_id % 2 = 0 or parish_id % 3 = 0)""")
def _(d):
    ids = d.church.select(F.col("parish_id").alias("slug")).distinct()
    return verify.upsert_results(ids.where("slug % 2 = 0").withColumn("source", F.lit("stored")),
                                 ids.where("slug % 3 = 0").withColumn("source", F.lit("fresh")))


# --- snapshot --------------------------------------------------------------------------------

define("snap_church", """select c.id, c.parish_id, c.slug, c.name, c.address_line1, c.address_line2, c.city, c.state, c.postal_code, c.latitude,
    c.longitude, p.homepage_url, u.bulletin_url from church c left join parish p on c.parish_id = p.id left join shown_url u on u.parish_id = c.parish_id""")


@query("join_snapshot_church", "select c.id, p.homepage_url from church_and_strays c left join parish p on c.parish_id = p.id")
def _(d):
    homes = d.parish.select(F.col("id").alias("parish_id"), "homepage_url")
    church = d.church.select("id", "parish_id").unionByName(d.church.where("id % 50 = 3").selectExpr("-id as id", "-id as parish_id"))
    return church.join(homes, "parish_id", "left").select("id", "homepage_url")


@query("join_scalar_subquery", "select c.id, u.bulletin_url from church c left join shown_url u on u.parish_id = c.parish_id")
def _(d):
    return d.church.select("id", "parish_id").join(latest.url_for_snapshot(d.bulletin), "parish_id", "left").select("id", "bulletin_url")


@query("join_snapshot_event", "select e.id, e.bulletin_id from event e join bulletin b on e.bulletin_id = b.id join shown_bulletin s on b.parish_id = s.parish_id and b.id = s.id")
def _(d):
    shown = latest.for_snapshot(d.bulletin).select(F.col("id").alias("bulletin_id"))
    return d.event.join(shown, "bulletin_id").select("id", "bulletin_id")


_SNAP = ", ".join(snapshot.EVENT_COLUMNS)


@query("pipe_snapshot", f"select {_SNAP} from snapshot_event")
def _(d):
    return snapshot.snapshot_event(d.event, d.bulletin)


@query("src_snapshot_churches", "select id, parish_id, slug, name, address_line1, address_line2, city, state, postal_code, latitude, longitude, homepage_url, bulletin_url from snap_church")
def _(d):
    return snapshot.snapshot_church(d.church, d.parish, d.bulletin).orderBy("name", "id")


@query("agg_snapshot_counts", """select 'current' as version, 'event' as tbl, count(*) as n from snapshot_event union all select 'previous', 'event', count(*) from snapshot_event where id % 25 <> 0
    union all select 'current', 'church', count(*) from church union all select 'previous', 'church', count(*) from church""")
def _(d):
    rows = [("current", "event", d.snapshot_event), ("previous", "event", d.snapshot_event.where("id % 25 <> 0")),
            ("current", "church", d.church), ("previous", "church", d.church)]
    out = None
    for version, name, df in rows:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_WK = "select distinct church_id, event_type, coalesce(day_of_week, '') as d, start_time from snapshot_event where lower(event_kind) = 'weekly'"


def _gate_sql(prev: str) -> str:
    return f"""select cc as churches_current, cc as churches_previous, ec as events_current, ep as events_previous, wc as weekly_current,
      wp as weekly_previous, wm as weekly_matching, abs(ec - ep) / ep::double * 100.0::double as event_delta_pct, wm / wp::double * 100.0::double as weekly_match_pct, true as churches_passed,
      abs(ec - ep) / ep::double * 100.0::double <= 10 as events_passed, wm / wp::double * 100.0::double >= 90 as weekly_passed,
      abs(ec - ep) / ep::double * 100.0::double <= 10 and wm / wp::double * 100.0::double >= 90 as passed
    from (select (select count(*) from church) as cc, (select count(*) from snapshot_event) as ec, (select count(*) from snapshot_event where {prev}) as ep,
      (select count(*) from ({_WK})) as wc, (select count(*) from ({_WK} and {prev})) as wp, (select count(*) from ({_WK} intersect ({_WK} and {prev}))) as wm)"""


def _gate(d, prev):
    return snapshot.gate(d.church, d.snapshot_event, d.church, d.snapshot_event.where(prev))


@query("agg_snapshot_gate", _gate_sql("id % 25 <> 0"))
def _(d):
    return _gate(d, "id % 25 <> 0")


@query("pipe_snapshot_gate", _gate_sql("id % 5 <> 0"))
def _(d):
    return _gate(d, "id % 5 <> 0")


@query("agg_event_delta", f"select event_delta_pct, events_passed from ({_gate_sql('id % 7 <> 0')})")
def _(d):
    return _gate(d, "id % 7 <> 0").select("event_delta_pct", "events_passed")


@query("agg_weekly_match", f"select weekly_current, weekly_previous, weekly_matching, weekly_match_pct, weekly_passed from ({_gate_sql('id % 7 <> 0')})")
def _(d):
    return _gate(d, "id % 7 <> 0").select("weekly_current", "weekly_previous", "weekly_matching", "weekly_match_pct", "weekly_passed")


# --- compaction and merging ------------------------------------------------------------------

define("compacted", "select r.* from raw_event r where exists (select 1 from shown_meta s where s.source_url is not distinct from r.bulletin_source_url)")


@query("join_compaction_semi", "select idx, bulletin_source_url from compacted")
def _(d):
    return process.compact(d.view("raw_event"), d.metadata).select("idx", "bulletin_source_url")


@query("pipe_compact", "select bulletin_source_url, count(*) as n, min(idx) as first_idx from compacted group by all")
def _(d):
    once = process.compact(d.raw_event, d.metadata)
    return process.compact(once, d.metadata).groupBy("bulletin_source_url").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))


# --- joins of the verification, geocoding and lineage jobs -----------------------------------

define("done_parish", "select parish_id from church group by parish_id having min(case when name_verified = 1 and address_verified = 1 then 1 else 0 end) = 1")


@query("agg_verified_parishes", "select p.id, p.slug from parish p join done_parish v on p.id = v.parish_id")
def _(d):
    return verify.verified_parishes(d.parish, d.church)


@query("join_latest_with_churches", """select p.id as parish_id, p.slug as parish_slug, v.pdf_path, count(c.id) as n_churches from parish p
    join verify_choice v on v.parish_id = p.id join church c on c.parish_id = p.id where p.id not in (select parish_id from done_parish) group by all""")
def _(d):
    return verify.verify_worklist(d.parish, d.church, d.bulletin)


define("geo_pending", f"""select id, {d_address_key()} as address_key, address_line1, address_line2, city, state, postal_code from church where coalesce(address_line1, '') <> ''
    and {d_address_key()} not in (select {d_address_key()} from church where latitude is not null and longitude is not null)""")


@query("join_geocode_pending_anti", "select id, address_key from geo_pending")
def _(d):
    return merge.geocode_pending(d.church).select("id", "address_key")


define("geo_usable", f"""select k, latitude, longitude from (select {d_address_key(p='')} as k, latitude, longitude,
    row_number() over (partition by {d_address_key(p='')} order by idx desc) as rn from geo_result
    where latitude between -90 and 90 and longitude between -180 and 180) where rn = 1""")


def roster(d):
    return d.church.select("id", F.col("address_line1").alias("line1"), F.col("address_line2").alias("line2"), "city", "state",
                           "postal_code", "latitude", "longitude")


@query("join_geocode_apply", f"""select c.id, coalesce(g.latitude, c.latitude) as latitude, coalesce(g.longitude, c.longitude) as longitude, g.k is not null as updated
    from church c left join geo_usable g on g.k = {d_address_key('c.')}""")
def _(d):
    return merge.apply_geocode(roster(d), d.geo_result).select("id", "latitude", "longitude", "updated")


@query("pipe_geocode", f"""select count(*) as checked, count(g.k) as updated, count(*) - count(g.k) as failed from geo_pending p
    left join geo_usable g on g.k = p.address_key""")
def _(d):
    # the user-supplied lookup: coordinates by written address
    usable = d.geo_result.where(filters.coords_in_range())
    from belfry.functions.text import format_address
    cols = [F.col(c) for c in ("line1", "line2", "city", "state", "postal_code")]
    lookup = usable.groupBy(format_address(*cols).alias("address")).agg(
        F.max_by("latitude", "idx").alias("latitude"), F.max_by("longitude", "idx").alias("longitude"))
    return merge.geocode_counters(merge.geocode(merge.geocode_pending(d.church), lookup))


define("detected", """select slug, case when id % 2 = 0 then 'ecatholic' end as bulletin_provider, 'new-' || id as provider_id from parish where id % 3 = 0""")


def detected(d):
    return d.parish.where("id % 3 = 0").select("slug", F.expr("case when id % 2 = 0 then 'ecatholic' end").alias("bulletin_provider"),
                                               F.expr("'new-' || id").alias("provider_id"))


@query("join_detect_apply", """select p.slug, case when r.slug is not null then coalesce(r.bulletin_provider, '') else coalesce(p.bulletin_provider, '') end as bulletin_provider,
    case when r.slug is not null then coalesce(r.provider_id, '') else coalesce(p.provider_id, '') end as provider_id, r.slug is not null as updated
    from parish p left join detected r on p.slug = r.slug""")
def _(d):
    return merge.apply_detect(d.parish.select("slug", "bulletin_provider", "provider_id"), detected(d))


@query("join_event_lineage", """select e.id, c.slug as church_slug, b.source_url from event e join church c on e.church_id = c.id join bulletin b on e.bulletin_id = b.id""")
def _(d):
    return (d.event.select("id", "church_id", "bulletin_id")
            .join(d.church.select(F.col("id").alias("church_id"), F.col("slug").alias("church_slug")), "church_id")
            .join(d.bulletin.select(F.col("id").alias("bulletin_id"), "source_url"), "bulletin_id")
            .select("id", "church_slug", "source_url"))


@query("agg_table_counts", """select 'parishes' as "table", count(*) as n from customer union all select 'churches', count(distinct slug) from church_rows
    union all select 'bulletins', count(distinct (parish_id, source_url)) filter (where source_url is not null) + count(*) filter (where source_url is null) from bulletin_rows
    union all select 'events', count(*) from event""")
def _(d):
    churches = d.church.select(F.col("id").alias("idx"), F.expr("'c-' || (id - case when id % 8 = 5 then 3 else 0 end)").alias("slug"))
    bulletins = d.bulletin.select(F.col("id").alias("idx"), "parish_id", F.expr(
        "case when source_url is not null then 'https://b.example.org/' || (id % 400) || '.pdf' end").alias("source_url"))
    return load.table_counts(d.parish, unique.first_wins(churches, ["slug"]),
                             unique.first_wins_null_free(bulletins, ["parish_id", "source_url"], "source_url"), d.event)


# --- work items and cache --------------------------------------------------------------------

def blobs(d):
    """The document store: one blob per driver document, at the path bulletins refer to."""
    return d.documents.select(F.expr("'/docs/' || doc_id || '.pdf'").alias("path"), F.encode("text", "UTF-8").alias("content"))


_stores: dict[tuple[str, str], str] = {}


def store(d):
    """The same as a clustered table, made once per application."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir)
    if key not in _stores:
        _stores[key] = scratch_path(d.spark, "document-store")
        docs.add_to_store(blobs(d), _stores[key], buckets=16)
    return docs.open_store(d.spark, _stores[key], buckets=16)


# besides the chosen documents of all parishes, some of a parish that is not known
define("work_entry", """select idx, parish_slug, pdf_path from work_choice
    union all select -1 - doc_id, 'gone-' || (doc_id % 7), '/docs/' || doc_id || '.pdf' from documents where doc_id % 9 = 0""")
define("work_row", """select w.idx, w.parish_slug, p.id as parish_id, d.doc_id, case when d.doc_id is null then 'document missing' when p.id is null then 'unknown parish' end as reason,
    case when p.id is not null then sha256(d.text) end as digest from work_entry w left join parish p on w.parish_slug = p.slug left join documents d on w.pdf_path = '/docs/' || d.doc_id || '.pdf'""")


def work(d):
    chosen = latest.to_process(d.metadata, ["idx", "source_url", "pdf_path", "content_hash", "processed_at"]).select("idx", "parish_slug", "pdf_path")
    strange = d.documents.where("doc_id % 9 = 0").selectExpr("-1 - doc_id as idx", "'gone-' || (doc_id % 7) as parish_slug", "'/docs/' || doc_id || '.pdf' as pdf_path")
    return written(docs.work_items(chosen.unionByName(strange), d.parish, d.church, store(d)), "work-items")


@query("join_workitems", """select w.idx, w.parish_slug, w.reason, case when w.reason is null then 'ready' else 'skipped' end as status,
    (select count(*) from church c where c.parish_id = w.parish_id) as n_churches from work_row w""")
def _(d):
    n = F.size(F.from_json("churches_json", "array<struct<slug:string>>"))
    return work(d).select("idx", "parish_slug", "reason", "status", n.cast("bigint").alias("n_churches"))


@query("src_documents", "select idx, case when reason is null then 'ready' else 'skipped' end as status, digest from work_row")
def _(d):
    items = work(d)
    found = docs.with_content(items, store(d)).select("idx", docs.content_hash(F.col("content")).alias("digest"))
    return items.select("idx", "status").join(found, "idx", "left")


def cache(d):
    """Cached results for the hashes of every third bulletin."""
    from belfry.functions.text import cache_version
    hashes = d.bulletin.where("content_hash is not null and id % 3 = 0").select("content_hash").distinct()
    return hashes.select(F.lit("stub").alias("classifier"), cache_version(F.lit("v1")).alias("version"), "content_hash",
                         F.lit(None).cast("boolean").alias("result"))


_CACHED = "content_hash in (select content_hash from bulletin where content_hash is not null and id % 3 = 0)"


@query("join_cache_hit", f"select idx, content_hash from work_choice where {_CACHED}")
def _(d):
    chosen = latest.to_process(d.metadata, ["idx", "content_hash"])
    return process.split_by_cache(chosen, process.cache_of(cache(d), "stub", "v1"))[0].select("idx", "content_hash")


@query("join_cache_miss_anti", f"select idx, content_hash, content_hash is null as unhashed from work_choice where content_hash is null or not {_CACHED}")
def _(d):
    chosen = latest.to_process(d.metadata, ["idx", "content_hash"])
    return process.split_by_cache(chosen, process.cache_of(cache(d), "stub", "v1"))[1].select(
        "idx", "content_hash", F.col("content_hash").isNull().alias("unhashed"))


# --- set operations --------------------------------------------------------------------------

_RUN_KEYS = """select distinct bulletin_source_url, church_slug, event_type, event_kind, day_of_week, date, start_time, end_time, cancelled
    from run_event where classifier = '{0}'"""
_KEYS = ["bulletin_source_url", "church_slug", "event_type", "event_kind", "day_of_week", "date", "start_time", "end_time", "cancelled"]


def run_keys(d, name):
    return d.run_event.where(F.col("classifier") == name).select(*_KEYS)


@query("set_intersect_keys", f"{_RUN_KEYS.format('alpha')} intersect {_RUN_KEYS.format('beta')}")
def _(d):
    return run_keys(d, "alpha").intersect(run_keys(d, "beta"))


@query("set_union_keys", f"{_RUN_KEYS.format('alpha')} union {_RUN_KEYS.format('beta')}")
def _(d):
    return run_keys(d, "alpha").union(run_keys(d, "beta")).distinct()


@query("set_except_urls", """(select 'alpha' as side, bulletin_source_url from (select bulletin_source_url from run_manifest where classifier = 'alpha' except select bulletin_source_url from run_manifest where classifier = 'beta'))
    union all (select 'beta', bulletin_source_url from (select bulletin_source_url from run_manifest where classifier = 'beta' except select bulletin_source_url from run_manifest where classifier = 'alpha'))""")
def _(d):
    urls = lambda n: d.run_manifest.where(F.col("classifier") == n).select("bulletin_source_url")
    one = lambda a, b: urls(a).subtract(urls(b)).select(F.lit(a).alias("side"), "bulletin_source_url")
    return one("alpha", "beta").unionByName(one("beta", "alpha"))


@query("set_union_all_events", "select bulletin_source_url, count(*) as n from (select bulletin_source_url from run_event where classifier = 'alpha' union all select bulletin_source_url from run_event where classifier = 'beta') group by all")
def _(d):
    both = run_keys(d, "alpha").unionByName(run_keys(d, "beta"))
    return both.groupBy("bulletin_source_url").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_sections", """select id, event_kind, cancelled, event_type, count(*) as n from payload_event group by all""")
def _(d):
    from belfry.functions import payload
    events = payload.read_payload(F.col("payload"), payload.lenient_result)["events"]
    rows = d.payload.select("id", F.explode(events).alias("e"))
    return rows.groupBy("id", F.col("e.kind").alias("event_kind"), "e.cancelled", F.col("e.type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


