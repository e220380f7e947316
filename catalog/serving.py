"""Map, search, church-page and site checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from belfry.operators import filters, search
from belfry.plans import serve, site
from catalog.functions import d_iso_weekday, d_occurrence, d_weekday, today
from catalog.registry import define, query

ORIGIN, BUILD = "https://s.example.org", "2001-12-31"
DAYS, FROM, TO, TYPES = [0, 4, 6], 360, 1200, ["mass", "adoration"]


def d_slot(e: str = "") -> str:
    return f"""case when {e}event_kind = 'weekly' and {e}day_of_week <> '' then coalesce({d_weekday(e + 'day_of_week')}, 8)
      when {e}event_kind = 'specific_date' and {e}date <> '' then {d_iso_weekday(e + 'date')} else 7 end"""


_MATCH = f"cancelled = 0 and {d_slot()} in (0, 4, 6, 7) and start_time between {FROM} and {TO}"


@query("flt_event_match", f"select id, {_MATCH} as matches from event")
def _(d):
    return d.event.select("id", filters.event_matches(DAYS, FROM, TO).alias("matches"))


@query("flt_event_types", "select id, event_type from event where event_type in ('mass', 'confession', 'adoration')")
def _(d):
    return d.event.where(filters.of_types([])).select("id", "event_type")


@query("flt_saved_filters", """select filter_id, event_type, array_to_string(days, ',') as days, time_from, time_to from decoded_filter""")
def _(d):
    f = filters.decode_filters(d.saved_filter)
    return f.select("filter_id", "event_type", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"), "time_from", "time_to")


@query("flt_full_day_range", """select filter_id, case when not (time_from <= 0 and time_to >= 1439) then time_from end as lo,
    case when not (time_from <= 0 and time_to >= 1439) then time_to end as hi from decoded_filter""")
def _(d):
    lo, hi = filters.time_range(F.col("time_from"), F.col("time_to"))
    return filters.decode_filters(d.saved_filter).select("filter_id", lo.alias("lo"), hi.alias("hi"))


_hhmm = lambda c: f"lpad(cast({c} // 60 as varchar), 2, '0') || lpad(cast({c} % 60 as varchar), 2, '0')"


@query("prj_encode_filters", f"""select filter_id, concat_ws('&', 'z=' || (filter_id % 18), case when event_type <> 'mass' then 'type=' || event_type end,
    case when len(days) > 0 then 'days=' || array_to_string(list_transform(days, lambda i: ['mon','tue','wed','thu','fri','sat','sun'][i + 1]), '%2C') end,
    case when time_from > 0 then 'from=' || {_hhmm('time_from')} end, case when time_to < 1439 then 'to=' || {_hhmm('time_to')} end) as params from decoded_filter""")
def _(d):
    return filters.decode_filters(d.saved_filter).select("filter_id", filters.encode_filters(F.col("url")).alias("params"))


define("different_filter", "select min(filter_id) as filter_id, event_type, days, time_from, time_to, count(*) as n_saved from decoded_filter group by event_type, days, time_from, time_to")


@query("flt_filters_distinct", "select filter_id, event_type, array_to_string(days, ',') as days, time_from, time_to, n_saved from different_filter")
def _(d):
    return filters.distinct_filters(filters.decode_filters(d.saved_filter)).withColumn(
        "days", F.array_join(F.col("days").cast("array<string>"), ","))


@query("join_filters_events", f"""select f.filter_id, e.church_id, count(*) as n_events from different_filter f join (select *, {d_slot()} as slot from snapshot_event) e
    on e.cancelled = 0 and e.event_type = f.event_type and (len(f.days) = 0 or e.slot = 7 or list_contains(f.days, e.slot)) and e.start_time between f.time_from and f.time_to group by all""")
def _(d):
    return filters.match_filters(d.snapshot_event, filters.distinct_filters(filters.decode_filters(d.saved_filter)))


# --- map query -------------------------------------------------------------------------------

define("map_hit", f"select * from snapshot_event where event_type in ('mass', 'adoration') and {_MATCH}")
define("popup_first", """select * from (select *, row_number() over (partition by church_id, lower(day_of_week), start_time order by id) as rn
    from map_hit where event_kind = 'weekly' and day_of_week <> '') where rn = 1""")
define("popup_soon", f"""select * from (select *, row_number() over (partition by church_id order by next_occurrence, id) as rn from
    (select *, {d_occurrence()} as next_occurrence from map_hit) where next_occurrence is not null) where rn <= 5""")


def hits(d):
    return serve.matching_events(d.snapshot_event, TYPES, DAYS, FROM, TO)


@query("win_popup_dedupe", "select id, church_id from popup_first")
def _(d):
    return serve.popup_weekly(hits(d)).select("id", "church_id")


@query("win_popup_soonest5", "select id, church_id, next_occurrence from popup_soon")
def _(d):
    return serve.popup_soonest(serve.with_occurrence(hits(d), today())).select("id", "church_id", "next_occurrence")


@query("join_church_events", "select c.id, count(e.id) as n_events from church c join map_hit e on e.church_id = c.id group by c.id")
def _(d):
    per = hits(d).groupBy(F.col("church_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"))
    return d.church.join(per, "id").select("id", "n_events")


@query("agg_event_types", "select church_id, string_agg(distinct event_type, ',' order by event_type) as types from map_hit group by church_id")
def _(d):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return hits(d).groupBy("church_id").agg(kinds.alias("types"))


_KEY = """case when event_kind = 'specific_date' and date <> '' then 2 when coalesce(wd, '') = '' then 1 else 0 end"""


def d_ranked(source: str) -> str:
    wd = "coalesce(case when event_kind = 'weekly' and day_of_week <> '' then lower(day_of_week) end, lower(dayname(cast(date as date))))"
    index = "(list_position(['sunday','monday','tuesday','wednesday','thursday','friday','saturday'], wd) - 1)"
    return f"""select *, {_KEY} as g, case when {_KEY} = 0 then case when wd = 'sunday' then start_time
        when wd = 'saturday' and start_time >= 960 then 1000 + start_time else 2000 + coalesce({index}, -1) * 1000 + start_time end else 0 end as k,
      case when {_KEY} = 2 then date else '' end as kd, case when {_KEY} = 2 then start_time else 0 end as ks
      from (select *, {wd} as wd from {source})"""


@query("srt_schedule", f"select id, g, k, kd, ks from ({d_ranked('event')})")
def _(d):
    key = serve.sort_key()
    return d.event.select("id", key.alias("r")).select(
        "id", F.col("r.group").alias("g"), F.col("r.key").alias("k"), F.col("r.date").alias("kd"), F.col("r.start").alias("ks"))


define("popup_row", f"""select church_id, id, g, k, kd, ks from ({d_ranked('popup_first')})
    union all select church_id, id, 0, 0, next_occurrence, 0 from popup_soon where church_id not in (select church_id from popup_first)""")


@query("agg_popup_schedule", "select church_id, string_agg(cast(id as varchar), ',' order by g, k, kd, ks, id) as ids from popup_row group by church_id")
def _(d):
    popup = serve.popup_events(hits(d), today())
    ordered = F.array_sort(F.collect_list(F.struct("rank_key", "id")))
    return popup.groupBy("church_id").agg(F.array_join(F.transform(ordered, lambda e: e["id"].cast("string")), ",").alias("ids"))


@query("pipe_map_query", """select c.id, c.slug, c.name, c.latitude, t.types, coalesce(p.ids, '') as ids from church c
    join (select church_id, string_agg(distinct event_type, ',' order by event_type) as types from map_hit group by church_id) t on t.church_id = c.id
    left join (select church_id, string_agg(cast(id as varchar), ',' order by g, k, kd, ks, id) as ids from popup_row group by church_id) p on p.church_id = c.id""")
def _(d):
    out = serve.map_query(d.church, d.snapshot_event, today(), types=TYPES, days=DAYS, time_from=FROM, time_to=TO)
    return out.select("id", "slug", "name", "latitude", F.array_join("event_types", ",").alias("types"), F.array_join(
        F.transform("upcoming_events", lambda e: e["id"].cast("string")), ",").alias("ids"))


_SUMMARY = f"""id, event_type as "type", event_kind as kind, day_of_week, date, start_time, end_time, cancelled = 1 as cancelled, {d_occurrence()} as next_occurrence, page_number, note"""


@query("prj_event_summary", f"select {_SUMMARY} from event")
def _(d):
    return serve.with_occurrence(d.event, today()).select(*serve.event_summary())


@query("src_snapshot_events", f"select {_SUMMARY} from snapshot_event")
def _(d):
    return serve.with_occurrence(d.snapshot_event, today()).select(*serve.event_summary())


@query("srt_church_events", f"""select church_id, id, g, k, kd, ks from ({d_ranked(f'(select * from event where ({d_occurrence()}) is not null)')})""")
def _(d):
    rows = serve.upcoming(d.event, today()).orderBy("church_id", "rank_key", "id")
    return rows.select("church_id", "id", F.col("rank_key.group").alias("g"), F.col("rank_key.key").alias("k"),
                       F.col("rank_key.date").alias("kd"), F.col("rank_key.start").alias("ks"))


@query("join_church_by_slug_events", f"select {_SUMMARY} from event where church_id = (select id from church where slug = 'c-10') and event_type in ('mass', 'confession') and ({d_occurrence()}) is not null")
def _(d):
    return serve.church_events(d.church, d.event, "c-10", today(), ["mass", "confession"])


@query("pipe_church_page", f"""select c.slug, c.name, c.homepage_url, c.bulletin_url, e.id as event_id, ({d_occurrence('e.')}) as next_occurrence from snap_church c
    left join (select * from event where ({d_occurrence()}) is not null) e on e.church_id = c.id where c.slug = 'c-13'""")
def _(d):
    from belfry.plans.snapshot import snapshot_church
    detail, rows = serve.church_page(snapshot_church(d.church, d.parish, d.bulletin), d.event, "c-13", today())
    listed = rows.select(F.col("id").alias("event_id"), "next_occurrence", F.lit("c-13").alias("slug"))
    return detail.join(listed, "slug", "left").select("slug", "name", "homepage_url", "bulletin_url", "event_id", "next_occurrence")


@query("agg_partition_by_type_day", """select id, church_id, event_type, case when event_kind = 'weekly' and day_of_week <> '' then lower(day_of_week) else 'specific_date' end as section,
    case when event_kind = 'weekly' and day_of_week <> '' then '' else coalesce(date, '') end as sort_date,
    case when event_kind = 'weekly' and day_of_week <> '' then start_time else 0 end as sort_start from event""")
def _(d):
    return serve.partition_by_type_day(d.event).select("id", "church_id", "event_type", "section", "sort_date", "sort_start")


# --- search ----------------------------------------------------------------------------------

define("asked", """select n_nationkey as query_id, substr(n_name, 1, 3) || substr(n_name, 5) as query from nation
    union all select 1000 + s_suppkey, case s_suppkey % 5 when 0 then 'church ' || (s_suppkey % 97) when 1 then 'chuch ' || (s_suppkey % 97)
      when 2 then (s_suppkey % 400) || ' main' when 3 then ' MXin' else 'S' end from supplier""")
_W = [("name", 0.62), ("city", 0.13), ("state", 0.08), ("postal_code", 0.08), ("address_line1", 0.07), ("address_line2", 0.02)]
# every stretch of every text against every query, by edit distance
define("field_text", f"""select id as church_id, field, weight, lower(text) as t from (select id, unnest([{', '.join(f"'{f}'" for f, _ in _W)}]) as field,
    unnest([{', '.join(f"{w}::double" for _, w in _W)}]) as weight, unnest([{', '.join(f for f, _ in _W)}]) as text
    from church where latitude is not null and longitude is not null and name <> '') where trim(text) <> ''""")
define("stretch", """select q, t, min(levenshtein(q, substr(t, p::int + 1, n::int)) / length(q)::double + p / 100::double) as d
    from (select distinct lower(trim(query)) as q from asked where length(trim(query)) >= 2), (select distinct t from field_text),
      unnest(range(0, least(length(t), 41))) as starts(p), unnest(range(length(q) - length(q) * 2 // 5, length(q) + length(q) * 2 // 5 + 1)) as sizes(n)
    group by q, t having d <= 0.4""")


@query("top_search", """select query_id, rank, church_id, round(exp(-total), 6) as score from (select *, row_number() over (partition by query_id order by total desc, church_id) as rank from (
    select query_id, church_id, round(sum(-ln(case when q = t then 2.220446049250313e-16 else greatest(d, 0.001) end) * weight
        * round(1 / sqrt(len(list_filter(string_split(t, ' '), lambda w: w <> ''))), 3)), 9) as total
    from asked join stretch on q = lower(trim(query)) join field_text using (t) group by query_id, church_id)) where rank <= 10""")
def _(d):
    asked = d.nation.select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.substring("n_name", 1, 3), F.expr("substring(n_name, 5)")).alias("query"))
    asked = asked.unionByName(d.supplier.select((F.col("s_suppkey") + 1000).alias("query_id"), F.expr(
        """case s_suppkey % 5 when 0 then 'church ' || (s_suppkey % 97) when 1 then 'chuch ' || (s_suppkey % 97)
           when 2 then (s_suppkey % 400) || ' main' when 3 then ' MXin' else 'S' end""").alias("query")))
    return search.search(asked, d.church)


# --- site ------------------------------------------------------------------------------------

define("church_stamp", """select c.id, c.slug, max(coalesce(nullif(b.processed_at, ''), nullif(b.fetched_at, ''), nullif(b.published_date, ''), nullif(c.created_at, ''))) as last_modified
    from church c left join bulletin b on b.parish_id = c.parish_id group by c.id, c.slug, c.created_at""")


def stamps(d):
    return site.last_modified(d.church, d.bulletin)


@query("agg_lastmod", "select slug, last_modified from church_stamp")
def _(d):
    return stamps(d).select("slug", "last_modified")


@query("join_lastmod", """select c.id, count(b.id) as n_bulletins, max(b.fetched_at) as newest from church c left join bulletin b on b.parish_id = c.parish_id group by c.id""")
def _(d):
    per = d.bulletin.groupBy("parish_id").agg(F.count(F.lit(1)).alias("n"), F.max("fetched_at").alias("newest"))
    return d.church.join(per, "parish_id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_bulletins"), "newest")


@query("agg_site_lastmod", f"select coalesce(max(coalesce(substr(last_modified, 1, 10), '{BUILD}')), '{BUILD}') as lastmod from church_stamp")
def _(d):
    return site.site_lastmod(stamps(d), BUILD)


_LABEL = "case when trim(city) <> '' then city || coalesce(', ' || nullif(trim(state), ''), '') else 'Other locations' end"


@query("agg_group_by_city", f"""select label, name, slug, id from (select *, {_LABEL} as label
    from (select id, name, slug, state, case when id % 10 <> 0 then city end as city from church))""")
def _(d):
    return site.by_city(d.church.withColumn("city", F.when(F.expr("id % 10 <> 0"), F.col("city"))))


@query("prj_page_text", """select id, name || ' — Mass, Confession & Adoration Times in ' || city || ', ' || state as title,
    'Mass, Confession, and Adoration times for ' || name || ' in ' || city || ', ' || state || ', parsed from the parish''s latest weekly bulletin.' as description from church""")
def _(d):
    return d.church.select("id", site.page_title().alias("title"), site.page_description().alias("description"))


define("sitemap_row", f"""select 3 as section, '{ORIGIN}/churches/' || slug || '/' as loc, coalesce(substr(last_modified, 1, 10), '{BUILD}') as lastmod from church_stamp""")


@query("snk_sitemap", f"""select '  <url>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '    <lastmod>' || lastmod || '</lastmod>' || chr(10) || '  </url>' as line from (
    select * from sitemap_row union all select 0, '{ORIGIN}/', max(lastmod) from sitemap_row union all select 1, '{ORIGIN}/landing', '{BUILD}'
    union all select 2, '{ORIGIN}/churches/', max(lastmod) from sitemap_row)""")
def _(d):
    from belfry.session import scratch_path
    from belfry.sources.sinks import write_lines
    rows = site.sitemap_rows(stamps(d), ORIGIN, BUILD).withColumn("line", site.sitemap_line())
    path = scratch_path(d.spark, "sitemap")
    write_lines(rows, path, ["section", "loc"])
    lines = d.spark.read.option("lineSep", "  </url>\n").text(path)
    return lines.select(F.concat(F.col("value"), F.lit("  </url>")).alias("line"))


@query("prj_jsonld", f"""select id, '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[' ||
    '{{"@type":"ListItem","position":1,"name":"Times","item":"{ORIGIN}/"}},{{"@type":"ListItem","position":2,"name":"Parishes","item":"{ORIGIN}/churches/"}},' ||
    '{{"@type":"ListItem","position":3,"name":"' || name || '","item":"{ORIGIN}/churches/' || slug || '/"}}]}}' as trail_json,
    latitude is not null and longitude is not null as has_geo, coalesce(address_line1, '') <> '' as has_street from church""")
def _(d):
    pages = site.site_rows(d.church.join(d.parish.select(F.col("id").alias("parish_id"), "homepage_url"), "parish_id"), d.event, stamps(d), today(),
                           origin=ORIGIN, site_name="Times", build_date=BUILD)[0]
    place = F.col("place_json")
    return pages.select("id", "trail_json", F.get_json_object(place, "$.geo").isNotNull().alias("has_geo"),
                        F.coalesce(F.get_json_object(place, "$.address.streetAddress").rlike("Main St"), F.lit(False)).alias("has_street"))


@query("pipe_site_rows", f"""select s.slug, '{ORIGIN}/churches/' || s.slug || '/' as url, coalesce(substr(s.last_modified, 1, 10), '{BUILD}') as lastmod,
    (select count(*) from event e where e.church_id = s.id and ({d_occurrence('e.')}) is not null) as n_upcoming from church_stamp s""")
def _(d):
    church = d.church.join(d.parish.select(F.col("id").alias("parish_id"), "homepage_url"), "parish_id")
    pages, rows = site.site_rows(church, d.event, stamps(d), today(), origin=ORIGIN, site_name="Times", build_date=BUILD)
    per = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(per, "slug", "left").select("slug", "url", "lastmod", F.coalesce("n", F.lit(0)).alias("n_upcoming"))


