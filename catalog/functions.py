"""Scalar-function checks: dates, times, text, URLs, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from belfry.functions import dates, payload, text, times, urls
from belfry.operators import filters
from belfry.plans.process import flatten
from catalog.registry import define, query

REF = "1998-08-02"


def today():
    return F.lit(REF).cast("date")


# --- DuckDB spellings ------------------------------------------------------------------------

def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_minutes(x: str) -> str:
    n = (rf"regexp_replace(regexp_replace({d_strip(x)}, '(?i)a\.m\.?(\s|$)', 'AM\1', 'g'), "
         rf"'(?i)p\.m\.?(\s|$)', 'PM\1', 'g')")
    p = r"(?i)^(\d{1,2})(:(\d{2}))?\s*(AM|PM)$"
    h = f"try_cast(regexp_extract({n}, '{p}', 1) as int)"
    pm = f"upper(regexp_extract({n}, '{p}', 4)) = 'PM'"
    mins = f"coalesce(try_cast(regexp_extract({n}, '{p}', 3) as int), 0)"
    def clock(pattern: str) -> str:
        a, b = (f"try_cast(regexp_extract({n}, '{pattern}', {i}) as int)" for i in (1, 2))
        return f"when regexp_matches({n}, '{pattern}') then case when {a} <= 23 and {b} <= 59 then {a} * 60 + {b} end"
    return f"""case when lower({n}) = 'midnight' then 0 when lower({n}) = 'noon' then 720
      when regexp_matches({n}, '{p}') then
        (case when {pm} and {h} <> 12 then {h} + 12 when not {pm} and {h} = 12 then 0 else {h} end) * 60 + {mins}
      {clock(r"^(\d{1,2}):(\d{2})$")} {clock(r"^(\d{2})(\d{2})$")} end"""


def d_event_date(x: str) -> str:
    t = d_strip(x)
    return f"""cast(case when regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_cast({t} as date)
      else coalesce(try_strptime({t}, '%B %d, %Y'), try_strptime({t}, '%b %d, %Y'),
                    try_strptime({t}, '%m/%d/%Y'))::date end as varchar)"""


def d_weekday(x: str) -> str:
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return f"case lower({x}) " + " ".join(f"when '{d}' then {i}" for i, d in enumerate(days)) + " end"


def d_iso_weekday(x: str) -> str:
    return f"(isodow(cast({x} as date)) - 1)"


def d_next_day(e: str = "") -> str:
    """Next occurrence day as a date (weekly by weekday, dated when not past)."""
    idx = d_weekday(f"{e}day_of_week")
    ref = f"date '{REF}'"
    ahead = f"((({idx}) - {d_iso_weekday(ref)} + 7) % 7)"
    return f"""case when {e}event_kind = 'weekly' and {e}day_of_week <> '' then {ref} + cast({ahead} as integer)
      when {e}event_kind = 'specific_date' and {e}date <> '' and cast({e}date as date) >= {ref}
      then cast({e}date as date) end"""


def d_clock(x: str) -> str:
    return f"lpad(cast({x} // 60 as varchar), 2, '0') || ':' || lpad(cast({x} % 60 as varchar), 2, '0')"


def d_occurrence(e: str = "") -> str:
    return (f"case when {e}cancelled = 0 then cast(cast({d_next_day(e)} as date) as varchar) || 'T' || "
            f"{d_clock(e + 'start_time')} || ':00.000Z' end")


def d_missal(x: str) -> str:
    h = f"({x} // 60)"
    return (f"cast(case when {h} % 12 = 0 then 12 else {h} % 12 end as varchar) || "
            f"case when {x} % 60 = 0 then '' else ':' || lpad(cast({x} % 60 as varchar), 2, '0') end || "
            f"case when {h} < 12 then ' a.m.' else ' p.m.' end")


def d_ordinal_date(x: str) -> str:
    d = f"cast({x} as date)"
    return f"""strftime({d}, '%A, %B ') || cast(day({d}) as varchar) ||
      case when day({d}) between 11 and 13 then 'th' when day({d}) % 10 = 1 then 'st'
           when day({d}) % 10 = 2 then 'nd' when day({d}) % 10 = 3 then 'rd' else 'th' end"""


def d_address(p: str = "address_", q: str = "") -> str:
    return f"""concat_ws(', ', nullif({q}{p}line1, ''), nullif({q}{p}line2, ''), nullif({q}city, ''),
      nullif(concat_ws(' ', nullif({q}state, ''), nullif({q}postal_code, '')), ''))"""


def d_address_key(q: str = "", p: str = "address_") -> str:
    return " || '|' || ".join(f"coalesce({q}{c}, '')" for c in (f"{p}line1", f"{p}line2", "city", "state", "postal_code"))


def d_nearest(m: str, d: str) -> str:
    """Nearest valid day among last, this and next year; the earlier on ties."""
    year = REF[:4]
    cands = ", ".join(
        f"try_cast('{int(year) + k}-' || lpad(cast({m} as varchar), 2, '0') || '-' || lpad(cast({d} as varchar), 2, '0') as date)"
        for k in (-1, 0, 1))
    return (f"(select c from (select unnest([{cands}]) as c) where c is not null "
            f"order by abs(date_diff('day', c, date '{REF}')), c limit 1)")


# --- times -----------------------------------------------------------------------------------

@query("fn_time_to_minutes", f"select idx, {d_minutes('start_time')} as minutes from raw_event")
def _(d):
    return d.raw_event.select("idx", times.minutes_of_day(F.col("start_time")).alias("minutes"))


@query("fn_event_date", f"select idx, {d_event_date('date')} as iso from raw_event")
def _(d):
    return d.raw_event.select("idx", dates.event_date(F.col("date")).alias("iso"))


@query("fn_iso_shape", f"""select idx, case when regexp_matches({d_strip('date')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
       then {d_strip('date')} end as iso from raw_event""")
def _(d):
    return d.raw_event.select("idx", dates.iso_shape(F.col("date")).alias("iso"))


@query("fn_fmt_time", """select id, cast(case when start_time // 60 % 12 = 0 then 12 else start_time // 60 % 12 end as varchar)
       || ':' || lpad(cast(start_time % 60 as varchar), 2, '0') || case when start_time < 720 then ' AM' else ' PM' end as shown
       from event""")
def _(d):
    return d.event.select("id", times.format_time(F.col("start_time")).alias("shown"))


@query("fn_fmt_time_lower", f"""select id, {d_missal('start_time')} ||
       case when end_time is null then '' else ' – ' || {d_missal('end_time')} end as shown from event""")
def _(d):
    return d.event.select("id", times.format_time_range(F.col("start_time"), F.col("end_time")).alias("shown"))


@query("fn_hhmm", """select id, lpad(cast(start_time // 60 as varchar), 2, '0') || lpad(cast(start_time % 60 as varchar), 2, '0') as hhmm,
       start_time as back from event""")
def _(d):
    hhmm = times.to_hhmm(F.col("start_time"))
    return d.event.select("id", hhmm.alias("hhmm"), times.from_hhmm(hhmm, 0).alias("back"))


# --- dates -----------------------------------------------------------------------------------

_short_year = "try_cast(cast(2000 + y % 100 as varchar) || substr(iso, 5) as date)"
_relaxed = f"""case idx % 8 when 0 then cast(iso as date)
    when 1 then case when y % 100 between 1 and 31 then {d_nearest('m', 'y % 100')} else {_short_year} end
    when 2 then cast(iso as date) when 3 then {_short_year}
    when 4 then {d_nearest('m', 'd')} when 5 then {d_nearest('m', 'd')} when 7 then cast(iso as date) end"""


@query("fn_relaxed_date", f"select idx, cast({_relaxed} as varchar) as day from link_text")
def _(d):
    return d.link_text.select("idx", dates.relaxed_date(F.col("text"), today()).cast("string").alias("day"))


@query("fn_relaxed_date_multi", f"select idx, cast(coalesce({_relaxed}, cast(iso as date)) as varchar) as day from link_text")
def _(d):
    found = dates.relaxed_date_multi([F.col("text"), F.concat(F.lit("/files/"), F.col("iso"), F.lit(".pdf"))], today())
    return d.link_text.select("idx", found.cast("string").alias("day"))


@query("fn_month_number", "select idx, case when idx % 8 in (0, 1, 5) then m when idx % 8 = 7 then 2 end as month from link_text")
def _(d):
    word = F.regexp_extract("text", r"(?i)(?:Bulletin |Sunday, |^\d+ |^)([a-z]+)", 1)
    return d.link_text.select("idx", dates.month_number(word).alias("month"))


@query("fn_normalize_year", f"""select idx, case idx % 3 when 0 then 2000 + y % 100 when 1 then y else {REF[:4]} end as year
       from link_text""")
def _(d):
    written = F.when(F.col("idx") % 3 == 0, F.substring("iso", 3, 2)).when(
        F.col("idx") % 3 == 1, F.substring("iso", 1, 4)).otherwise("")
    return d.link_text.select("idx", dates.normalize_year(written, today()).alias("year"))


@query("fn_yearless_date", f"""select idx, cast({d_nearest('m', '(d + idx % 4)')} as varchar) as day from link_text""")
def _(d):
    return d.link_text.select("idx", dates.yearless_date(
        F.col("m"), F.col("d") + F.col("idx") % 4, today()).cast("string").alias("day"))


@query("fn_safe_date", """select idx, cast(try_cast(cast(y as varchar) || '-' || lpad(cast(m + idx % 3 as varchar), 2, '0') || '-' ||
       lpad(cast(d + idx % 4 as varchar), 2, '0') as date) as varchar) as day from link_text""")
def _(d):
    return d.link_text.select("idx", dates.safe_date(
        F.col("y"), F.col("m") + F.col("idx") % 3, F.col("d") + F.col("idx") % 4).cast("string").alias("day"))


@query("fn_within_days", f"select idx, abs(date_diff('day', cast(iso as date), date '{REF}')) <= 7 as near from link_text")
def _(d):
    return d.link_text.select("idx", dates.within_days(F.col("iso").cast("date"), today()).alias("near"))


@query("fn_next_weekly", f"""select id, cast(date '{REF}' + cast((({d_weekday('day_of_week')}) - {d_iso_weekday(f"'{REF}'")} + 7) % 7 as integer)
       as varchar) as day from event where day_of_week is not null""")
def _(d):
    return d.event.where("day_of_week is not null").select(
        "id", dates.next_weekly(F.col("day_of_week"), today()).cast("string").alias("day"))


@query("fn_next_specific", f"""select id, case when cast(date as date) >= date '{REF}' then date end as day
       from event""")
def _(d):
    return d.event.select(
        "id", dates.next_specific(F.col("date"), today()).cast("string").alias("day"))


@query("fn_next_occurrence", f"select id, {d_occurrence()} as next_occurrence from event")
def _(d):
    return d.event.select("id", dates.next_occurrence(
        *[F.col(c) for c in ("event_kind", "day_of_week", "date", "start_time", "cancelled")], today()
    ).alias("next_occurrence"))


@query("fn_weekday_index", f"""select id, {d_weekday('day_of_week')} as by_name,
       {d_iso_weekday('date')} as by_date from event""")
def _(d):
    return d.event.select("id", dates.weekday_index(F.col("day_of_week")).alias("by_name"),
                          F.weekday(dates.rolled_date(F.col("date"))).alias("by_date"))


@query("fn_filter_date", """select idx, cast(make_date(y, 1, 1) + to_months(m + cast(idx % 3 as integer) - 1)
       + to_days(d + cast(idx % 4 as integer) - 1) as date)::varchar as day from link_text""")
def _(d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    shifted = F.concat_ws("-", F.col("y").cast("string"), two(F.col("m") + F.col("idx") % 3), two(F.col("d") + F.col("idx") % 4))
    return d.link_text.select("idx", dates.rolled_date(F.concat(F.lit(" "), shifted)).cast("string").alias("day"))


@query("fn_lastmod_date", "select id, substr(fetched_at, 1, 10) as day, substr(processed_at, 1, 10) as done from bulletin")
def _(d):
    return d.bulletin.select("id", dates.lastmod_date(F.col("fetched_at")).alias("day"),
                             dates.lastmod_date(F.col("processed_at")).alias("done"))


@query("fn_fmt_date", f"select id, {d_ordinal_date('date')} as shown from event")
def _(d):
    return d.event.select("id", dates.format_date(F.col("date")).alias("shown"))


@query("fn_fmt_day", f"""select id, case when event_kind = 'weekly' and day_of_week <> ''
       then upper(day_of_week[1]) || substr(day_of_week, 2) || 's' when date <> '' then {d_ordinal_date('date')} else '' end as shown from event""")
def _(d):
    return d.event.select("id", dates.format_day(F.col("event_kind"), F.col("day_of_week"), F.col("date")).alias("shown"))


# --- text ------------------------------------------------------------------------------------

@query("fn_format_address", f"select id, {d_address()} as address, nullif({d_address()}, '') as shown from church")
def _(d):
    address = text.format_address(*[F.col(c) for c in ("address_line1", "address_line2", "city", "state", "postal_code")])
    return d.church.select("id", address.alias("address"), text.empty_to_null(address).alias("shown"))


@query("fn_address_key", f"select id, {d_address_key()} as address_key from church")
def _(d):
    return d.church.select("id", text.address_key(*[F.col(c) for c in (
        "address_line1", "address_line2", "city", "state", "postal_code")]).alias("address_key"))


define("written_address", """select id, case id % 4 when 0 then ' ' || id % 400 || ' Main St, Suite 2, Town ' || id % 7 || ', NY ' || (10000 + id % 90)
    when 1 then id % 400 || ' Main St, ' || city || ', NY ' || (10000 + id % 90) || '-0001'
    when 2 then city || ' near the mill' else '  ' end as address from church""")


@query("fn_parse_address", r"""select id,
    case when regexp_matches(trim(address), p) then trim(regexp_extract(trim(address), p, 1)) else nullif(trim(address), '') end as line1,
    case when regexp_matches(trim(address), p) then trim(regexp_extract(trim(address), p, 2)) end as city,
    case when regexp_matches(trim(address), p) then regexp_extract(trim(address), p, 3) end as state,
    case when regexp_matches(trim(address), p) then regexp_extract(trim(address), p, 4) end as postal_code
    from (select *, '^(.+?),\s*(.+?),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$' as p from written_address)""")
def _(d):
    n = lambda e: F.expr(f"cast({e} as string)")
    written = (F.when(F.expr("id % 4 = 0"), F.concat(F.lit(" "), n("id % 400"), F.lit(" Main St, Suite 2, Town "), n("id % 7"),
                                                     F.lit(", NY "), n("10000 + id % 90")))
               .when(F.expr("id % 4 = 1"), F.concat(n("id % 400"), F.lit(" Main St, "), F.col("city"), F.lit(", NY "),
                                                    n("10000 + id % 90"), F.lit("-0001")))
               .when(F.expr("id % 4 = 2"), F.concat(F.col("city"), F.lit(" near the mill"))).otherwise("  "))
    parsed = d.church.select("id", text.parse_address(written).alias("a"))
    return parsed.select("id", "a.line1", "a.city", "a.state", "a.postal_code")


@query("fn_event_key", """select idx, coalesce(church_slug, '') as church_slug, coalesce(event_type, '') as event_type,
    coalesce(event_kind, '') as event_kind, day_of_week, date, coalesce(start_time, '') as start_time, end_time,
    coalesce(cancelled, false) as cancelled from raw_event""")
def _(d):
    return d.raw_event.select("idx", text.event_key().alias("k")).select("idx", "k.*")


@query("fn_weekly_key", """select distinct church_id, event_type, coalesce(day_of_week, '') as day_of_week, start_time
    from event where lower(event_kind) = 'weekly'""")
def _(d):
    return d.event.where(F.lower("event_kind") == "weekly").select(text.weekly_key().alias("k")).select("k.*").distinct()


@query("fn_event_line", """select idx, concat_ws(' | ', nullif(church_slug, ''), concat_ws(' ', event_type, event_kind),
    coalesce(date, day_of_week), concat_ws('-', nullif(start_time, ''), nullif(end_time, '')),
    case when cancelled then 'cancelled' end, 'page ' || page_number, nullif(note, '')) as line from raw_event""")
def _(d):
    return d.raw_event.select("idx", text.event_line().alias("line"))


@query("fn_cache_version", r"""select p_partkey, regexp_replace(substr(raw, 1, 80), '[^\pL\pN._-]', '_', 'g') || '-' || substr(sha256(raw), 1, 12) as v
    from (select p_partkey, coalesce(nullif(trim(p_name || ' / ' || p_brand), ''), 'unknown') as raw from part)""")
def _(d):
    return d.part.select("p_partkey", text.cache_version(F.concat("p_name", F.lit(" / "), F.col("p_brand"), F.lit(" "))).alias("v"))


@query("fn_note", "select id, nullif(trim(note), '') as note from event")
def _(d):
    return d.event.select("id", text.blank_to_null(F.col("note")).alias("note"))


@query("fn_csv_bool", """select id, case when id % 3 = 0 then 1 when id % 3 = 1 then 0 else 0 end as flag from church""")
def _(d):
    written = F.when(F.expr("id % 3 = 0"), " TRUE ").when(F.expr("id % 3 = 1"), "yes").otherwise("")
    return d.church.select("id", text.csv_bool(written).alias("flag"))


@query("fn_csv_float", "select id, latitude from church")
def _(d):
    written = F.coalesce(F.concat(F.lit(" "), F.col("latitude").cast("string")), F.lit(" "))
    return d.church.select("id", text.csv_float(written).alias("latitude"))


@query("fn_verify_flag", """select id, case when id % 3 = 0 then 'true' else 'false' end as flag from church""")
def _(d):
    status = F.when(F.expr("id % 3 = 0"), "verified").when(F.expr("id % 3 = 1"), "incorrect")
    return d.church.select("id", text.verify_flag(status).alias("flag"))


@query("fn_title_case", "select id, upper(substr(lower(day_of_week), 1, 1)) || substr(lower(day_of_week), 2) as shown from event")
def _(d):
    return d.event.select("id", text.title_case(F.lower("day_of_week")).alias("shown"))


@query("fn_xml_escape", """select page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as digest
    from pages""")
def _(d):
    return d.pages.select("page_id", F.md5(text.xml_escape(F.col("html"))).alias("digest"))


@query("fn_canonical_url", "select doc_id, 'https://s.example.org/churches/' || url_encode(source || ' ' || lang) || '/' as loc from documents")
def _(d):
    return d.documents.select("doc_id", urls.canonical_url(
        "https://s.example.org", F.concat("source", F.lit(" "), F.col("lang"))).alias("loc"))


@query("fn_content_hash", "select doc_id, sha256(text) as content_hash from documents")
def _(d):
    return d.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


@query("fn_type_guard", """select id, case when id % 3 = 0 then slug end as as_text,
    case when id % 3 = 1 then cast(id as double) when id % 3 = 2 then id + 0.5 end as as_number from church""")
def _(d):
    doc = F.when(F.expr("id % 3 = 0"), F.concat(F.lit('{"v":"'), F.col("slug"), F.lit('"}'))).otherwise(
        F.concat(F.lit('{"v":'), F.col("id").cast("string"), F.when(F.expr("id % 3 = 2"), ".5").otherwise(""), F.lit("}")))
    v = payload.get(payload.parse_object(doc), "v")
    number = F.when(payload.kind_of(v) != "STRING", F.try_variant_get(v, "$", "double"))
    return d.church.select("id", payload.text_of(v).alias("as_text"), number.alias("as_number"))


@query("fn_filter_label", f"""select filter_id, case when not (event_type = 'mass' and len(days) = 0 and full_day) then concat_ws(' · ',
      upper(event_type[1]) || substr(event_type, 2),
      case when len(days) = 0 then null when len(days) <= 3 then array_to_string(list_transform(days, lambda i:
        ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][i + 1]), ' · ') else len(days) || ' days' end,
      case when not full_day then {d_missal('time_from')} || ' – ' || {d_missal('time_to')} end) end as label
    from (select *, time_from <= 0 and time_to >= 1439 as full_day from decoded_filter)""")
def _(d):
    return filters.decode_filters(d.saved_filter).select("filter_id", filters.filter_label().alias("label"))


_tokens = "list_transform(string_split(days_text, ','), lambda t: lower(trim(t)))"
_minute = lambda c, dflt: rf"""case when regexp_matches({c}, '^\d{{4}}$') and {c}[1:2]::int <= 24 and {c}[3:4]::int < 60
    then least({c}[1:2]::int * 60 + {c}[3:4]::int, 1439) else {dflt} end"""
define("decoded_filter", f"""select filter_id, url, case when kind in ('mass', 'confession', 'adoration') then kind else 'mass' end as event_type,
    list_sort(list_distinct(list_filter(list_transform({_tokens}, lambda t:
      case t when 'mon' then 0 when 'tue' then 1 when 'wed' then 2 when 'thu' then 3 when 'fri' then 4
             when 'sat' then 5 when 'sun' then 6 end), lambda i: i is not null))) as days,
    {_minute('from_text', 0)} as time_from, {_minute('to_text', 1439)} as time_to
    from (select filter_id, url, regexp_extract(url, 'type=([^&]*)', 1) as kind, regexp_extract(url, 'days=([^&]*)', 1) as days_text,
      regexp_extract(url, 'from=([^&]*)', 1) as from_text, regexp_extract(url, 'to=([^&]*)', 1) as to_text from saved_filter)""")


# --- URLs and pages --------------------------------------------------------------------------

define("anchor_list", """select page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href,
    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as label,
    unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) as pos from pages""")
define("page_origin", "select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) as origin from pages")


@query("fn_anchors", "select page_id, pos, href, trim(label) as text from anchor_list")
def _(d):
    from belfry.sources.pages import page_anchors
    return page_anchors(d.pages, ["page_id"])


@query("fn_resolve_url", "select page_id, pos, origin || href as target from anchor_list join page_origin using (page_id)")
def _(d):
    from belfry.sources.pages import page_anchors
    return page_anchors(d.pages, ["page_id", "url"]).select(
        "page_id", "pos", urls.resolve_url(F.col("url"), F.col("href")).alias("target"))


KEYWORDS = [("example.org", "orgsite"), ("example.net", "netsite"), ("blog.", "blogsite")]
ID_PATTERNS = [r"(?i)blog\.([a-z0-9-]+)\.example", r"(?i)&copy; ([a-z0-9-]+)\."]
define("page_verdict", """select page_id, url, provider,
    case when provider = 'netsite' then coalesce(nullif(regexp_extract(html, '(?i)blog\\.([a-z0-9-]+)\\.example', 1), ''),
      nullif(regexp_extract(html, '(?i)&copy; ([a-z0-9-]+)\\.', 1), '')) end as provider_id
    from (select *, case when contains(lower(html), 'example.org') then 'orgsite' when contains(lower(html), 'example.net') then 'netsite'
      when contains(lower(html), 'blog.') then 'blogsite' else 'other' end as provider from pages)""")


@query("fn_detect_provider", "select page_id, provider, provider_id from page_verdict")
def _(d):
    v = urls.detect_provider(F.col("html"), KEYWORDS, "netsite", ID_PATTERNS)
    return d.pages.select("page_id", v.alias("v")).select("page_id", "v.provider", "v.provider_id")


@query("fn_provider_id", """select page_id, coalesce(nullif(regexp_extract(html, '(?i)blog\\.([a-z0-9-]+)\\.example', 1), ''),
    nullif(regexp_extract(html, '(?i)&copy; ([a-z0-9-]+)\\.', 1), '')) as provider_id from pages""")
def _(d):
    return d.pages.select("page_id", urls.provider_id(F.col("html"), ID_PATTERNS).alias("provider_id"))


define("hosted_link", """select idx, case idx % 4 when 0 then 'https://files.ecatholic.com/7/bulletins/' || iso || '.pdf'
    when 1 then '//FILES.ecatholic.com/7/Bulletins/' || iso || '.PDF' when 2 then 'https://files.ecatholic.com/7/news/' || iso || '.pdf'
    else '/bulletins/' || iso || '.pdf' end as ecatholic,
    case idx % 3 when 0 then 'https://bulletins.discovermass.com/download.php?bulletin=' || iso
    when 1 then 'https://bulletins.discovermass.com/download.php?bulletin=' else 'https://discovermass.com/download.php?bulletin=' || iso end as discover,
    case idx % 3 when 0 then '/publication-page/abc?selectedPublication=https%253A%252F%252Fcontainer.parishesonline.com%252F' || iso || '%252Bx.pdf'
    when 1 then '/publication-page/abc?selectedPublication=https%3A%2F%2Fcontainer.parishesonline.com%2F' || iso || '.doc'
    else '/publication-page/other?selectedPublication=' || iso end as online, iso from link_text""")


def hosted(d):
    iso = F.col("iso")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    m = lambda n, k: F.col("idx") % n == k
    return d.link_text.select(
        "idx",
        F.when(m(4, 0), c("https://files.ecatholic.com/7/bulletins/", iso, ".pdf"))
        .when(m(4, 1), c("//FILES.ecatholic.com/7/Bulletins/", iso, ".PDF"))
        .when(m(4, 2), c("https://files.ecatholic.com/7/news/", iso, ".pdf"))
        .otherwise(c("/bulletins/", iso, ".pdf")).alias("ecatholic"),
        F.when(m(3, 0), c("https://bulletins.discovermass.com/download.php?bulletin=", iso))
        .when(m(3, 1), "https://bulletins.discovermass.com/download.php?bulletin=")
        .otherwise(c("https://discovermass.com/download.php?bulletin=", iso)).alias("discover"),
        F.when(m(3, 0), c("/publication-page/abc?selectedPublication=https%253A%252F%252Fcontainer.parishesonline.com%252F", iso, "%252Bx.pdf"))
        .when(m(3, 1), c("/publication-page/abc?selectedPublication=https%3A%2F%2Fcontainer.parishesonline.com%2F", iso, ".doc"))
        .otherwise(c("/publication-page/other?selectedPublication=", iso)).alias("online"))


@query("fn_ecatholic_url", """select idx, case idx % 4 when 0 then ecatholic when 1 then 'https:' || ecatholic end as url from hosted_link""")
def _(d):
    return hosted(d).select("idx", urls.ecatholic_url(F.lit("https://p.example.org/bulletins"), F.col("ecatholic")).alias("url"))


@query("fn_discover_url", "select idx, case when idx % 3 = 0 then discover end as url from hosted_link")
def _(d):
    return hosted(d).select("idx", urls.discover_url(F.lit("https://discovermass.com/church/x/"), F.col("discover")).alias("url"))


@query("fn_parishes_online_url", """select idx, case when idx % 3 = 0 then 'https://parishesonline.com' || online end as source_url,
    case when idx % 3 = 0 then 'https://container.parishesonline.com/' || iso || '+x.pdf' end as fetch_url from hosted_link""")
def _(d):
    base = F.lit("https://parishesonline.com/organization/abc")
    return hosted(d).select("idx", urls.parishes_online_url(base, F.col("online"), F.lit("abc")).alias("u")).select(
        "idx", "u.source_url", "u.fetch_url")


# --- payloads --------------------------------------------------------------------------------

# What the payloads of the fixture must give, told from the typed events (never from the JSON).
define("payload_event", """select b.id, 'c-' || e.church_id as church_slug, e.event_type, e.event_kind,
    case when e.event_kind = 'weekly' then e.day_of_week end as day_of_week, e.date,
    lpad(cast(e.start_time // 60 as varchar), 2, '0') || ':' || lpad(cast(e.start_time % 60 as varchar), 2, '0') as start_time,
    e.event_kind <> 'weekly' and e.cancelled = 1 as cancelled, e.page_number
    from event e join bulletin b on e.bulletin_id = b.id
    where b.id % 10 <> 2 and (e.event_kind <> 'weekly' or e.day_of_week is not null)""")
_EVENT_COLS = "id, church_slug, event_type, event_kind, day_of_week, date, start_time, cancelled, page_number"


def _events_of(result, df):
    rows = df.select("id", F.explode(result["events"]).alias("e"))
    return rows.select("id", "e.church_slug", F.col("e.type").alias("event_type"), F.col("e.kind").alias("event_kind"),
                       "e.day_of_week", "e.date", "e.start_time", "e.cancelled", "e.page_number")


@query("fn_reconstruct", f"select {_EVENT_COLS} from payload_event where id % 10 > 2")
def _(d):
    read = payload.read_payload(F.col("payload"), lambda root, slots: F.struct(
        payload.is_valid(root, slots).alias("valid"), payload.strict_result(root, slots)["events"].alias("events")))
    return _events_of(F.col("r"), text.bound(d.view("payload").select("id", "payload"), r=read).where("r.valid"))


@query("fn_reconstruct_lenient", f"select {_EVENT_COLS} from payload_event")
def _(d):
    read = payload.read_payload(F.col("payload"), payload.lenient_result)
    return _events_of(F.col("r"), text.bound(d.view("payload").select("id", "payload"), r=read))


@query("fn_strict_or_lenient", """select p.id, p.id % 10 > 2 as valid, count(e.id) as n_events, p.id % 10 = 3 as wrong_bulletin,
    p.id % 10 <> 2 and p.id % 4 = 0 as needs_review,
    case when p.id % 10 <> 2 then b.published_date end as published_date
    from (select distinct bulletin_id as id from event where bulletin_id is not null) p
    join bulletin b on p.id = b.id left join payload_event e on e.id = p.id group by all""")
def _(d):
    rows = d.payload.select("id", payload.payload_reading(F.col("payload")).alias("p"),
                            F.try_parse_json("payload").isNotNull().alias("json"))
    return rows.select("id", (F.col("json") & F.col("p.valid")).alias("valid"), F.size("p.result.events").alias("n_events"),
                       "p.result.wrong_bulletin", F.col("p.result.church_list_needs_review").alias("needs_review"),
                       "p.result.published_date")


@query("fn_parse_json_object", """select id, case when id % 10 = 2 then 0 when id % 10 = 0 then 7 else 6 end as n_keys
    from (select distinct bulletin_id as id from event where bulletin_id is not null)""")
def _(d):
    return d.payload.select("id", F.size(payload.parse_object(F.col("payload"))).alias("n_keys"))


@query("fn_flatten", """select id, church_slug, 'https://b.example.org/' || id || '.pdf' as bulletin_source_url, event_type, event_kind,
    day_of_week, date, start_time, cancelled, page_number from payload_event where id % 10 <> 3""")
def _(d):
    named = d.view("payload").select("id", F.concat(F.lit("https://b.example.org/"), F.col("id").cast("string"), F.lit(".pdf")).alias("source_url"), "payload")
    results = text.bound(named, result=payload.payload_result(F.col("payload"))).drop("payload")
    return flatten(results, ["id"]).drop("end_time", "note")


define("verdict_row", """select c.id, c.parish_id, c.slug,
    case c.id % 4 when 0 then 'verified' when 1 then 'incorrect' when 2 then 'unverifiable' else 'maybe' end as raw_name_status,
    case c.id % 5 when 0 then 'incorrect' else 'verified' end as address_status, 'New ' || c.name as new_name, 'New Street ' || c.id as new_line1
    from church c where c.id % 7 <> 0""")


def verify_payload(church):
    """One verification payload per parish, as an extractor would return it."""
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    n = F.col("id").cast("string")
    status = F.when(F.expr("id % 4 = 0"), "verified").when(F.expr("id % 4 = 1"), "incorrect").when(
        F.expr("id % 4 = 2"), "unverifiable").otherwise("maybe")
    old = c('{"church_slug":', F.when(F.expr("id % 7 = 0"), '" "').otherwise(c('"', F.col("slug"), '"')),
            ',"name_status":"', status, '","address_status":"', F.when(F.expr("id % 5 = 0"), "incorrect").otherwise("verified"),
            '","corrected_name":"New ', F.col("name"), '","corrected_address":{"line1":"New Street ', n, '"}}')
    new = F.when(F.expr("id % 6 = 0"), c('{"name":"Chapel ', n, '","slug":"n-', F.expr("cast(id % 50 as string)"), '","address":null}'))
    rows = church.groupBy("parish_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", old.alias("o")))), lambda r: r["o"]), ",").alias("old"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", new.alias("o")))), lambda r: r["o"]), ",").alias("new"))
    return rows.select("parish_id", c('{"existing_churches":[', F.col("old"), '],"new_churches":[', F.col("new"), "]}").alias("payload"))


@query("fn_verification_lenient", """select parish_id, slug as church_slug, case when raw_name_status = 'maybe' then 'unverifiable' else raw_name_status end as name_status,
    address_status, case when raw_name_status = 'incorrect' then new_name end as corrected_name,
    case when address_status = 'incorrect' then new_line1 end as corrected_line1 from verdict_row""")
def _(d):
    rows = verify_payload(d.church).select("parish_id", F.explode(payload.verification_result(F.col("payload"))["existing_churches"]).alias("v"))
    return rows.select("parish_id", "v.church_slug", "v.name_status", "v.address_status", "v.corrected_name",
                       F.col("v.corrected_address.line1").alias("corrected_line1"))


_QUOTED = lambda x: f"'\"' || {x} || '\"'"


@query("fn_prompt", f"""select parish_id, 'Known churches:' || chr(10) || '[' || string_agg('{{"slug":' || {_QUOTED('slug')} || ',"name":' || {_QUOTED('name')}
      || ',"address":' || {_QUOTED(d_address())} || '}}', ',' order by id) || ']' || chr(10) || 'Today: {REF} (' || dayname(date '{REF}') || ')' || chr(10) as prompt
    from church group by parish_id""")
def _(d):
    from belfry.sources.documents import church_list, churches_json, prompt
    template = "Known churches:\n{churches_json}\nToday: {today_iso} ({today_day_of_week})\n"
    return church_list(d.church).select("parish_id", prompt(template, churches_json(F.col("churches")), today()).alias("prompt"))
