"""Driver tables -> domain tables, one SQL text per table for both engines.

Only engine spelling differs (type names, generators, hashing to an integer); the
``Dialect`` objects hold those spellings.  See FIXTURES.md for the column contract.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    string: str
    spark: bool

    def txt(self, x: str) -> str:
        return f"cast({x} as {self.string})"

    def iso(self, x: str) -> str:
        return f"cast(cast({x} as date) as {self.string})"

    def hash_id(self, x: str) -> str:
        digits = f"substr(md5({x}), 1, 15)"
        if self.spark:
            return f"cast(conv({digits}, 16, 10) as bigint)"
        return f"cast('0x' || {digits} as bigint)"

    def numbers(self, lo: int, hi: int, alias: str) -> str:
        if self.spark:
            return f"explode(sequence({lo}, {hi})) as {alias}"
        return f"unnest(range({lo}, {hi} + 1)) as {alias}"

    def pad2(self, x: str) -> str:
        return f"lpad({self.txt(x)}, 2, '0')"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"


SPARK = Dialect("string", True)
DUCK = Dialect("varchar", False)


def parish(d: Dialect) -> str:
    key = d.txt("c_custkey")
    return f"""
select c_custkey as id, 'p-' || {key} as slug, c_name as name,
       'https://p' || {key} || '.example.org' as homepage_url,
       case c_custkey % 6 when 0 then 'ecatholic' when 1 then 'parishes_online'
            when 2 then 'discover_mass' when 3 then 'other' when 4 then ' ' end as bulletin_provider,
       case when c_custkey % 7 <> 0 then 'id-' || {key} end as provider_id
from customer"""


def church(d: Dialect) -> str:
    n = d.txt("n")
    return f"""
select n as id, c_custkey as parish_id, 'c-' || {n} as slug, 'Church ' || {d.txt("n % 97")} as name,
       case when n % 17 = 0 then '' else {d.txt("n % 400")} || ' Main St' end as address_line1,
       case when k = 2 then 'Suite 1' end as address_line2,
       n_name as city, 'S' || {d.txt("n_regionkey")} as state,
       case when n % 19 <> 0 then {d.txt("10000 + c_custkey % 90")} end as postal_code,
       case when n % 11 <> 0 then cast(c_custkey % 180 - 90 as double) + k * cast(0.25 as double) end as latitude,
       case when n % 13 <> 0 then cast(c_custkey % 360 - 180 as double) + k * cast(0.25 as double) end as longitude,
       case when c_custkey % 4 = 0 or k < 2 then 1 else 0 end as name_verified,
       case when c_custkey % 3 = 0 then 0 else 1 end as address_verified,
       case when n % 9 <> 0 then '1996-01-0' || {d.txt("n % 9")} || 'T00:00:00Z' end as created_at
from (select c_custkey, c_nationkey, k, c_custkey * 3 + k as n
      from (select c_custkey, c_nationkey, {d.numbers(0, 2, "k")} from customer) g) c
join nation on c_nationkey = n_nationkey"""


def bulletin(d: Dialect) -> str:
    key, day = d.txt("o_orderkey"), d.iso("o_orderdate")
    return f"""
select o_orderkey as id, o_custkey as parish_id,
       case when o_orderkey % 50 <> 0 then 'https://b.example.org/' || {key} || '.pdf' end as source_url,
       case when o_orderkey % 23 <> 0 then '/docs/' || {key} || '.pdf' end as pdf_path,
       case when o_orderkey % 10 <> 0 then {day} end as published_date,
       {day} || 'T0' || {d.txt("o_orderkey % 10")} || ':00:00Z' as fetched_at,
       case when o_orderstatus <> 'P' then {day} || 'T12:00:00Z' end as processed_at,
       case when o_orderkey % 41 <> 0 then 'h' || {d.txt("o_orderkey % 997")} end as content_hash
from orders"""


def event(d: Dialect) -> str:
    ident = " || '|' || ".join([
        d.txt("l_orderkey"), d.txt("l_linenumber"), d.txt("l_partkey"), d.txt("l_suppkey"),
        d.iso("l_shipdate"), d.txt("cast(round(l_extendedprice * 100) as bigint)"),
        d.txt("cast(l_quantity as bigint)"),
    ])
    return f"""
select {d.hash_id(ident)} as id, o_custkey * 3 + l_suppkey % 3 as church_id,
       case when l_partkey % 29 <> 0 then l_orderkey end as bulletin_id,
       case l_linenumber % 3 when 0 then 'mass' when 1 then 'confession' else 'adoration' end as event_type,
       case when l_returnflag = 'N' then 'specific_date' else 'weekly' end as event_kind,
       case when l_returnflag <> 'N' and l_partkey % 31 <> 0 then
            case l_suppkey % 7 when 0 then 'Sunday' when 1 then 'Monday' when 2 then 'TUESDAY'
                 when 3 then 'Wednesday' when 4 then 'Thursday' when 5 then 'Friday' else 'Saturday' end
       end as day_of_week,
       case when l_returnflag = 'N' then {d.iso("l_shipdate")} end as date,
       cast(l_partkey * 37 % 1440 as int) as start_time,
       case when l_linenumber = 7 then cast((l_partkey * 37 + 60) % 1440 as int) end as end_time,
       case when l_partkey % 20 = 0 then 1 else 0 end as cancelled,
       l_linenumber as page_number,
       case when l_suppkey % 5 = 0 then ' note ' end as note
from lineitem join orders on l_orderkey = o_orderkey"""


def raw_event(d: Dialect) -> str:
    """Events as an extractor would print them: rotating time and date styles, some junk."""
    h24, mins = d.div("start_time", 60), "start_time % 60"
    h12 = f"case when {h24} % 12 = 0 then 12 else {h24} % 12 end"
    mm = d.pad2(mins)
    up = f"case when start_time < 720 then 'AM' else 'PM' end"
    low = f"case when start_time < 720 then 'am' else 'pm' end"
    dots = f"case when start_time < 720 then 'a.m.' else 'p.m.' end"
    month = f"cast(substr(date, 6, 2) as int)"
    dom = f"cast(substr(date, 9, 2) as int)"
    names = ["January", "February", "March", "April", "May", "June", "July", "August",
             "September", "October", "November", "December"]
    month_name = f"case {month} " + " ".join(
        f"when {i} then '{n}'" for i, n in enumerate(names, 1)) + " end"
    return f"""
select id as idx, 'c-' || {d.txt("church_id")} as church_slug,
       case when bulletin_id % 50 <> 0 then 'https://b.example.org/' || {d.txt("bulletin_id")} || '.pdf'
       end as bulletin_source_url,
       event_type, event_kind, day_of_week,
       case id % 4 when 0 then date
            when 1 then {month_name} || ' ' || {d.txt(dom)} || ', ' || substr(date, 1, 4)
            when 2 then {d.txt(month)} || '/' || {d.txt(dom)} || '/' || substr(date, 1, 4)
            else case when date is not null then 'first Friday' end end as date,
       case id % 6 when 0 then {d.txt(h12)} || ':' || {mm} || ' ' || {up}
            when 1 then {d.txt(h12)} || ':' || {mm} || {low}
            when 2 then ' ' || {d.txt(h12)} || ':' || {mm} || ' ' || {dots}
            when 3 then {d.pad2(h24)} || ':' || {mm}
            when 4 then {d.pad2(h24)} || {mm}
            else case id % 5 when 0 then 'noon' when 1 then 'Midnight' when 2 then '13:00 PM'
                 when 3 then {d.txt(h12)} || ' ' || {up} else 'after school' end end as start_time,
       case when end_time is not null then
            {d.pad2(d.div("end_time", 60))} || ':' || {d.pad2("end_time % 60")} end as end_time,
       cancelled = 1 as cancelled, page_number, note
from event"""


def metadata(d: Dialect) -> str:
    """Bulletin rows keyed by parish slug, as the ingest metadata file holds them."""
    return f"""
select id as idx, 'p-' || {d.txt("parish_id")} as parish_slug, source_url, pdf_path,
       content_hash, fetched_at, processed_at, published_date
from bulletin"""


def run_event(d: Dialect) -> str:
    """Two extractor runs over the same bulletins: 'alpha' as is, 'beta' with drops, shifts, repeats."""
    def clock(expr: str) -> str:
        return f"{d.pad2(d.div(expr, 60))} || ':' || {d.pad2(f'{expr} % 60')}"
    shifted = "(start_time + case when id % 7 = 0 then 5 else 0 end) % 1440"
    cols = f"""'c-' || {d.txt("church_id")} as church_slug, {d.txt("bulletin_id")} as bid,
       event_type, event_kind, day_of_week, date"""
    tail = "cancelled = 1 as cancelled, page_number, note"
    url = "'https://b.example.org/' || bid || '.pdf'"
    return f"""
select classifier, idx, {url} as bulletin_source_url, church_slug, event_type, event_kind,
       day_of_week, date, start_time, end_time, cancelled, page_number, note
from (
  select 'alpha' as classifier, id as idx, {cols}, {clock("start_time")} as start_time,
         case when end_time is not null then {clock("end_time")} end as end_time, {tail}
  from event where bulletin_id % 3 <> 2
  union all
  select 'beta', id, {cols}, {clock(f"({shifted})")},
         case when end_time is not null then {clock("end_time")} end, {tail}
  from event where bulletin_id % 5 <> 4 and id % 11 <> 0
  union all
  select 'beta', id + 1, {cols}, {clock(f"({shifted})")},
         case when end_time is not null then {clock("end_time")} end, {tail}
  from event where bulletin_id % 5 <> 4 and id % 11 <> 0 and id % 13 = 0
) r where bid is not null"""


def run_manifest(d: Dialect) -> str:
    url = f"'https://b.example.org/' || {d.txt('id')} || '.pdf'"
    return f"""
select 'alpha' as classifier, {url} as bulletin_source_url from bulletin where id % 3 <> 2
union all
select 'beta', {url} from bulletin where id % 5 <> 4"""


def snapshot_event(d: Dialect) -> str:
    """Published event rows (the newest bulletin of each parish only)."""
    return """
select e.id, e.church_id, e.event_type, e.event_kind, e.day_of_week, e.date, e.start_time,
       e.end_time, e.cancelled, e.page_number, e.note
from event e join (
  select id from (
    select id, row_number() over (partition by parish_id order by coalesce(published_date, '') desc,
             coalesce(fetched_at, '') desc, coalesce(processed_at, '') desc, id desc) as rn
    from bulletin) r where rn = 1) b on e.bulletin_id = b.id"""


def saved_filter(d: Dialect) -> str:
    """Saved filter URLs of the customers: everybody saved one of sixty popular filters."""
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    def day(expr: str) -> str:
        return f"case {expr} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(days)) + " end"
    return f"""
select c_custkey as filter_id,
       'https://maps.example.org/map?z=' || {d.txt("c_custkey % 18")} ||
       case k % 4 when 0 then '&type=mass' when 1 then '&type=confession'
            when 2 then '&type=adoration' else '&type=picnic' end ||
       case k % 5 when 0 then '' when 1 then '&days=' || {day("k % 7")}
            when 2 then '&days=Fri, ' || {day("k % 7")} || ',' || {day("k % 7")} || ',xyz'
            when 3 then '&days=sun,sat,fri,mon,tue' else '&days=' end ||
       case k % 6 when 0 then '' when 1 then '&from=' || {d.pad2("k % 24")} || '30'
            when 2 then '&from=0000&to=' || {d.pad2("k % 26")} || '15'
            when 3 then '&from=0800&to=2400' when 4 then '&from=2000&to=0700' else '&from=8am&to=1290' end
       as url
from (select c_custkey, c_custkey % 60 as k from customer) c"""


def link_text(d: Dialect) -> str:
    """Link labels with a date in rotating spellings, made from the order dates."""
    names = ["January", "February", "March", "April", "May", "June", "July", "August",
             "September", "October", "November", "December"]
    long = "case m " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names, 1)) + " end"
    dd, mm = d.txt("d"), d.txt("m")
    return f"""
select idx, y, m, d, iso, 'https://b.example.org/list/' as base,
       case idx % 8 when 0 then 'Bulletin ' || {long} || ' ' || {dd} || ', ' || {d.txt("y")}
            when 1 then {dd} || ' ' || substr({long}, 1, 3) || ' ' || substr(iso, 3, 2)
            when 2 then 'bulletin-' || iso || '.pdf' when 3 then {mm} || '-' || {dd} || '-' || substr(iso, 3, 2)
            when 4 then 'for ' || {mm} || '/' || {dd} when 5 then 'Sunday, ' || {long} || ' ' || {dd} || 'th'
            when 6 then 'no date here' else 'Feb 31 1998 then ' || {long} || ' ' || {dd} || ' ' || {d.txt("y")}
       end as text
from (select o_orderkey as idx, {d.iso("o_orderdate")} as iso, cast(substr({d.iso("o_orderdate")}, 1, 4) as int) as y,
             cast(substr({d.iso("o_orderdate")}, 6, 2) as int) as m, cast(substr({d.iso("o_orderdate")}, 9, 2) as int) as d
      from orders) o"""


def payload(d: Dialect) -> str:
    """One extraction payload per bulletin with events: nested JSON text, some of it damaged.

    ``id % 10``: 0 has an extra key in the root, 1 has one slot with a numeric slug, 2 is not
    JSON at all, 3 is flagged as the wrong bulletin; the others are well formed.
    """
    agg = "coalesce(string_agg({0}, ',' order by {0}), '')"
    q = lambda name, expr: f"'\"{name}\":\"' || {expr} || '\"'"
    clock = f"{d.pad2(d.div('start_time', 60))} || ':' || {d.pad2('start_time % 60')}"
    slug = f"'c-' || {d.txt('church_id')}"
    page = f"',\"page_number\":' || {d.txt('page_number')}"
    weekly = "'{' || " + " || ',' || ".join([q("church_slug", slug), q("day_of_week", "day_of_week"),
                                            q("start_time", clock)]) + f" || {page} || '}}'"
    dated = "'{' || " + " || ',' || ".join([q("church_slug", slug), q("date", "date"),
                                           q("start_time", clock)]) + f" || {page} || '}}'"
    slots, tests = {}, {}
    for kind, section, cancelled in (("weekly", "weekly_schedule", None), ("specific_date", "single_events", 0),
                                     ("specific_date", "cancellations", 1)):
        for event_type, bucket in (("mass", "masses"), ("confession", "confessions"), ("adoration", "adorations")):
            test = f"event_kind = '{kind}' and event_type = '{event_type}'"
            test += " and day_of_week is not null" if kind == "weekly" else f" and cancelled = {cancelled}"
            body = weekly if kind == "weekly" else dated
            tests[section, bucket] = test
            slots[section, bucket] = agg.format(f"case when {test} then {body} end")
    def section(name: str) -> str:
        parts = [f"'\"{b}\":[' || {slots[name, b]} || ']'" for b in ("masses", "confessions", "adorations")]
        if name == "weekly_schedule":
            odd = "case when bulletin_id % 10 = 1 then '{\"church_slug\":5,\"day_of_week\":\"Monday\",\"start_time\":\"8:00\"},' else '' end"
            empty = slots[name, "masses"]
            parts[0] = (f"'\"masses\":[' || case when {empty} = '' then replace({odd}, '}},', '}}') "
                        f"else {odd} || {empty} end || ']'")
        return f"'\"{name}\":{{' || " + " || ',' || ".join(parts) + " || '}'"
    grouped = "(select e.*, coalesce(b.published_date, 'soon') as b_date from event e join bulletin b on e.bulletin_id = b.id) j\ngroup by bulletin_id"
    if d.spark:  # one list per document: each event stands in one slot, so the slots are parts of its sorted list
        places = {slot: i for i, slot in enumerate(slots)}
        slot_of = "case " + " ".join(f"when {tests[slot]} then {i}" for slot, i in places.items()) + " end"
        grouped = (f"(select bulletin_id, max(b_date) as b_date, array_sort(collect_list(case when j is not null and place is not null then struct(place, j) end)) as events\n"
                   f"from (select *, case when event_kind = 'weekly' then {weekly} else {dated} end as j, {slot_of} as place from\n"
                   f"(select e.*, coalesce(b.published_date, 'soon') as b_date from event e join bulletin b on e.bulletin_id = b.id) j) j group by bulletin_id) j")
        slots = {slot: f"array_join(transform(filter(events, s -> s.place = {i}), s -> s.j), ',')" for slot, i in places.items()}
    body = " || ',' || ".join(section(n) for n in ("weekly_schedule", "single_events", "cancellations"))
    b_date = "b_date" if d.spark else "max(b_date)"
    return f"""
select bulletin_id as id,
       case when bulletin_id % 10 = 2 then 'no schedule found' else '{{' || {body} ||
            ',"published_date":"' || {b_date} || '","wrong_bulletin":' ||
            case when bulletin_id % 10 = 3 then 'true' else 'false' end ||
            ',"church_list_needs_review":' || case when bulletin_id % 4 = 0 then '"yes"' else 'false' end ||
            case when bulletin_id % 10 = 0 then ',"comment":"extra"' else '' end || '}}' end as payload
from {grouped}"""


def geo_result(d: Dialect) -> str:
    """Geocoder output for some addresses; repeats and out-of-range rows included."""
    return """
select id as idx, address_line1 as line1, address_line2 as line2, city, state, postal_code,
       cast(id % 100 - 5 as double) as latitude, cast(id % 200 - 10 as double) as longitude
from church where address_line1 <> '' and id % 5 = 1"""


def page_link(d: Dialect) -> str:
    """Pages of the corpus with the parish they belong to (page_id spread over the parishes)."""
    return """
select p.page_id, p.url, p.html, c.parish_id
from pages p join (select c_custkey as parish_id from customer) c on p.page_id = c.parish_id"""


# name -> (builder, tables it reads)
TABLES = {
    "parish": (parish, ["customer"]),
    "church": (church, ["customer", "nation"]),
    "bulletin": (bulletin, ["orders"]),
    "event": (event, ["lineitem", "orders"]),
    "raw_event": (raw_event, ["event"]),
    "metadata": (metadata, ["bulletin"]),
    "run_event": (run_event, ["event"]),
    "run_manifest": (run_manifest, ["bulletin"]),
    "snapshot_event": (snapshot_event, ["event", "bulletin"]),
    "saved_filter": (saved_filter, ["customer"]),
    "link_text": (link_text, ["orders"]),
    "payload": (payload, ["event", "bulletin"]),
    "geo_result": (geo_result, ["church"]),
    "page_link": (page_link, ["pages", "customer"]),
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def needed(names: set[str]) -> list[str]:
    """Derived tables ``names`` plus everything they read, in build order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in out:
            for dep in TABLES[name][1]:
                visit(dep)
            out.append(name)

    for name in TABLES:
        if name in names:
            visit(name)
    return out


def with_prefix(sql: str, names: set[str], extra: str = "") -> str:
    """Prepend the DuckDB CTEs for ``names`` (and ``extra`` CTE text) to ``sql``."""
    ctes = [f"{n} as materialized ({TABLES[n][0](DUCK).strip()})" for n in needed(names)]
    if extra:
        ctes.append(extra)
    return (f"with recursive {', '.join(ctes)}\n{sql}" if ctes else sql).strip()
