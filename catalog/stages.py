"""Page links, extractor, pipeline-stage and stream checks."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions.payload import guarded_result
from belfry.functions.text import cache_version
from belfry.plans import extract_run, extractors, fetch, links, merge, process, snapshot, verify, weekly
from belfry.schemas import RESULT
from belfry.session import scratch_path
from belfry.sources.documents import add_to_store, with_content
from belfry.sources.pages import page_anchors
from belfry.streaming import ingest
from catalog.functions import ID_PATTERNS, KEYWORDS, REF, today, verify_payload
from catalog.relations import _SNAP, blobs, store
from catalog.registry import define, query

DAY = datetime.date.fromisoformat(REF)
NOW = "2002-01-01T00:00:00Z"


class LineExtractor:
    """Deterministic stand-in for a remote extractor: one event per known church.

    Documents shorter than 200 bytes fail, documents with an odd byte count are flagged
    as wrong when they are also short of 2,000 bytes.
    """

    name, version = "line", "v1"

    def extract(self, content, *, churches, today):
        if len(content) < 200:
            raise ValueError(f"document too short: {len(content)}")
        return {
            "events": [{"church_slug": c["slug"], "type": "mass", "kind": "weekly", "day_of_week": "Sunday",
                        "start_time": f"{8 + len(content) % 4}:00 AM", "page_number": i + 1} for i, c in enumerate(churches)],
            "church_list_needs_review": len(content) % 2 == 0,
            "published_date": today.isoformat() if len(content) % 3 == 0 else " ",
            "wrong_bulletin": len(content) % 2 == 1 and len(content) < 2000,
        }


extractors.register("line", LineExtractor)


# --- links on stored pages -------------------------------------------------------------------
# The corpus holds neither "bulletin" nor ".pdf", so keyword and suffix are the job's parameters.

_THE = "contains(lower(href), 'the')"
define("link_row", "select page_id, pos, href, trim(label) as label, origin || href as target from anchor_list join page_origin using (page_id)")


@query("fn_bulletin_hrefs", f"select page_id, min(pos) as pos, target as href from link_row where {_THE} group by page_id, target")
def _(d):
    return links.bulletin_hrefs(d.pages, "the")


@query("set_distinct_links", "select page_id, count(distinct target) as n_links from link_row where contains(lower(href), 'en') group by page_id")
def _(d):
    return links.bulletin_hrefs(d.pages, "en").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("win_best_nav_link", """select page_id, arg_min(target, (case when contains(lower(href), 'in') and contains(lower(label), 'in') then 0 else 1 end) * 1000 + pos) as target
    from link_row where (contains(lower(href), 'in') or contains(lower(label), 'in')) and not ends_with(lower(target), 'ing') group by page_id""")
def _(d):
    return links.navigation_link(d.pages, "in", "ing")


@query("win_first_matching_anchor", """select p.page_id, (select arg_min(target, pos) from link_row l where l.page_id = p.page_id and contains(href, 'an')) as hit from pages p""")
def _(d):
    from belfry.functions.urls import resolve_url
    return links.first_matching_anchor(d.pages, lambda base, href: F.when(href.contains("an"), resolve_url(base, href)))


# Pages with dated document links, made from the order dates: one page per 25 orders.
define("dated_link", "select idx // 25 as page_id, idx % 25 as pos, iso from link_text")


def listing_pages(d, ending: str):
    """Generated listing pages: every link text carries an ISO date, files end in ``ending``."""
    tag = F.concat(F.lit('<a href="/bulletin/'), F.col("iso"), F.lit("-"), F.col("idx").cast("string"), F.lit(ending + '">Bulletin '),
                   F.col("iso"), F.lit("</a>"))
    page = F.floor(F.col("idx") / 25)
    rows = d.link_text.groupBy(page.alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("idx", tag.alias("t")))).alias("a"))
    return rows.select("page_id", F.concat(F.lit("https://h.example.org/"), F.col("page_id").cast("string")).alias("url"),
                       F.array_join(F.transform("a", lambda r: r["t"]), "\n").alias("html"))


@query("fn_pdf_candidates", "select page_id, pos, 'https://h.example.org/bulletin/' || iso || '-' || (page_id * 25 + pos) || '.pdf' as source_url, iso as parsed_date from dated_link")
def _(d):
    return links.pdf_candidates(listing_pages(d, ".pdf"), today()).withColumn("parsed_date", F.col("parsed_date").cast("string"))


@query("win_best_candidate", f"""select page_id, arg_max('https://h.example.org/bulletin/' || iso || '-' || (page_id * 25 + pos) || '.pdf',
    case when abs(date_diff('day', cast(iso as date), date '{REF}')) <= 7 then 1000000 + date_diff('day', date '1970-01-01', cast(iso as date)) * 100 else 0 end - pos) as source_url
    from dated_link group by page_id""")
def _(d):
    return links.best_candidate(links.pdf_candidates(listing_pages(d, ".pdf"), today()), today())


@query("win_latest_post", """select page_id, arg_max('https://h.example.org/bulletin/' || iso || '-' || (page_id * 25 + pos),
    date_diff('day', date '1970-01-01', cast(iso as date)) * 100 - pos) as target from dated_link group by page_id""")
def _(d):
    return links.latest_post(listing_pages(d, ""), today())


define("home_page", "select p.slug, p.id, g.page_id from parish p left join pages g on g.page_id = p.id where trim(coalesce(p.bulletin_provider, '')) = ''")
# a link of a page leads to the page whose number is the link position plus ten times the page
define("link_page", "select page_id, pos, (page_id * 10 + pos) % (select count(*) from pages) as leads_to from link_row")
_VERDICT = """select h.slug as parish_slug, case when h.page_id is null then 'failed' else 'updated' end as status, coalesce(case when v.provider <> 'other' then v.provider end, l.provider, v.provider) as provider,
    case when v.provider <> 'other' then v.provider_id when l.provider is not null then l.provider_id else v.provider_id end as provider_id
    from home_page h left join page_verdict v on v.page_id = h.page_id left join
    (select page_id, arg_min(provider, pos) as provider, arg_min(provider_id, pos) filter (true) as provider_id from
       (select k.page_id, k.pos, w.provider, coalesce(w.provider_id, '') as provider_id from link_page k join page_verdict w on w.page_id = k.leads_to where w.provider <> 'other') group by page_id) l
    on l.page_id = h.page_id"""


def detection(d):
    """Parish homepages are the corpus pages; their links are rewritten to lead to other corpus pages."""
    n = d.pages.count()
    tag = F.concat(F.lit('<a href="/go/bulletin/'), ((F.col("page_id") * 10 + F.col("pos")) % n).cast("string"), F.lit('">x</a>'))
    anchors = page_anchors(d.pages, ["page_id"]).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", tag.alias("t")))).alias("a"))
    own = d.pages.join(anchors, "page_id", "left").select(
        "page_id", F.concat(F.regexp_replace("html", "<a [^>]*>[^<]*</a>", ""), F.lit("\n"),
                            F.array_join(F.transform("a", lambda r: r["t"]), "")).alias("html"))
    homes = own.select(F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example.org")).alias("url"), "html")
    at = F.concat(F.lit("https://p"), F.col("k.page_id").cast("string"), F.lit(".example.org/go/bulletin/"), F.col("k.to").cast("string"))
    targets = page_anchors(d.pages, ["page_id"]).select("page_id", ((F.col("page_id") * 10 + F.col("pos")) % n).alias("to")).distinct().alias("k")
    linked = targets.join(own.withColumnRenamed("page_id", "to"), "to").select(at.alias("url"), "html")
    return links.detect_providers(d.parish, homes.unionByName(linked), keyword="bulletin", keywords=KEYWORDS,
                                  id_provider="netsite", id_patterns=ID_PATTERNS)


@query("pipe_detect", "select parish_slug, status, provider, nullif(provider_id, '') as provider_id from (" + _VERDICT + ")")
def _(d):
    return detection(d)


@query("agg_detect_counters", f"select count(*) as checked, count_if(status = 'updated') as updated, count_if(status = 'failed') as failed from ({_VERDICT})")
def _(d):
    return links.detect_counters(detection(d))


@query("join_fetch_known_anti", """select source_url, min(parish_id) as parish_id from (select 'https://b.example.org/' || (id * 3 % 4000) || '.pdf' as source_url, id as parish_id from parish)
    where source_url not in (select source_url from metadata where source_url is not null) group by source_url""")
def _(d):
    found = d.parish.select(F.col("id").alias("parish_id"), F.col("slug").alias("parish_slug"),
                            F.expr("'https://b.example.org/' || (id * 3 % 4000) || '.pdf'").alias("source_url")).withColumn("fetch_url", F.col("source_url"))
    return fetch.new_links(found, d.metadata).select("source_url", "parish_id")


def parish_pages(d):
    """Link pages and the documents they lead to, for every parish of the four providers."""
    def c(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    dated = d.parish.withColumn("iso", F.expr("cast(date_add(date '2024-01-01', cast(id % 700 as int)) as string)"))
    ident, iso, home = F.col("id").cast("string"), F.col("iso"), F.col("homepage_url")
    of = lambda provider: dated.where(F.trim("bulletin_provider") == provider)
    other, direct = of("other"), of("ecatholic")
    listed, current = (of(p).where("provider_id is not null") for p in ("parishes_online", "discover_mass"))
    pdf = c("/files/", iso, "-", ident, ".pdf")
    hosted = c("https://files.ecatholic.com/", ident, "/bulletins/", iso, ".pdf")
    file = c("container.parishesonline.com/b/", iso, "-", ident, ".pdf")
    download = c("https://bulletins.discovermass.com/download.php?bulletin=", ident)
    page = lambda df, url, html: df.select(url.alias("url"), html.alias("html"))
    pages = [page(other, home, F.lit('<a href="/about">About</a><a href="/bulletins">Bulletins</a>')),
             page(other, c(home, "/bulletins"), c('<a href="', pdf, '">', iso, "</a>")),
             page(direct, c(home, "/bulletins"), c('<a href="/x.pdf">x</a><a href="', hosted, '">now</a>')),
             page(listed, c("https://parishesonline.com/organization/", F.col("provider_id")), c(
                 '<a href="/find">all</a><a href="/publication-page/', F.col("provider_id"),
                 '?selectedPublication=https%253A%252F%252F', F.replace(file, F.lit("/"), F.lit("%252F")), '">now</a>')),
             page(current, c("https://discovermass.com/church/", F.col("provider_id"), "/"), c(
                 '<a href="/church/">all</a><a id="bulletin-current" href="', download, '">now</a>'))]
    url = {"other": (other, c(home, pdf)), "ecatholic": (direct, hosted), "parishes_online": (listed, c("https://", file)), "discover_mass": (current, download)}
    files = [df.select(u.alias("url"), F.encode(c("bulletin of ", ident, " of ", iso), "UTF-8").alias("content")) for df, u in url.values()]
    return reduce(DataFrame.unionByName, pages), reduce(DataFrame.unionByName, files)


define("fetched_row", """select slug as parish_slug, sha256('bulletin of ' || id || ' of ' || iso) as content_hash, case trim(bulletin_provider)
      when 'other' then homepage_url || '/files/' || iso || '-' || id || '.pdf' when 'ecatholic' then 'https://files.ecatholic.com/' || id || '/bulletins/' || iso || '.pdf'
      when 'discover_mass' then 'https://bulletins.discovermass.com/download.php?bulletin=' || id
      else 'https://parishesonline.com/publication-page/' || provider_id || '?selectedPublication=https%253A%252F%252Fcontainer.parishesonline.com%252Fb%252F' || iso || '-' || id || '.pdf' end as source_url
    from (select *, cast(date '2024-01-01' + cast(id % 700 as int) as varchar)[:10] as iso from parish)
    where trim(bulletin_provider) in ('other', 'ecatholic') or (trim(bulletin_provider) in ('discover_mass', 'parishes_online') and provider_id is not null)""")


@query("pipe_fetch", "select parish_slug, source_url, '/' || parish_slug || '/' || content_hash || '.pdf' as pdf_path, content_hash from fetched_row")
def _(d):
    pages, files = parish_pages(d)
    nothing = d.spark.createDataFrame([], "path string, content binary")
    got = fetch.fetch_bulletins(d.parish, pages, files, d.metadata, nothing, now=NOW, reference=today())
    return got.metadata.select("parish_slug", "source_url", "pdf_path", "content_hash")


# --- extractor -------------------------------------------------------------------------------

define("ready_row", "select w.idx, w.parish_slug, w.parish_id, w.doc_id, strlen(d.text) as n from work_row w join documents d using (doc_id) where reason is null")
define("outcome_row", """select idx, case when n < 200 then 'error' else 'extracted' end as status from ready_row
    union all select idx, 'skipped' from work_row where reason is not null""")


def items(d):
    from catalog.relations import work
    return work(d)


@query("udf_extractor", """select r.idx, 'c-' || c.id as church_slug, (8 + n % 4) || ':00 AM' as start_time from ready_row r join church c on c.parish_id = r.parish_id
    where n >= 200""")
def _(d):
    ran = extractors.outcomes(with_content(items(d), store(d)), extractors.get_extractor("line"), DAY)
    rows = ran.where("status = 'extracted'").select("idx", F.explode(guarded_result(F.col("result_json"))["events"]).alias("e"))
    return rows.select("idx", "e.church_slug", "e.start_time")


@query("udf_outcomes", "select idx, status from outcome_row")
def _(d):
    return extractors.all_outcomes(items(d), store(d), extractors.get_extractor("line"), DAY).select("idx", "status")


def empty_cache(d):
    return d.spark.createDataFrame([], f"classifier string, version string, content_hash string, result {RESULT}")


def seeded_cache(d):
    """Results for the hashes of every third bulletin, as an earlier run would have left them."""
    hashes = d.bulletin.where("content_hash is not null and id % 3 = 0").select("content_hash").distinct()
    doc = F.concat(F.lit('{"events":[{"church_slug":"c-0","type":"mass","kind":"weekly","day_of_week":"Monday","start_time":"7:00 AM"}],"wrong_bulletin":'),
                   F.when(F.length("content_hash") == 3, "true").otherwise("false"),
                   F.lit(',"church_list_needs_review":'), F.when(F.length("content_hash") == 4, "true").otherwise("false"), F.lit("}"))
    return hashes.select(F.lit("line").alias("classifier"), cache_version(F.lit("v1")).alias("version"), "content_hash",
                         guarded_result(doc).alias("result"))


_CACHED = "content_hash in (select content_hash from bulletin where content_hash is not null and id % 3 = 0)"
# one row per latest document with what the stand-in extractor or the cache gives for it
define("run_status", f"""select w.idx, w.parish_slug, w.source_url, w.content_hash, w.processed_at, w.published_date,
    case when {_CACHED} then 'hit' when w.content_hash is null then 'hashless' when d.doc_id is null then 'skipped' when strlen(d.text) < 200 then 'error' else 'extracted' end as status,
    case when {_CACHED} then length(w.content_hash) = 3 else strlen(d.text) % 2 = 1 and strlen(d.text) < 2000 end as wrong,
    case when {_CACHED} then 1 else (select count(*) from church c where 'p-' || c.parish_id = w.parish_slug) end as n_rows, strlen(d.text) as n
    from work_choice w left join documents d on w.pdf_path = '/docs/' || d.doc_id || '.pdf'""")


def run(d):
    return extract_run.extract_run(d.metadata, d.parish, d.church, store(d), seeded_cache(d), extractors.get_extractor("line"), today=DAY)


@query("pipe_extract_run", """select s.source_url as bulletin_source_url, 'c-' || c.id as church_slug, (8 + n % 4) || ':00 AM' as start_time
    from run_status s join church c on 'p-' || c.parish_id = s.parish_slug where status = 'extracted' and not wrong
    union all select source_url, 'c-0', '7:00 AM' from run_status where status = 'hit' and not wrong""")
def _(d):
    return run(d).events.select("bulletin_source_url", "church_slug", "start_time")


@query("agg_run_summary", """select count(*) as bulletins_total, count_if(status in ('hit', 'extracted')) as bulletins_served, count_if(status = 'hit') as cache_hits,
    count_if(status = 'extracted') as cache_misses, count_if(status in ('skipped', 'hashless')) as skipped, count_if(status = 'error') as errors,
    coalesce(sum(case when wrong then 0 else n_rows end) filter (status in ('hit', 'extracted')), 0) as events_written from run_status""")
def _(d):
    return run(d).summary.drop("classifier", "classifier_version")


@query("agg_served_manifest", "select source_url as bulletin_source_url, parish_slug, case when wrong then 0 else n_rows end as event_count, wrong as wrong_bulletin from run_status where status in ('hit', 'extracted')")
def _(d):
    return run(d).manifest.select("bulletin_source_url", "parish_slug", "event_count", "wrong_bulletin")


# stored runs are read back without rows that name no document
@query("snk_run", """select * from (select 'event' as kind, s.source_url as bulletin_source_url, 'c-' || c.id || '|' || (8 + n % 4) || ':00 AM' as content from run_status s
      join church c on 'p-' || c.parish_id = s.parish_slug where status = 'extracted' and not wrong
    union all select 'event', source_url, 'c-0|7:00 AM' from run_status where status = 'hit' and not wrong
    union all select 'document', source_url, parish_slug || '|' || (case when wrong then 0 else n_rows end) || '|' || wrong from run_status where status in ('hit', 'extracted')
    union all select 'run', 'line', count_if(status in ('hit', 'extracted')) || '|' || count_if(status = 'hit') || '|' || count_if(status = 'error') from run_status) where bulletin_source_url is not null""")
def _(d):
    from belfry.sources.runs import read_runs
    root = scratch_path(d.spark, "run")
    extract_run.write_run(run(d), root, "line", NOW, 0.0)
    events, manifest, summary = read_runs(d.spark, root, ["line"])
    row = lambda df, kind, key, *parts: df.select(F.lit(kind).alias("kind"), F.col(key).alias("bulletin_source_url"), F.concat_ws("|", *parts).alias("content"))
    return (row(events, "event", "bulletin_source_url", "church_slug", "start_time")
            .unionByName(row(manifest, "document", "bulletin_source_url", "parish_slug", "event_count", "wrong_bulletin"))
            .unionByName(row(summary, "run", "classifier", "bulletins_served", "cache_hits", "errors")))


# --- process ---------------------------------------------------------------------------------

# pending documents of the process stage; rows without a hash are extracted as well
define("pending_row", f"""select idx, parish_slug, source_url, content_hash, case when status = 'hashless' then case when d.doc_id is null then 'skipped' when strlen(d.text) < 200 then 'error' else 'extracted' end
    else status end as status, wrong, n_rows, s.n from run_status s left join documents d on s.idx = d.doc_id where processed_at is null""")
define("merged_meta", f"""select m.idx, m.parish_slug, m.source_url, m.fetched_at, case when p.idx is not null then '{NOW}' else m.processed_at end as processed_at,
    case when p.status = 'extracted' and p.n % 3 = 0 then '{REF}' else m.published_date end as published_date
    from metadata m left join (select * from pending_row where status in ('hit', 'extracted')) p on m.idx = p.idx""")
define("merged_shown", """select * from (select *, row_number() over (partition by parish_slug order by coalesce(published_date, '') desc, coalesce(fetched_at, '') desc,
    coalesce(processed_at, '') desc, idx desc) as rn from merged_meta where processed_at <> '') where rn = 1""")
define("processed_event", """select bulletin_source_url, church_slug, start_time from (select bulletin_source_url, church_slug, start_time from compacted
      union all select p.source_url, 'c-' || c.id, (8 + n % 4) || ':00 AM' from pending_row p join church c on 'p-' || c.parish_id = p.parish_slug where status = 'extracted' and not wrong
      union all select source_url, 'c-0', '7:00 AM' from pending_row where status = 'hit' and not wrong) e
    where exists (select 1 from merged_shown s where s.source_url is not distinct from e.bulletin_source_url)""")


def processed(d, events=None):
    return process.process_bulletins(d.metadata, d.view("raw_event").drop("idx") if events is None else events, d.parish, d.church, store(d), seeded_cache(d),
                                     extractors.get_extractor("line"), now=NOW, today=DAY)


@query("pipe_process", "select bulletin_source_url, church_slug, start_time from processed_event")
def _(d):
    return processed(d).events.select("bulletin_source_url", "church_slug", "start_time")


@query("pipe_merge_result", "select idx, processed_at, published_date from merged_meta")
def _(d):
    return processed(d).metadata.select("idx", "processed_at", "published_date")


@query("agg_process_summary", """select count(*) as processed_bulletins, sum(case when wrong then 0 else n_rows end) as inserted_events, count_if(status = 'hit') as cache_hits
    from pending_row where status in ('hit', 'extracted')""")
def _(d):
    return processed(d).summary


@query("flt_needs_review", "select distinct parish_slug from pending_row where (status = 'extracted' and n % 2 = 0) or (status = 'hit' and length(content_hash) = 4)")
def _(d):
    return processed(d).review


# --- verification ----------------------------------------------------------------------------

class VerdictExtractor:
    """Stand-in that declares every church of the list verified."""

    name, version = "verdict", "v1"

    def extract(self, content, *, churches, today):
        return {"existing_churches": [{"church_slug": c["slug"], "name_status": "verified", "address_status": "verified"} for c in churches],
                "new_churches": []}


extractors.register("verdict", VerdictExtractor)


@query("pipe_verify", f"""select p.slug, '{NOW}' as verified_at, count(*) as n_verdicts from parish p join verify_choice v on v.parish_id = p.id join documents d on v.pdf_path = '/docs/' || d.doc_id || '.pdf'
    join church c on c.parish_id = p.id where p.id not in (select parish_id from done_parish) group by p.slug""")
def _(d):
    done = verify.verify_churches(d.parish, d.church, d.bulletin, store(d), extractors.get_extractor("verdict"), now=NOW, today=DAY)
    return done.select("slug", "verified_at", F.size("value.existing_churches").alias("n_verdicts"))


def verdicts(d):
    from belfry.functions.payload import verification_result
    return verify_payload(d.church).select(F.col("parish_id").alias("idx"), F.concat(F.lit("p-"), F.col("parish_id").cast("string")).alias("slug"),
                                           verification_result(F.col("payload")).alias("value"))


def applied(d):
    roster = d.church.select(
        F.col("id").alias("idx"), F.concat(F.lit("p-"), F.col("parish_id").cast("string")).alias("parish_id"), "slug", "name",
        F.coalesce("address_line1", F.lit("")).alias("line1"), F.coalesce("address_line2", F.lit("")).alias("line2"), "city", "state",
        F.coalesce("postal_code", F.lit("")).alias("postal_code"), F.lit("").alias("name_verified"), F.lit("").alias("address_verified"),
        F.lit("").alias("latitude"), F.lit("").alias("longitude"))
    return merge.apply_verify(roster, verdicts(d))


define("judged", """select c.slug, 'p-' || c.parish_id as parish_id, case when v.raw_name_status = 'incorrect' then v.new_name else c.name end as name,
    case when v.address_status = 'incorrect' then v.new_line1 else coalesce(c.address_line1, '') end as line1, case when v.address_status = 'incorrect' then '' else c.city end as city,
    case when v.slug is null then '' when v.raw_name_status in ('incorrect', 'verified') then 'true' else 'false' end as name_verified,
    case when v.slug is null then '' else 'true' end as address_verified,
    coalesce(v.raw_name_status = 'incorrect' or v.address_status = 'incorrect', false) as corrected, false as added
    from church c left join verdict_row v on v.slug = c.slug""")
define("fresh_church", """select 'n-' || (id % 50) as slug, 'p-' || arg_min(parish_id, id) as parish_id, 'Chapel ' || min(id) as name, '' as line1, '' as city, '' as name_verified,
    '' as address_verified, false as corrected, true as added from church where id % 6 = 0 group by id % 50""")


@query("join_verify_apply", "select * from judged")
def _(d):
    return applied(d).where(~F.col("added")).select("slug", "parish_id", "name", "line1", "city", "name_verified", "address_verified", "corrected", "added")


@query("join_verify_new_anti", "select slug, parish_id, name from fresh_church")
def _(d):
    return applied(d).where("added").select("slug", "parish_id", "name")


@query("pipe_verify_apply", "select * from judged union all select * from fresh_church")
def _(d):
    return applied(d).select("slug", "parish_id", "name", "line1", "city", "name_verified", "address_verified", "corrected", "added")


@query("agg_apply_counters", "select count_if(corrected) as corrections_applied, count_if(added) as new_churches_added from (select * from judged union all select * from fresh_church)")
def _(d):
    return merge.verify_counters(applied(d))


# --- weekly chain ----------------------------------------------------------------------------

@query("pipe_weekly")
def _(d):
    root = scratch_path(d.spark, "weekly")
    pages, files = parish_pages(d)
    raw_parish = d.parish.select(F.col("id").alias("idx"), "slug", "name", "homepage_url", "bulletin_provider", "provider_id")
    raw_church = d.church.withColumn("parish_slug", F.concat(F.lit("p-"), F.col("parish_id").cast("string"))).withColumn("idx", F.col("id")).drop("id", "parish_id", "created_at")
    documents = scratch_path(d.spark, "weekly-store")
    add_to_store(blobs(d), documents, 16)
    out = weekly.run_weekly(raw_parish, raw_church, d.metadata, d.view("raw_event").drop("idx"), pages, files, documents, empty_cache(d),
                            extractors.get_extractor("line"), root=root, now=NOW, today=DAY, buckets=16)
    shown = snapshot.published_versions(d.spark, f"{root}/snapshot")[0]
    event = snapshot.read_version(d.spark, f"{root}/snapshot", shown)[1]
    return event.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("n_bulletins", F.lit(out["tables"]["bulletin"]))


# --- streams ---------------------------------------------------------------------------------

def stream_of(d, df, name: str):
    """``df`` as a stream of several files."""
    path = scratch_path(d.spark, name)
    df.repartition(6, F.hash(*df.columns[:1])).write.parquet(path)
    return d.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("str_ingest_dedupe", """select source_url, 1 as n from bulletin where source_url is not null group by source_url
    union all select null, count(*) from bulletin where source_url is null""")
def _(d):
    rows = d.bulletin.select("id", "source_url").unionByName(d.bulletin.where("source_url is not null and id % 4 = 0").select((-F.col("id")).alias("id"), "source_url"))
    out, state = scratch_path(d.spark, "stream-out"), scratch_path(d.spark, "stream-state")
    ingest.write_parquet(ingest.new_urls(stream_of(d, rows, "stream-in")), out, state).awaitTermination()
    return d.spark.read.schema("id bigint, source_url string").parquet(out).groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))


@query("str_latest_upsert", "select parish_slug, idx, source_url from shown_meta")
def _(d):
    root = scratch_path(d.spark, "winners")
    stream = stream_of(d, d.metadata.select("idx", "parish_slug", "source_url", "published_date", "fetched_at", "processed_at"), "winner-in")
    q = ingest.start(stream, ingest.winner_upsert(root), scratch_path(d.spark, "winner-state"))
    q.awaitTermination()
    return ingest.current_winners(d.spark, root).select("parish_slug", "idx", "source_url")


@query("str_cache_lookup", "select content_hash, 1 as n from bulletin where content_hash is not null group by content_hash")
def _(d):
    root = scratch_path(d.spark, "hash-cache")
    extract = lambda fresh: fresh.select("content_hash", F.lit("{}").alias("result_json"))
    q = ingest.start(stream_of(d, d.bulletin.select("id", "content_hash"), "hash-in"), ingest.unseen_hashes(root, extract),
                     scratch_path(d.spark, "hash-state"))
    q.awaitTermination()
    return ingest.cached_results(d.spark, root).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query("str_snapshot_refresh", f"select {_SNAP} from snapshot_event")
def _(d):
    log, root = scratch_path(d.spark, "event-log"), scratch_path(d.spark, "view")
    ingest.snapshot_refresh(stream_of(d, d.view("event"), "event-in"), d.church, d.parish, d.bulletin, log, root,
                            scratch_path(d.spark, "event-state"), NOW).awaitTermination()
    return ingest.published(d.spark, root)[1].drop("arrival")
