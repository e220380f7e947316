"""Data rows of the generated site: page texts, structured data, index, sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belfry.functions.dates import lastmod_date
from belfry.functions.text import blank_to_null, empty_to_null, is_blank, xml_escape
from belfry.functions.urls import canonical_url
from belfry.plans import serve

# Labels and wording of the generated pages.
UNKNOWN_CITY = "Other locations"
SERVICES = "Mass, Confession & Adoration Times"
INDEX_PATH = "/churches/"
IMAGE_PATH = "/og-default.png"


def last_modified(church: DataFrame, bulletin: DataFrame | None) -> DataFrame:
    """(id, slug, last_modified): newest of the parish's bulletin stamps, else the church's own.

    Snapshots without bulletins fall back to ``created_at``, and without that to null.
    """
    created = empty_to_null(F.col("created_at")) if "created_at" in church.columns else F.lit(None).cast("string")
    if bulletin is None:
        return church.select("id", "slug", created.alias("last_modified"))
    stamp = F.coalesce(*[empty_to_null(F.col(c)) for c in ("processed_at", "fetched_at", "published_date")])
    # a stampless bulletin row counts as the church's own stamp
    newest = bulletin.groupBy("parish_id").agg(
        F.max(stamp).alias("newest"), F.max(stamp.isNull()).alias("bare"))
    own = F.when(F.coalesce("bare", F.lit(True)), created)
    return (church.join(newest, "parish_id", "left")
            .select("id", "slug", F.greatest("newest", own).alias("last_modified")))


def city_label() -> Column:
    city, state = blank_to_null(F.col("city")), blank_to_null(F.col("state"))
    return F.when(city.isNotNull(), F.concat_ws(", ", city, state)).otherwise(UNKNOWN_CITY)


def by_city(church: DataFrame) -> DataFrame:
    """Index rows (label, name, slug) in page order: cities by label, unknown last, then name."""
    rows = church.select(city_label().alias("label"), "name", "slug", "id")
    return rows.orderBy(F.col("label") == UNKNOWN_CITY, "label", F.coalesce("name", F.lit("")), "id")


def location() -> Column:
    parts = [F.when(~is_blank(F.col(c)), F.col(c)) for c in ("city", "state")]
    return F.concat_ws(", ", *parts)


def page_title() -> Column:
    name = F.coalesce(blank_to_null(F.col("name")), F.lit("Catholic Parish"))
    place = F.when(location() != "", F.concat(F.lit(" in "), location())).otherwise("")
    return F.concat(name, F.lit(f" — {SERVICES}"), place)


def page_description() -> Column:
    name = F.coalesce(blank_to_null(F.col("name")), F.lit("this parish"))
    place = F.when(location() != "", F.concat(F.lit(" in "), location())).otherwise("")
    return F.concat(F.lit("Mass, Confession, and Adoration times for "), name, place,
                    F.lit(", parsed from the parish's latest weekly bulletin."))


def index_description(count: Column, site_name: str) -> Column:
    return F.concat(F.lit("Browse all "), count.cast("string"), F.lit(
        f" Catholic parishes on {site_name} and find Mass, Confession, and Adoration times "
        "parsed from each parish's weekly bulletin."))


def _safe_json(node: Column) -> Column:
    return F.replace(F.to_json(node), F.lit("<"), F.lit("\\u003c"))


def structured_data(origin: str, site_name: str, url: Column, modified: Column) -> dict[str, Column]:
    """Three JSON columns per church: the place, its page, and the breadcrumb trail."""
    site = origin.rstrip("/")
    filled = lambda c: F.when(~is_blank(F.col(c)), F.col(c))
    street = empty_to_null(F.concat_ws(", ", filled("address_line1"), filled("address_line2")))
    city, state, code = (empty_to_null(F.col(c)) for c in ("city", "state", "postal_code"))
    known = F.coalesce(street, city, state, code).isNotNull()
    address = F.when(known, F.struct(
        F.lit("PostalAddress").alias("@type"), street.alias("streetAddress"), city.alias("addressLocality"),
        state.alias("addressRegion"), code.alias("postalCode"), F.lit("US").alias("addressCountry")))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    geo = F.when(located, F.struct(F.lit("GeoCoordinates").alias("@type"), "latitude", "longitude"))
    same_as = F.when(~is_blank(F.col("homepage_url")), F.array("homepage_url"))
    context = F.lit("https://schema.org").alias("@context")
    place_id = F.concat(url, F.lit("#church"))
    place = F.struct(
        context, F.lit("Church").alias("@type"), place_id.alias("@id"),
        F.coalesce("name", F.lit("Catholic parish")).alias("name"), url.alias("url"),
        F.lit(site + IMAGE_PATH).alias("image"), address.alias("address"), geo.alias("geo"), same_as.alias("sameAs"))
    page = F.struct(
        context, F.lit("WebPage").alias("@type"), F.concat(url, F.lit("#webpage")).alias("@id"), url.alias("url"),
        page_title().alias("name"), page_description().alias("description"),
        F.struct(place_id.alias("@id")).alias("about"), F.lit("en-US").alias("inLanguage"),
        modified.alias("dateModified"))
    crumb = lambda i, name, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"),
                                           name.alias("name"), item.alias("item"))
    trail = F.struct(
        context, F.lit("BreadcrumbList").alias("@type"), F.array(
            crumb(1, F.lit(site_name), F.lit(site + "/")), crumb(2, F.lit("Parishes"), F.lit(site + INDEX_PATH)),
            crumb(3, F.coalesce("name", F.lit("Parish")), url)).alias("itemListElement"))
    return {"place_json": _safe_json(place), "page_json": _safe_json(page), "trail_json": _safe_json(trail)}


def site_lastmod(modified: DataFrame, build_date: str) -> DataFrame:
    """One row: the newest normalised date, the build date where there is none."""
    day = F.coalesce(lastmod_date(F.col("last_modified")), F.lit(build_date))
    return modified.agg(F.coalesce(F.max(day), F.lit(build_date)).alias("lastmod"))


def sitemap_rows(modified: DataFrame, origin: str, build_date: str, about_page: bool = False) -> DataFrame:
    """(section, loc, lastmod): home, landing, index, one row per church, optionally the about page."""
    site = origin.rstrip("/")
    day = F.coalesce(lastmod_date(F.col("last_modified")), F.lit(build_date))
    churches = modified.select(F.lit(3).alias("section"), canonical_url(origin, F.col("slug")).alias("loc"),
                               day.alias("lastmod"))
    fixed = [(0, "/", None), (1, "/landing", build_date), (2, INDEX_PATH, None)]
    if about_page:
        fixed.append((4, "/about", build_date))
    pages = F.explode(F.array(*[F.struct(
        F.lit(s).alias("section"), F.lit(site + p).alias("loc"),
        (F.lit(d) if d else F.col("lastmod")).alias("lastmod")) for s, p, d in fixed]))
    return site_lastmod(modified, build_date).select(pages.alias("p")).select("p.*").unionByName(churches)


def sitemap_line() -> Column:
    return F.concat(F.lit("  <url>\n    <loc>"), xml_escape(F.col("loc")), F.lit("</loc>\n    <lastmod>"),
                    F.col("lastmod"), F.lit("</lastmod>\n  </url>"))


def robots_text(origin: str) -> str:
    return f"User-agent: *\nAllow: /\n\nSitemap: {origin.rstrip('/')}/sitemap.xml\n"


def site_rows(church: DataFrame, event: DataFrame, modified: DataFrame, today: Column, *, origin: str,
              site_name: str, build_date: str) -> tuple[DataFrame, DataFrame]:
    """(page rows, event rows): one row per church page, and its upcoming events keyed by slug."""
    url = canonical_url(origin, F.col("slug"))
    days = modified.select("id", F.coalesce(lastmod_date(F.col("last_modified")), F.lit(build_date)).alias("lastmod"))
    pages = church.join(days, "id", "left").withColumn("lastmod", F.coalesce("lastmod", F.lit(build_date)))
    pages = pages.withColumn("url", url).withColumn("title", page_title()).withColumn("description", page_description())
    pages = pages.withColumns(structured_data(origin, site_name, F.col("url"), F.col("lastmod")))
    rows = serve.upcoming(event, today).join(church.select(F.col("id").alias("church_id"), "slug"), "church_id")
    return pages, rows.select("slug", "rank_key", *serve.event_summary())
