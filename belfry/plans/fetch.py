"""Fetch stage over stored pages and documents: current link per parish -> new metadata rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions import urls
from belfry.operators import filters
from belfry.plans import links
from belfry.session import written
from belfry.sources.documents import store_documents


def fetchable(parish: DataFrame) -> DataFrame:
    """(parish_id, parish_slug, provider, fetch_id, page_url) of parishes with a usable source."""
    found = parish.withColumn("s", filters.fetch_source()).where(F.col("s").isNotNull())
    ident = F.col("s.fetch_id")
    page = (F.when(F.col("s.provider") == "ecatholic", F.concat(F.regexp_replace(ident, "/+$", ""), F.lit("/bulletins")))
            .otherwise(ident))
    for provider, template in urls.PAGE_TEMPLATES.items():
        before, after = template.split("{id}")
        clean = F.regexp_replace(ident, "^/+|/+$", "") if provider == "discover_mass" else ident
        page = F.when(F.col("s.provider") == provider, F.concat(F.lit(before), clean, F.lit(after))).otherwise(page)
    return found.select(F.col("id").alias("parish_id"), F.col("slug").alias("parish_slug"), "s.provider",
                        ident.alias("fetch_id"), page.alias("page_url"))


def current_links(sources: DataFrame, pages: DataFrame, reference, keyword: str = links.KEYWORD,
                  suffix: str = links.SUFFIX) -> DataFrame:
    """(parish_id, parish_slug, source_url, fetch_url): the current document link where one is found."""
    at = sources.join(pages.select(F.col("url").alias("page_url"), "html"), "page_url").withColumn(
        "url", F.col("page_url"))

    def direct(provider: str, accept) -> DataFrame:
        some = at.where(F.col("provider") == provider)
        hit = links.first_matching_anchor(some, accept, "parish_id").where(F.col("hit").isNotNull())
        return hit.select("parish_id", "hit.source_url", "hit.fetch_url")

    def same(url):
        return F.when(url.isNotNull(), F.struct(url.alias("source_url"), url.alias("fetch_url")))

    found = direct("ecatholic", lambda base, href: same(urls.ecatholic_url(base, href)))
    found = found.unionByName(direct("discover_mass", lambda base, href: same(urls.discover_url(base, href))))
    found = found.unionByName(direct("parishes_online", lambda base, href: urls.parishes_online_url(
        base, href, F.element_at(F.split(base, "/"), -1))))

    def visit(targets: DataFrame) -> DataFrame:
        return targets.join(pages.select(F.col("url").alias("target"), "html"), "target").select(
            "parish_id", F.col("target").alias("url"), "html")

    # link lists are small next to the pages they come from: written once, page text is not
    nav = links.navigation_link(at.where(F.col("provider") == "other"), keyword, suffix, "parish_id")
    listing = visit(written(nav, "nav-links"))
    on_list = written(links.pdf_candidates(listing, reference, suffix, keep="parish_id"), "candidates")
    bare = listing.join(on_list.select("parish_id"), "parish_id", "left_anti")
    post = visit(links.latest_post(bare, reference, keyword, suffix, "parish_id"))
    candidates = on_list.unionByName(links.pdf_candidates(post, reference, suffix, keep="parish_id"))
    best = links.best_candidate(candidates, reference, "parish_id")
    found = found.unionByName(best.select("parish_id", "source_url", F.col("source_url").alias("fetch_url")))
    return sources.select("parish_id", "parish_slug").join(found, "parish_id")


def new_links(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """Links whose source URL is not recorded yet; of repeats the first parish by id keeps it."""
    first = found.groupBy("source_url").agg(
        F.min_by(F.struct("parish_id", "parish_slug", "fetch_url"), "parish_id").alias("f")).select("source_url", "f.*")
    known = metadata.where(F.col("source_url").isNotNull()).select("source_url")
    return first.join(known, "source_url", "left_anti")


@dataclass
class Fetched:
    metadata: DataFrame
    blobs: DataFrame
    summary: DataFrame


def fetch_bulletins(parish: DataFrame, pages: DataFrame, documents: DataFrame, metadata: DataFrame,
                    stored: DataFrame, *, now: str, reference, parish_name: str | None = None,
                    keyword: str = links.KEYWORD, suffix: str = links.SUFFIX) -> Fetched:
    """New metadata rows and blobs.  ``documents`` is (url, content) of what the links lead to."""
    if parish_name is not None:
        parish = filters.require_rows(parish.where(F.col("name") == parish_name), f"Parish not found: {parish_name}")
    found = written(current_links(fetchable(parish), pages, reference, keyword, suffix), "current-links")
    fresh = written(new_links(found, metadata), "new-links")
    got = fresh.join(documents.withColumnRenamed("url", "fetch_url"), "fetch_url").withColumn("fetched_at", F.lit(now))
    blobs, rows = store_documents(got, stored)
    offset = metadata.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0] + 1
    rows = rows.join(got.select("source_url", (F.col("parish_id") + offset).alias("idx")), "source_url")
    here = fresh.join(documents.select(F.col("url").alias("fetch_url")), "fetch_url", "left_semi")
    counts = (found.select(F.lit("found").alias("k")).unionByName(here.select(F.lit("fetched").alias("k")))
              .unionByName(fresh.select(F.lit("fresh").alias("k"))))
    n = lambda k: F.count_if(F.col("k") == k)
    summary = counts.agg(n("fetched").alias("fetched_bulletins"), (n("found") - n("fresh")).alias("skipped_existing_urls"))
    return Fetched(rows.select(*metadata.columns), blobs, summary)
