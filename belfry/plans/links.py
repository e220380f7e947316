"""Which document link of a parish's pages is the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions import dates, urls
from belfry.operators import filters
from belfry.sources.pages import page_anchors

# The words and endings that mark bulletin links and document files.
KEYWORD = "bulletin"
SUFFIX = ".pdf"


def bulletin_hrefs(pages: DataFrame, keyword: str = KEYWORD, keep: str = "page_id") -> DataFrame:
    """(page_id, pos, href): absolute http links whose href names a bulletin, first occurrence of each."""
    found = page_anchors(pages, [keep, "url"]).where(F.lower("href").contains(keyword.lower()))
    href = F.when(F.col("href").startswith("/"), urls.resolve_url(F.col("url"), F.col("href"))).otherwise(F.col("href"))
    return (found.select(keep, "pos", href.alias("href")).where(F.col("href").startswith("http"))
            .groupBy(keep, "href").agg(F.min("pos").alias("pos")).select(keep, "pos", "href"))


def first_matching_anchor(pages: DataFrame, accept, keep: str = "page_id") -> DataFrame:
    """Per page the first anchor whose ``accept(base, href)`` gives a URL; null when none does."""
    links = page_anchors(pages, [keep, "url"]).withColumn("hit", accept(F.col("url"), F.col("href")))
    first = F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("pos")))
    return pages.select(keep).join(links.groupBy(keep).agg(first.alias("hit")), keep, "left")


def navigation_link(pages: DataFrame, keyword: str = KEYWORD, suffix: str = SUFFIX, keep: str = "page_id") -> DataFrame:
    """Per page the link to the bulletin page: keyword in href and text first, then in either."""
    a = page_anchors(pages, [keep, "url"])
    in_href, in_text = (F.lower(c).contains(keyword.lower()) for c in ("href", "text"))
    target = urls.resolve_url(F.col("url"), F.col("href"))
    usable = a.where(in_href | in_text).withColumn("target", target).where(~F.lower("target").endswith(suffix))
    order = F.struct(F.when(in_href & in_text, 0).otherwise(1).alias("weak"), F.col("pos"))
    return usable.groupBy(keep).agg(F.min_by("target", order).alias("target"))


def latest_post(pages: DataFrame, reference, keyword: str = KEYWORD, suffix: str = SUFFIX,
                keep: str = "page_id") -> DataFrame:
    """Per page the latest dated non-document bulletin link that is not the page itself."""
    a = page_anchors(pages, [keep, "url"]).withColumn("target", urls.resolve_url(F.col("url"), F.col("href")))
    bare = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    named = F.lower("href").contains(keyword.lower()) | F.lower("text").contains(keyword.lower())
    dated = (a.where(named & ~F.lower("target").endswith(suffix) & (bare(F.col("target")) != bare(F.col("url"))))
             .withColumn("day", dates.relaxed_date_multi([F.col("text"), F.col("href"), F.col("target")], reference))
             .where(F.col("day").isNotNull()))
    return dated.groupBy(keep).agg(
        F.max_by("target", F.struct(F.col("day"), (-F.col("pos")).alias("early"))).alias("target"))


def pdf_candidates(pages: DataFrame, reference, suffix: str = SUFFIX, pattern: str = urls.HTML_PDF_PATTERN,
                   keep: str = "page_id") -> DataFrame:
    """(page_id, pos, source_url, parsed_date): document anchors, or URLs in the source when there are none."""
    a = page_anchors(pages, [keep, "url"]).withColumn("source_url", urls.resolve_url(F.col("url"), F.col("href")))
    linked = a.where(F.lower("source_url").contains(suffix)).select(
        keep, "pos", "source_url",
        dates.relaxed_date_multi([F.col("text"), F.col("href"), F.col("source_url")], reference).alias("parsed_date"))
    silent = pages.join(linked.select(keep), keep, "left_anti")
    raw = silent.select(keep, F.posexplode(urls.html_pdf_urls(F.col("html"), pattern)).alias("pos", "source_url"))
    embedded = raw.select(keep, "pos", "source_url",
                          dates.relaxed_date(F.col("source_url"), reference).alias("parsed_date"))
    return linked.unionByName(embedded)


def best_candidate(candidates: DataFrame, reference, keep: str = "page_id") -> DataFrame:
    """Per page the latest candidate dated within a week of the reference day, else the first one."""
    near = F.coalesce(dates.within_days(F.col("parsed_date"), reference), F.lit(False))
    order = F.struct(near.alias("near"), F.when(near, F.col("parsed_date")).alias("day"),
                     (-F.col("pos")).alias("early"))
    return candidates.groupBy(keep).agg(F.max_by("source_url", order).alias("source_url"))


# --- provider detection ------------------------------------------------------------------------

def detect_providers(parish: DataFrame, pages: DataFrame, *, limit: int | None = None, keyword: str = KEYWORD,
                     keywords=None, id_provider: str = "parishes_online", id_patterns=None) -> DataFrame:
    """(parish_slug, status, provider, provider_id) for parishes without a provider.

    The homepage decides; otherwise its bulletin links do, in order.  Each page is
    classified once and only the small verdict travels to the join.
    """
    pending = filters.pending_provider(parish, limit).select(F.col("slug").alias("parish_slug"), "homepage_url")
    verdicts = pages.select("url", urls.detect_provider(F.col("html"), keywords, id_provider, id_patterns).alias("v"))
    home = pending.join(verdicts.withColumnRenamed("url", "homepage_url"), "homepage_url", "left")
    unsure = home.where(F.col("v.provider") == "other").select("parish_slug", "homepage_url")
    visited = pages.join(unsure.withColumnRenamed("homepage_url", "url"), "url")
    links = bulletin_hrefs(visited, keyword, "parish_slug")
    linked = (links.join(verdicts.withColumnRenamed("url", "href"), "href")
              .where(F.col("v.provider") != "other")
              .groupBy("parish_slug").agg(F.min_by("v", "pos").alias("linked")))
    both = home.join(linked, "parish_slug", "left")
    chosen = F.when(F.col("v.provider") != "other", F.col("v")).otherwise(F.coalesce("linked", "v"))
    return both.withColumn("c", chosen).select(
        "parish_slug", F.when(F.col("v").isNull(), "failed").otherwise("updated").alias("status"),
        F.col("c.provider").alias("provider"), F.col("c.provider_id").alias("provider_id"))


def detect_counters(detected: DataFrame) -> DataFrame:
    return detected.agg(F.count(F.lit(1)).alias("checked"),
                        F.count_if(F.col("status") == "updated").alias("updated"),
                        F.count_if(F.col("status") == "failed").alias("failed"))
