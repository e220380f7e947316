"""Stored web pages and the links on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions.urls import anchors


def page_html(parts: DataFrame) -> DataFrame:
    """(page_id, html): main document and frames joined by a line break, in part order.

    ``parts``: page_id, part_no (0 is the main document), html.  A page has few parts.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "html")))
    return parts.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["html"]), "\n").alias("html"))


def page_anchors(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per anchor: the ``keep`` columns plus pos, href, text."""
    return (pages.select(*keep, F.posexplode(anchors(F.col("html"))).alias("pos", "a"))
            .select(*keep, "pos", "a.href", "a.text"))
