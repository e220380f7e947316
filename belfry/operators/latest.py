"""The different notions of "latest bulletin", all as one-pass top-1 aggregations.

``max_by`` over a rank struct combines on the map side, so a parish holding a large
share of all bulletins costs one partial row per task instead of one huge sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, by: str, rank: list[str], tie: str, carry: list[str]) -> DataFrame:
    """One row per ``by``: the ``carry`` columns of the row ranking highest.

    Rank columns are text; null ranks as empty text.  ``tie`` must be unique.
    """
    order = F.struct(*[F.coalesce(c, F.lit("")).alias(f"r{i}") for i, c in enumerate(map(F.col, rank))],
                     F.col(tie).alias("tie"))
    best = F.max_by(F.struct(*[F.col(c) for c in carry]), order)
    return df.groupBy(by).agg(best.alias("best")).select(by, "best.*")


def to_process(metadata: DataFrame, carry: list[str]) -> DataFrame:
    """Most recently fetched document per parish, among rows that have a file."""
    usable = metadata.where((F.col("pdf_path") != "") & F.col("parish_slug").isNotNull())
    return newest(usable, "parish_slug", ["fetched_at", "published_date"], "idx", carry)


def to_show(metadata: DataFrame, carry: list[str]) -> DataFrame:
    """Most recently published document per parish, among processed rows."""
    done = metadata.where((F.col("processed_at") != "") & F.col("parish_slug").isNotNull())
    return newest(done, "parish_slug", ["published_date", "fetched_at", "processed_at"], "idx", carry)


def for_snapshot(bulletin: DataFrame) -> DataFrame:
    """(parish_id, id) of the bulletin whose events are published."""
    return newest(bulletin, "parish_id", ["published_date", "fetched_at", "processed_at"], "id", ["id"])


def url_for_snapshot(bulletin: DataFrame) -> DataFrame:
    """(parish_id, bulletin_url) of the newest bulletin that has a URL."""
    known = bulletin.where(F.col("source_url").isNotNull())
    return (newest(known, "parish_id", ["published_date", "fetched_at", "processed_at"], "id", ["source_url"])
            .withColumnRenamed("source_url", "bulletin_url"))


def to_verify(bulletin: DataFrame) -> DataFrame:
    """(parish_id, id, pdf_path) of the most recently fetched bulletin with a file."""
    return newest(bulletin.where(F.col("pdf_path").isNotNull()), "parish_id", ["fetched_at"], "id",
                  ["id", "pdf_path"])
