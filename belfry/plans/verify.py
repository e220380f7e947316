"""Verification stage: which parishes need a look, and what the extractor said."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.functions.payload import verification_result
from belfry.operators import latest
from belfry.plans.extractors import outcomes
from belfry.session import written
from belfry.sources.documents import church_list, churches_json, with_content


def verified_parishes(parish: DataFrame, church: DataFrame) -> DataFrame:
    """Parishes with at least one church, all of them name- and address-verified."""
    ok = ((F.col("name_verified") == 1) & (F.col("address_verified") == 1)).cast("int")
    full = church.groupBy("parish_id").agg(F.min(ok).alias("ok")).where("ok = 1")
    return parish.join(full.select(F.col("parish_id").alias("id")), "id", "left_semi").select("id", "slug")


def verify_worklist(parish: DataFrame, church: DataFrame, bulletin: DataFrame,
                    parish_name: str | None = None) -> DataFrame:
    """(parish_id, parish_slug, pdf_path, n_churches) of parishes to verify.

    Naming one parish skips the already-verified test.
    """
    if parish_name is not None:
        todo = parish.where(F.col("name") == parish_name)
    else:
        todo = parish.join(verified_parishes(parish, church).select("id"), "id", "left_anti")
    issues = latest.to_verify(bulletin).where(F.col("pdf_path") != "").select("parish_id", "pdf_path")
    sizes = church.groupBy("parish_id").agg(F.count(F.lit(1)).alias("n_churches"))
    return (todo.select(F.col("id").alias("parish_id"), F.col("slug").alias("parish_slug"))
            .join(issues, "parish_id").join(sizes, "parish_id"))


def verify_churches(parish: DataFrame, church: DataFrame, bulletin: DataFrame, documents: DataFrame | str, extractor, *,
                    now: str, today: date, parish_name: str | None = None,
                    parallelism: int | None = None) -> DataFrame:
    """(slug, verified_at, value) per verified parish; failing documents are left out."""
    work = verify_worklist(parish, church, bulletin, parish_name)
    items = written(work.join(church_list(church), "parish_id").select(
        "parish_slug", "pdf_path", churches_json(F.col("churches")).alias("churches_json"), F.lit("ready").alias("status")), "verify-items")
    done = written(outcomes(with_content(items, documents), extractor, today, "parish_slug", parallelism), "verify-outcomes")
    return done.where(F.col("status") == "extracted").select(
        F.col("parish_slug").alias("slug"), F.lit(now).alias("verified_at"),
        verification_result(F.col("result_json")).alias("value"))


def upsert_results(stored: DataFrame, fresh: DataFrame, key: str = "slug") -> DataFrame:
    """Stored results with the fresh ones in place of those of the same key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)
