"""Referential and range rules as reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belfry.functions.times import LAST_MINUTE


def orphans(parish: DataFrame, church: DataFrame, bulletin: DataFrame, event: DataFrame) -> DataFrame:
    """(edge, id) rows whose mandatory or filled-in reference has no target."""
    edges = [
        ("church.parish_id", church, "parish_id", parish),
        ("bulletin.parish_id", bulletin, "parish_id", parish),
        ("event.church_id", event, "church_id", church),
        ("event.bulletin_id", event.where(F.col("bulletin_id").isNotNull()), "bulletin_id", bulletin),
    ]
    found = [child.select("id", F.col(ref).alias("ref"))
             .join(target.select(F.col("id").alias("ref")), "ref", "left_anti")
             .select(F.lit(edge).alias("edge"), "id") for edge, child, ref, target in edges]
    return reduce(DataFrame.unionByName, found)


def range_problem(start: Column, end: Column, cancelled: Column) -> Column:
    """Name of the violated range rule, null for a good row."""
    return (F.when(start.isNull(), "start_time missing")
            .when(~start.between(0, LAST_MINUTE), "start_time out of range")
            .when(end.isNotNull() & ~end.between(0, LAST_MINUTE), "end_time out of range")
            .when(cancelled.isNull() | ~cancelled.isin(0, 1), "cancelled not 0/1"))
