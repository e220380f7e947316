"""Query registry: each entry pairs a Spark query with its DuckDB check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from belfry.operators import latest
from belfry.operators.keyfilter import MANY_BITS, likely
from belfry.plans.snapshot import EVENT_COLUMNS
from belfry.session import scratch_path, written
from catalog.projection import BASE, SPARK, TABLES, needed, with_prefix


class Domain:
    """Domain tables of one input directory, each written once per application."""

    _written: dict[tuple[str, str, str], str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Inputs with fewer splits than cores are dealt out evenly; larger ones stay as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir, name

    def _built(self, name: str, **given: DataFrame) -> DataFrame:
        """The table's SQL over its inputs; only a table that the SQL reads more than once is written for it."""
        build, deps = TABLES[name]
        sql = build(SPARK).replace("{", "{{").replace("}", "}}")
        frames = dict(given)
        for dep in deps:
            sql, times = re.subn(rf"\b(from|join) {dep}\b", rf"\1 {{{dep}}}", sql)
            if dep not in frames:
                frames[dep] = self.spread(self.base(dep)) if dep in BASE else self.view(dep) if times == 1 else self.table(dep)
        return self.spark.sql(sql, **frames)

    def view(self, name: str) -> DataFrame:
        """A table that its query reads once: it is not written, and columns nobody asks for are not made."""
        if self._key(name) in self._written:
            return self.table(name)
        return self._snapshot_event() if name == "snapshot_event" else self._built(name)

    def _snapshot_event(self) -> DataFrame:
        """The rows of the table's SQL; lines and orders of documents that are not shown never move."""
        shown = written(latest.for_snapshot(self.view("bulletin")).select("id"), "shown")
        own = {dep: likely(self.spread(self.base(dep)), shown, key, "id", MANY_BITS) for dep, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
        event = self._built("event", **own)
        return event.join(shown.withColumnRenamed("id", "bulletin_id"), "bulletin_id").select(*EVENT_COLUMNS)

    def table(self, name: str) -> DataFrame:
        key = self._key(name)
        if key not in self._written:
            path = scratch_path(self.spark, name)
            self.view(name).write.mode("errorifexists").parquet(path)
            self._written[key] = path
        return self.spark.read.parquet(self._written[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EXTRA: dict[str, tuple[str, str]] = {}


def define(name: str, body: str) -> None:
    """Name a DuckDB CTE that several checks share."""
    EXTRA[name] = (name, body)


def oracles() -> dict[str, str]:
    """Complete DuckDB text per query."""
    return {name: full_sql(sql) for name, sql in ORACLES.items()}


def _mentioned(text: str, names) -> set[str]:
    return {n for n in names if re.search(rf"\b{n}\b", text)}


def full_sql(sql: str) -> str:
    extras: list[str] = []

    def pull(text: str) -> None:
        for n in EXTRA:
            if n not in extras and re.search(rf"\b{n}\b", text):
                pull(EXTRA[n][1])
                if n not in extras:
                    extras.append(n)

    pull(sql)
    text = sql + " " + " ".join(EXTRA[n][1] for n in extras)
    extra = ", ".join(f"{n} as materialized ({EXTRA[n][1]})" for n in extras)
    return with_prefix(sql, _mentioned(text, TABLES), extra)


def query(name: str, sql: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``name`` with its check."""

    def register(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


__all__ = ["Domain", "QUERIES", "ORACLES", "define", "query", "needed"]
