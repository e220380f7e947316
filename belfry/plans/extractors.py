"""Pluggable per-document extractors.

An extractor is an object with ``name``, ``version`` and
``extract(content: bytes, *, churches: list[dict], today: date) -> dict``.  It runs inside
``mapInPandas`` tasks; what it returns is read back through the type guards.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.session import written
from belfry.sources.documents import UNREADABLE, with_content

REGISTRY: dict[str, Callable[[], object]] = {}


def register(name: str, factory: Callable[[], object]) -> None:
    REGISTRY[name] = factory


def available() -> list[str]:
    return sorted(REGISTRY)


def get_extractor(name: str):
    if name not in REGISTRY:
        raise KeyError(f"Unknown classifier {name!r}. Available: {', '.join(available()) or '(none)'}")
    return REGISTRY[name]()


def outcomes(items: DataFrame, extractor, today: date, key: str = "idx",
             parallelism: int | None = None) -> DataFrame:
    """(key, status, error, result_json): one outcome per ready work item.

    ``items`` holds key, content and churches_json.  A document that fails becomes an
    ``error`` row and never stops the others; one without content is ``skipped``.  ``parallelism`` bounds the number of
    documents in work at once.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, content, churches in zip(batch[key], batch["content"], batch["churches_json"]):
                if content is None:
                    rows.append((k, "skipped", UNREADABLE, None))
                    continue
                try:
                    found = extractor.extract(bytes(content), churches=json.loads(churches), today=today)
                    rows.append((k, "extracted", None, json.dumps(found, ensure_ascii=False)))
                except Exception as exc:
                    rows.append((k, "error", repr(exc), None))
            yield pd.DataFrame(rows, columns=[key, "status", "error", "result_json"])

    # the extractor class travels with the job: executors need no copy of its module
    home = type(extractor).__module__
    if home != "__main__":
        cloudpickle.register_pickle_by_value(sys.modules[home])
    ready = items.select(key, "content", "churches_json")
    if parallelism:
        ready = ready.repartition(parallelism)
    kind = dict(items.dtypes)[key]
    return ready.mapInPandas(run, f"{key} {kind}, status string, error string, result_json string")


def all_outcomes(items: DataFrame, documents: DataFrame | str, extractor, today: date,
                 parallelism: int | None = None) -> DataFrame:
    """Outcomes of the ready items plus a ``skipped`` row, with the reason, for every other item.

    ``items`` is read several times, so it should be written.  Outcomes are written once: a ready item
    without one could not be read when its turn came.
    """
    ran = written(outcomes(with_content(items, documents), extractor, today, parallelism=parallelism), "ran")
    lost = items.where(F.col("status") == "ready").join(ran.select("idx"), "idx", "left_anti").withColumn("reason", F.lit(UNREADABLE))
    skipped = items.where(F.col("status") != "ready").unionByName(lost).select(
        "idx", F.lit("skipped").alias("status"), F.col("reason").alias("error"),
        F.lit(None).cast("string").alias("result_json"))
    return ran.unionByName(skipped)
