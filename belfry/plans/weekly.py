"""The weekly chain: fetch -> process -> rebuild -> snapshot -> gate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.plans import fetch, load, process, snapshot
from belfry.session import written
from belfry.sources.documents import BUCKETS, add_to_store, open_store
from belfry.sources.sinks import append_cache


def run_weekly(raw_parish: DataFrame, raw_church: DataFrame, metadata: DataFrame, events: DataFrame, pages: DataFrame,
               downloads: DataFrame, store: str, cache: DataFrame, extractor, *, root: str, now: str,
               today: date, parallelism: int | None = None, buckets: int = BUCKETS) -> dict:
    """Run every stage once; the snapshot is only published when the gate passes.

    ``store`` is where the clustered document store lies; new documents are appended to it.

    Each stage result is written before the next one reads it, so a lost executor costs
    tasks of one stage, not of the whole chain.
    """
    parish = written(load.load_parishes(raw_parish, now), "parish")
    church = written(load.load_churches(raw_church, parish, now), "church")
    reference = F.lit(today.isoformat()).cast("date")
    stored = open_store(parish.sparkSession, store, buckets)
    got = fetch.fetch_bulletins(parish, pages, downloads, metadata, stored, now=now, reference=reference)
    metadata = written(metadata.unionByName(got.metadata), "metadata")
    documents = add_to_store(written(got.blobs, "new-blobs"), store, buckets)
    done = process.process_bulletins(metadata, events, parish, church, documents, cache, extractor,
                                     now=now, today=today, parallelism=parallelism)
    append_cache(done.new_results, cache, f"{root}/cache")
    merged = written(done.metadata, "metadata")
    raw_events = written(done.events.withColumn("idx", F.monotonically_increasing_id()), "events")
    bulletin = load.load_bulletins(merged, parish)
    good, bad = load.load_events(raw_events, church, bulletin)
    tables = {"parish": parish, "church": church, "bulletin": bulletin, "event": good, "event_quarantine": bad}
    counts = {r["table"]: r["n"] for r in load.rebuild_tables(tables, f"{root}/tables").collect()}
    stored = load.open_tables(parish.sparkSession, f"{root}/tables")
    gate = snapshot.refresh(stored["church"], stored["parish"], stored["bulletin"], stored["event"],
                            f"{root}/snapshot", now)
    return {"tables": counts, "gate": gate, "metadata": merged, "events": raw_events,
            "fetched": got.summary, "processed": done.summary}
