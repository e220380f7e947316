"""Versions, the document store, and streams that find their state by data."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from belfry.operators import latest
from belfry.plans import extractors, load, snapshot
from belfry.schemas import CHURCH
from belfry.sources import documents, files, sinks, versions
from belfry.streaming import ingest


# --- versions --------------------------------------------------------------------------------------

def local(path):
    return path.removeprefix("file:")


def test_versions_are_whole_or_absent(spark, scratch):
    root = scratch("versions")
    assert versions.latest(spark, root) == (0, {})
    assert versions.commit(spark, root, {"dir": "data/a"}, 0) == 1
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        versions.commit(spark, root, {"dir": "data/b"}, 0)
    with open(f"{local(root)}/_versions/000000000002", "w") as torn:
        torn.write('{"dir": "data/c"')
    assert versions.latest(spark, root) == (1, {"dir": "data/a"})
    assert versions.commit(spark, root, {"dir": "data/d"}, 1) == 2
    assert versions.current_dir(spark, root) == f"{root}/data/d"
    for name in "abd":
        os.makedirs(f"{local(root)}/data/{name}")
    assert versions.clean(spark, root, keep=1) == 2 and os.listdir(f"{local(root)}/data") == ["d"]


def test_csv_and_tables_survive_a_failed_write(spark, scratch):
    path = scratch("parishes.csv")
    one = spark.createDataFrame([("a", "A", "", "", "")], "slug string, name string, website string, bulletin_provider string, provider_id string")
    columns = one.columns
    sinks.write_csv(one, path, columns)
    sinks.write_csv(one.withColumn("name", F.lit("B")), path, columns)
    held = files.parish_csv(spark, path)
    broken = one.withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_csv(broken, path, columns)
    assert [r["name"] for r in held.collect()] == ["B"] == [r["name"] for r in files.parish_csv(spark, path).collect()]
    root = scratch("tables")
    load.rebuild_tables({"a": spark.range(3), "b": spark.range(2)}, root)
    with pytest.raises(Exception, match="lost"):
        load.rebuild_tables({"a": spark.range(9), "b": broken}, root)
    assert {name: df.count() for name, df in load.open_tables(spark, root).items()} == {"a": 3, "b": 2}
    assert {r["table"]: r["n"] for r in load.rebuild_tables({"a": spark.range(5)}, root).collect()} == {"a": 5}
    with pytest.raises(FileNotFoundError):
        load.open_tables(spark, scratch("none"))


# --- documents -------------------------------------------------------------------------------------

def roster(spark):
    parish = spark.createDataFrame([(i, s, s.upper()) for i, s in enumerate("pq")], "id bigint, slug string, name string")
    church = spark.createDataFrame([(i, i, f"c-{s}", "C", None, None, None, None, None, None, None, 1, 1, None) for i, s in enumerate("pq")], CHURCH)
    entries = spark.createDataFrame([(1, "p", "/p/1.pdf"), (2, "q", "/q/2 [a].pdf"), (3, "q", "/q/gone.pdf"), (4, "zz", "/p/1.pdf"), (5, "p", None)],
                                    "idx bigint, parish_slug string, pdf_path string")
    return entries, parish, church


class Length:
    name, version = "length", "v1"

    def extract(self, content, *, churches, today):
        return {"n": len(content), "churches": [c["slug"] for c in churches]}


WANT = {1: ("extracted", None), 2: ("extracted", None), 3: ("skipped", "document missing"), 4: ("skipped", "unknown parish"), 5: ("skipped", "document missing")}


def exchanges_above_content(df):
    """Exchanges between the scan that reads ``content`` and the result."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in text.splitlines() if line.strip()]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    at = next(i for i, line in enumerate(lines) if "Scan" in line and "content" in line)
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line.strip(" :+-*()0123456789").split(" ")[0])
    return [name for name in above if name.startswith("Exchange")]


def test_clustered_store_moves_no_contents(spark, scratch):
    entries, parish, church = roster(spark)
    root = scratch("store")
    documents.add_to_store(spark.createDataFrame([("/p/1.pdf", b"abc"), ("/x", b"unused")], "path string, content binary"), root, 4)
    store = documents.add_to_store(spark.createDataFrame([("/q/2 [a].pdf", b"de"), ("/y", None)], "path string, content binary"), root, 4)
    assert store.count() == 4
    items = documents.work_items(entries, parish, church, store)
    held = documents.with_content(items, store)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_above_content(documents.with_content(items, store)) == []
        paths = documents.paths_of(spark, store)._jdf.queryExecution().executedPlan().toString()
        assert "content" not in paths
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["idx"]: bytes(r["content"]) for r in held.collect()} == {1: b"abc", 2: b"de"}
    done = extractors.all_outcomes(items, store, Length(), date(2026, 1, 1)).collect()
    assert {r["idx"]: (r["status"], r["error"]) for r in done} == WANT
    assert json.loads(next(r["result_json"] for r in done if r["idx"] == 2)) == {"n": 2, "churches": ["c-q"]}


def test_folder_of_files(spark, scratch, monkeypatch):
    monkeypatch.setattr(documents, "SLICE", 1)
    entries, parish, church = roster(spark)
    root = scratch("folder")
    for path, content in (("/p/1.pdf", b"abc"), ("/q/2 [a].pdf", b"de"), ("/q/other.pdf", b"x")):
        os.makedirs(os.path.dirname(local(root) + path), exist_ok=True)
        with open(local(root) + path, "wb") as out:
            out.write(content)
    items = documents.work_items(entries, parish, church, root).cache()
    done = extractors.all_outcomes(items, root, Length(), date(2026, 1, 1)).collect()
    assert {r["idx"]: (r["status"], r["error"]) for r in done} == WANT
    assert json.loads(next(r["result_json"] for r in done if r["idx"] == 1))["n"] == 3
    assert documents.with_content(items.where("idx = 3"), root).count() == 0


def test_unreadable_documents_are_skipped(spark):
    entries, parish, church = roster(spark)
    store = spark.createDataFrame([("/p/1.pdf", b"abc"), ("/q/2 [a].pdf", None)], "path string, content binary")
    items = documents.work_items(entries, parish, church, store)
    assert {r["idx"]: (r["status"], r["error"]) for r in extractors.all_outcomes(items, store, Length(), date(2026, 1, 1)).collect()} == {
        **WANT, 2: ("skipped", "document unreadable")}
    later = store.where("content is not null")
    assert {r["idx"]: r["error"] for r in extractors.all_outcomes(items, later, Length(), date(2026, 1, 1)).collect()}[2] == "document unreadable"


def test_equal_documents_are_stored_once(spark):
    fetched = spark.createDataFrame([("p", "u1", b"a", "t"), ("p", "u2", b"a", "t"), ("q", "u3", b"a", "t"), ("p", "u4", b"b", "t")],
                                    "parish_slug string, source_url string, content binary, fetched_at string")
    nothing = spark.createDataFrame([], "path string, content binary")
    blobs, rows = documents.store_documents(fetched, nothing)
    got = {r["path"]: bytes(r["content"]) for r in blobs.collect()}
    assert blobs.count() == len(got) == 3 and rows.count() == 4
    assert {r["pdf_path"] for r in rows.collect()} == set(got)
    again, _ = documents.store_documents(fetched, spark.createDataFrame(list(got.items())[:1], "path string, content binary"))
    assert again.count() == 2


# --- streams ---------------------------------------------------------------------------------------

def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_winners_survive_a_new_checkpoint(spark, scratch, monkeypatch):
    monkeypatch.setattr(ingest, "FOLD", 2)
    schema = "idx bigint, parish_slug string, source_url string, published_date string, fetched_at string, processed_at string"
    rows = [(i, f"p{i % 4}", f"u{i}", f"2026-01-{(i * 7) % 28 + 1:02d}", "f", None if i % 5 == 0 else "x") for i in range(40)]
    first, root = scratch("in"), scratch("out")
    for part in range(4):
        feed(spark, first, rows[part::8], schema)
    ingest.start(stream(spark, first, schema), ingest.winner_upsert(root), scratch("state")).awaitTermination()
    shown = lambda df: {(r["parish_slug"], r["idx"]) for r in df.collect()}
    assert shown(ingest.current_winners(spark, root)) == shown(latest.to_show(spark.createDataFrame([r for p in range(4) for r in rows[p::8]], schema), ["idx"]))
    # another source, a new checkpoint: only the rest of the rows arrive, and some of the old ones again
    second = scratch("in")
    for part in (7, 6, 5, 4, 0):
        feed(spark, second, rows[part::8], schema)
    for _ in range(2):
        ingest.start(stream(spark, second, schema), ingest.winner_upsert(root), scratch("state")).awaitTermination()
    assert shown(ingest.current_winners(spark, root)) == shown(latest.to_show(spark.createDataFrame(rows, schema), ["idx"]))
    levels = [level for level, _ in versions.latest(spark, root)[1]["dirs"]]
    assert max(levels) >= 1 and all(levels.count(x) <= 2 for x in levels)
    assert ingest.current_winners(spark, scratch("none")).count() == 0


def test_cache_is_never_overwritten(spark, scratch):
    schema = "id bigint, content_hash string"
    source, root = scratch("in"), scratch("cache")
    feed(spark, source, [(1, "a"), (2, "b"), (3, None), (4, ""), (5, "a")], schema)
    feed(spark, source, [(6, "b"), (7, "c")], schema)
    run = lambda stamp: (lambda fresh: fresh.select("content_hash", F.lit(stamp).alias("result_json")))
    ingest.start(stream(spark, source, schema), ingest.unseen_hashes(root, run("one")), scratch("state")).awaitTermination()
    feed(spark, source, [(8, "d"), (9, "a")], schema)
    ingest.start(stream(spark, source, schema), ingest.unseen_hashes(root, run("two")), scratch("state")).awaitTermination()
    got = sorted((r["content_hash"], r["result_json"]) for r in ingest.cached_results(spark, root).collect())
    assert got == [("a", "one"), ("b", "one"), ("c", "one"), ("d", "two")]
    pruned = ingest.cached_results(spark, root).where(F.col("bucket").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in pruned or "bucket" in pruned.split("PartitionFilters: [")[1].split("]")[0]


EVENT = ("id bigint, church_id bigint, bulletin_id bigint, event_type string, event_kind string, day_of_week string, date string, "
         "start_time int, end_time int, cancelled int, page_number int, note string")


def event(i, bulletin, kind="weekly", start=480):
    return (i, bulletin % 10, bulletin, "mass", kind, "Sunday", None, start + i, None, 0, 1, None)


def view_inputs(spark, newest):
    """Two bulletins per parish; ``newest`` says which one is shown."""
    church = spark.createDataFrame([(i, i, f"c{i}", "C", None, None, None, None, None, None, None, 1, 1, None) for i in range(4)], CHURCH)
    parish = spark.createDataFrame([(i, f"p{i}", f"https://p{i}") for i in range(4)], "id bigint, slug string, homepage_url string")
    rows = [(p + 10 * n, p, f"u{p}-{n}", "2026-02-01" if n == newest.get(p, 0) else "2026-01-01", "f", "x") for p in range(4) for n in (0, 1)]
    bulletin = spark.createDataFrame(rows, "id bigint, parish_id bigint, source_url string, published_date string, fetched_at string, processed_at string")
    return church, parish, bulletin


def ids(spark, root):
    return sorted(r["id"] for r in ingest.published(spark, root)[1].collect())


def test_view_follows_the_log(spark, scratch, monkeypatch):
    monkeypatch.setattr(ingest, "FOLD", 2)
    source, log, root = scratch("in"), scratch("log"), scratch("view")
    tables = view_inputs(spark, {})
    batches = [[event(i, i % 4 + 10 * (i % 3 == 2)) for i in range(low, low + 12)] for low in (0, 12, 24, 36)]
    for rows in batches:
        feed(spark, source, rows, EVENT)
    ingest.snapshot_refresh(stream(spark, source, EVENT), *tables, log, root, scratch("state"), "now").awaitTermination()
    every = [e for rows in batches for e in rows]
    want = sorted(e[0] for e in every if e[2] < 10)
    assert ids(spark, root) == want and versions.latest(spark, root)[0] == 4
    # a new checkpoint delivers everything again: nothing doubles
    ingest.snapshot_refresh(stream(spark, source, EVENT), *tables, log, root, scratch("state"), "later").awaitTermination()
    assert ids(spark, root) == want
    # a parish whose newer issue has none of its weekly events: refused, and nothing is lost by the refusal
    other = view_inputs(spark, {0: 1})
    before = versions.latest(spark, root)[0]
    more = spark.createDataFrame([event(100, 1), event(101, 11)], EVENT)
    ingest.append_events(log, more)
    result = ingest.publish_view(*other, log, root, "refused")
    assert not result["passed"] and versions.latest(spark, root)[0] == before and ids(spark, root) == want
    assert ingest.publish_view(*tables, log, root, "again")["passed"]
    assert ids(spark, root) == sorted([*want, 100])
    batch = snapshot.snapshot_event(spark.createDataFrame(every + [event(100, 1), event(101, 11)], EVENT), tables[2])
    assert sorted(r["id"] for r in batch.collect()) == ids(spark, root)


def test_view_makes_only_touched_buckets_anew(spark, scratch):
    log, root = scratch("log"), scratch("view")
    tables = view_inputs(spark, {})
    ingest.append_events(log, spark.createDataFrame([event(i, i % 4) for i in range(40)], EVENT))
    ingest.publish_view(*tables, log, root, "one")
    first = versions.latest(spark, root)[1]["buckets"]
    ingest.append_events(log, spark.createDataFrame([event(90, 2)], EVENT))
    ingest.publish_view(*tables, log, root, "two")
    second = versions.latest(spark, root)[1]["buckets"]
    changed = [b for b in second if second[b] != first.get(b)]
    assert len(changed) == 1 and len(set(first) & set(second)) == len(first) > 1
    with pytest.raises(FileNotFoundError):
        ingest.published(spark, scratch("none"))
    empty = ingest.publish_view(*tables, scratch("log"), scratch("view"), "x")
    assert not empty["passed"] and empty["version"] == 0


# --- JSON documents --------------------------------------------------------------------------------

def put(path, text):
    os.makedirs(os.path.dirname(local(path)), exist_ok=True)
    with open(local(path), "w", encoding="utf-8") as out:
        out.write(text)


def test_run_documents_are_type_guarded(spark, scratch):
    from belfry.sources.runs import metadata_documents, read_run_documents
    root = scratch("documents")
    put(f"{root}/a/events.json", json.dumps([
        {"bulletin_source_url": "u1", "church_slug": 5, "start_time": "8", "day_of_week": 3, "cancelled": 1, "page_number": 2, "note": "n"},
        {"bulletin_source_url": 7, "church_slug": "c"}, "text", None, [1], {"church_slug": "c"}, {"bulletin_source_url": "u2", "page_number": "x"}]))
    put(f"{root}/a/bulletins.json", json.dumps([{"bulletin_source_url": "u1"}, {"bulletin_source_url": "", "source_url": "u3"}, {"source_url": "u4", "event_count": 2},
                                                {"bulletin_source_url": 5, "source_url": "u5"}, {"bulletin_source_url": None, "source_url": 6}, 4]))
    put(f"{root}/a/run.json", json.dumps({"classifier_version": "v1", "cache_hits": 3, "wall_seconds": 1.5, "errors": [{"x": 1}, {"x": 2}]}))
    put(f"{root}/b/events.jsonl", '{"bulletin_source_url":"u1"}\n{broken\n5\n{"bulletin_source_url":"u9"}\n')
    put(f"{root}/b/bulletins.json", '[{"bulletin_source_url": "cut')
    put(f"{root}/b/run.json", "{")
    events, manifest, summary = read_run_documents(spark, root, ["a", "b"])
    got = {(r["classifier"], r["bulletin_source_url"]): r for r in events.collect()}
    assert set(got) == {("a", "u1"), ("a", "u2"), ("b", "u1"), ("b", "u9")}
    one = got["a", "u1"]
    assert (one["church_slug"], one["start_time"], one["day_of_week"], one["cancelled"], one["page_number"], one["note"]) == ("5", "8", None, True, 2, "n")
    assert got["a", "u2"]["page_number"] is None and got["a", "u2"]["cancelled"] is False
    assert sorted((r["classifier"], r["bulletin_source_url"], r["event_count"]) for r in manifest.collect()) == [("a", "u1", None), ("a", "u3", None), ("a", "u4", 2)]
    assert [(r["classifier"], r["classifier_version"], r["cache_hits"], r["errors"], r["wall_seconds"]) for r in summary.collect()] == [("a", "v1", 3, 2, 1.5)]
    with pytest.raises(FileNotFoundError, match="'c'"):
        read_run_documents(spark, root, ["a", "c"])
    put(f"{root}/metadata.json", json.dumps([{"source_url": "u1", "parish_slug": 4, "published_date": "d"}, {"source_url": 1}, "x", {"source_url": "u1", "pdf_path": "/p"}]))
    assert [(r["idx"], r["source_url"], r["pdf_path"], r["parish_slug"], r["published_date"]) for r in metadata_documents(spark, f"{root}/metadata.json").collect()] == [
        (0, "u1", None, None, "d"), (3, "u1", "/p", None, None)]
    assert metadata_documents(spark, f"{root}/none.json").count() == 0
