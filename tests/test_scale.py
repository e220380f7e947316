"""What a query does not need is not written, moved or parsed; the rows stay the same."""

import gzip
import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from belfry.functions import payload, text
from belfry.operators import keyfilter
from belfry.plans import compare, load, process, snapshot
from belfry.schemas import BULLETIN, CHURCH, EVENT, METADATA, RAW_EVENT
from belfry.sources.files import variant_rows
from belfry.streaming import ingest
from catalog import loading
from catalog.registry import QUERIES, Domain

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_are_not_written_and_equal_tables(spark):
    Domain._written.clear()
    d = Domain(spark, SF)
    viewed = {name: d.view(name) for name in ("raw_event", "payload", "snapshot_event", "church")}
    assert not d._written
    for name, df in viewed.items():
        stored = d.table(name).select(*df.columns)
        assert df.exceptAll(stored).isEmpty() and stored.exceptAll(df).isEmpty()
    assert {key[2] for key in d._written} == set(viewed)
    Domain._written.clear()


def test_snapshot_moves_likely_events_only(spark):
    bulletin = spark.createDataFrame([(1, 7, "u", None, "2026-01-01", None, None, None), (2, 7, "v", None, "2026-02-01", None, None, None),
                                      (3, None, "w", None, None, None, None, None)], BULLETIN)
    rows = [(i, 1, b, "mass", "weekly", None, None, 480, None, 0, 1, None) for i, b in enumerate([1, 2, 2, 3, None, 9])]
    shown = snapshot.snapshot_event(spark.createDataFrame(rows, EVENT), bulletin)
    assert sorted(r["id"] for r in shown.collect()) == [1, 2, 3]
    assert "__at" in plan_of(shown)


def test_compaction_moves_likely_rows_only(spark):
    meta = spark.createDataFrame([(0, "p", "u1", None, None, "2026-01-01", "x", "2026-01-01"), (1, "p", "u2", None, None, "2026-01-02", "x", "2026-02-01"),
                                  (2, "q", None, None, None, None, "x", None)], METADATA)
    urls = ["u1", "u2", "u2", None, "u3"]
    events = spark.createDataFrame([("c", u, "mass", "weekly", None, None, "8", None, False, i, None) for i, u in enumerate(urls)], RAW_EVENT)
    kept = process.compact(events, meta)
    assert sorted(r["page_number"] for r in kept.collect()) == [1, 2, 3]
    assert "__at" in plan_of(kept)


def test_more_bits_let_fewer_rows_pass(spark):
    table, keys = spark.range(200_000), spark.range(0, 200_000, 2)
    passed = [keyfilter.likely(table, keys, "id", size=size).count() for size in (17, 22)]
    assert 100_000 <= passed[1] < passed[0]


def test_values_are_parsed_once(spark, scratch):
    path = scratch("lines") + ".jsonl"
    spark.createDataFrame([('{"a":"x"}',), ("[1",), ("3",)], "value string").coalesce(1).write.text(path)
    rows = variant_rows(spark, path).select(F.try_variant_get("v", "$.a", "string").alias("a")).where("a is not null")
    assert [r["a"] for r in rows.collect()] == ["x"] and plan_of(rows).lower().count("parse_json") + plan_of(rows).count("parseJson") <= 1
    df = spark.createDataFrame([(1, '{"weekly_schedule":{"masses":[{"church_slug":"c","start_time":"8:00","day_of_week":"Sunday"}]}}'), (2, None)], "id int, t string")
    read = text.bound(df, r=payload.payload_result(F.col("t"))).where(~F.col("r.wrong_bulletin")).select("id", F.explode("r.events").alias("e"))
    assert [(r["id"], r["e"]["church_slug"]) for r in read.collect()] == [(1, "c")]
    once = plan_of(df.select("id", payload.payload_result(F.col("t")).alias("r")))
    assert plan_of(read).count("weekly_schedule") == once.count("weekly_schedule")


def test_event_times_are_read_once(spark):
    raw = spark.createDataFrame([(0, "c-1", "u", "mass", None, "Sunday", None, "8:00 AM", None, None, 1, " ")], "idx bigint, " + RAW_EVENT)
    church = spark.createDataFrame([(5, 7, "c-1", *[None] * 11)], CHURCH)
    bulletin = spark.createDataFrame([(9, 7, "u", *[None] * 5)], BULLETIN)
    good = load.load_events(raw, church, bulletin)[0]
    assert [(r["id"], r["church_id"], r["bulletin_id"], r["start_time"]) for r in good.collect()] == [(0, 5, 9, 480)]
    assert plan_of(good).lower().count("= midnight)") <= 2  # start and end


def test_log_rows_of_other_documents_do_not_move_but_still_count(spark, scratch):
    """An event that named an unshown document first stays with it, as when all rows were grouped."""
    row = lambda i, b: (i, 1, b, "mass", "weekly", None, None, 480, None, 0, 1, None)
    log = scratch("log")
    ingest.append_events(log, spark.createDataFrame([row(1, 10), row(2, 20), row(3, 10)], EVENT))
    ingest.append_events(log, spark.createDataFrame([row(1, 20), row(2, 20), row(4, 20)], EVENT))
    shown = spark.createDataFrame([(20,)], "bulletin_id bigint")
    every = list(range(ingest.VIEW_BUCKETS))
    want = ingest.logged_events(spark, log, every).join(shown, "bulletin_id").select("id", "arrival")
    got = ingest.logged_events(spark, log, every, shown).join(shown, "bulletin_id").select("id", "arrival")
    assert sorted(got.collect()) == sorted(want.collect()) and {r["id"] for r in got.collect()} == {2, 4}
    assert "__at" in plan_of(got)


RUN_EVENT = f"classifier string, idx bigint, {RAW_EVENT}"


def read_gzipped(folder):
    names = sorted(n for n in os.listdir(folder) if n.startswith("part"))
    assert names and all(n.endswith(".gz") for n in names)
    return "".join(gzip.open(f"{folder}/{n}", "rt", encoding="utf-8").read() for n in names)


def test_report_leaves_its_gzipped_files_and_nothing_else(spark, scratch):
    """Texts are sorted as narrow rows and written compressed; what was kept to write them, shuffles too, goes again."""
    row = lambda run, i, day=None, start="8", church="c", note=None: (run, i, church, "u", "mass", "weekly", day, None, start, None, None, i, note)
    rows = [row("a", 1, "Monday"), row("b", 2, "Monday", note="é"), row("a", 3, ""), row("a", 4), row("a", 5, start=None), row("a", 6, church=None), row("b", 7, start="9")]
    meta = spark.createDataFrame([(0, "p", "u", None, None, None, None, "2026-01-04"), (1, "o", "v", "/v", None, None, None, None)], METADATA)
    manifest = spark.createDataFrame([("a", "v"), ("b", "v")], "classifier string, bulletin_source_url string")
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    report = compare.compare(spark.createDataFrame(rows, RUN_EVENT), manifest, meta, ["a", "b"])
    path = scratch("compared")
    compare.write_report(report, ["a", "b"], path, "now", "gzip")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    here = path.removeprefix("file:")
    kept = ("report-events-", "report-per_bulletin-", "report-places-", "report-placed-", "report-stats-", "report-pairwise-", "report-one_sided-")
    assert not [n for n in os.listdir(os.path.dirname(here)) if n.startswith(kept)]
    assert sorted(os.listdir(here)) == ["events", "markdown", "one_sided", "pairwise", "per_bulletin", "report.json", "stats"]
    empty, full = json.loads(read_gzipped(f"{here}/report.json"))["pairwise"][0]["per_bulletin"]
    assert (empty["bulletin_source_url"], empty["same"], empty["only_in_a"], empty["only_in_b"]) == ("v", [], [], [])
    assert [(e["a"]["page_number"], e["b"]["page_number"], e["b"]["note"], e["a"]["cancelled"]) for e in full["same"]] == [(1, 2, "é", False)]
    # the missing church and start count as empty text in the order and are missing in the event; an empty day comes before a missing one
    assert [(e["page_number"], e["church_slug"], e["day_of_week"], e["start_time"]) for e in full["only_in_a"]] == [
        (6, None, None, "8"), (5, "c", None, None), (3, "c", "", "8"), (4, "c", None, "8")]
    assert [e["page_number"] for e in full["only_in_b"]] == [7]
    lines = read_gzipped(f"{here}/markdown").splitlines()
    assert lines[lines.index("#### p - 2026-01-04"):] == [
        "#### p - 2026-01-04", "- Source URL: u", "- Counts: same 1, only a 4, only b 1, Jaccard 0.1667", "", "**Same**", "- c | mass weekly | Monday | 8 | page 1",
        "", "**Only a**", "- mass weekly | 8 | page 6", "- c | mass weekly | page 5", "- c | mass weekly | 8 | page 3", "- c | mass weekly | 8 | page 4",
        "", "**Only b**", "- c | mass weekly | 9 | page 7"]
    assert lines[lines.index("#### o"):][:7] == ["#### o", "- Source URL: v", "- Source PDF: `/v`", "- Counts: same 0, only a 0, only b 0, Jaccard 1.0", "", "**Same**", "- None"]


def test_json_list_is_written_gzipped_and_its_table_is_not(spark, scratch, monkeypatch):
    """Events go straight into gzipped lines; every row comes back, those with missing parts and repeated ones, too."""
    day = datetime(1998, 3, 4)
    line = lambda order, number, part, flag="N", shipped=day: (order, part, 3, number, 5.0, 10.5, flag, shipped)
    lines = [line(1, 1, 4), line(1, 2, 5, "R"), line(2, 7, 6), line(2, 7, 6), line(None, 3, 7), line(3, 3, None), line(3, 4, 9, None), line(9, 1, 4), line(1, 3, 4, "N", None)]
    folder, path = scratch("tables"), scratch("lines") + "/events.jsonl"
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, "
                                 "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (3, None), (None, 12)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    monkeypatch.setattr(loading, "scratch_path", lambda spark, name: os.path.dirname(path))
    rows = QUERIES["src_json_list"](spark, folder)
    want = Domain(spark, folder).view("raw_event").select(*rows.columns)
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty() and rows.count() == 7
    assert read_gzipped(path.removeprefix("file:")).count("\n") == 7
    assert not [key for key in Domain._written if key[1] == folder]
