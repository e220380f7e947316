import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import catalog.stages  # noqa: F401
from belfry import schemas
from belfry.operators import latest, quality, unique
from belfry.plans import load, merge, process, snapshot, verify
from belfry.sources import files, sinks
from catalog.registry import QUERIES, Domain

META = "idx bigint, parish_slug string, source_url string, pdf_path string, fetched_at string, processed_at string, published_date string"


def meta(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], META)


def greedy(rows):
    kept, a, b = [], set(), set()
    for i, x, y in rows:
        if x not in a and y not in b:
            kept.append(i)
            a.add(x)
            b.add(y)
    return kept


def test_greedy_unique_matches_row_by_row_insertion(spark):
    rng = random.Random(7)
    rows = [(i, f"s{rng.randrange(12)}", f"u{rng.randrange(12)}", "n") for i in range(40)] + [(40, "z", "z", None), (41, None, "q", "n")]
    df = spark.createDataFrame(rows, "idx bigint, slug string, url string, name string")
    got = sorted(r["idx"] for r in unique.greedy_unique(df, "slug", "url", ["name"]).collect())
    assert got == greedy([r[:3] for r in rows[:40]])


def test_refused_row_does_not_claim_its_other_key(spark):
    df = spark.createDataFrame([(1, "s1", "u1"), (2, "s1", "u2"), (3, "s2", "u2")], "idx bigint, slug string, url string")
    assert sorted(r["idx"] for r in unique.greedy_unique(df, "slug", "url", []).collect()) == [1, 3]


def test_null_urls_never_conflict(spark):
    df = spark.createDataFrame([(1, 1, "u"), (2, 1, "u"), (3, 1, None), (4, 1, None), (5, 2, "u")], "idx bigint, p int, url string")
    assert sorted(r["idx"] for r in unique.first_wins_null_free(df, ["p", "url"], "url").collect()) == [1, 3, 4, 5]


def test_work_and_show_choices_differ(spark):
    rows = [("p", "new", "/a", "2026-01-01", "x", "2026-01-05"), ("p", "reissue", "/b", "2026-02-01", "x", "2025-12-01")]
    for order in itertools.permutations(enumerate(rows)):
        df = spark.createDataFrame([(i, *r) for i, r in order], META)
        assert latest.to_process(df, ["source_url"]).first()["source_url"] == "reissue"
        assert latest.to_show(df, ["source_url"]).first()["source_url"] == "new"


def test_done_winner_hides_older_pending(spark):
    from belfry.operators.filters import pending_process
    df = meta(spark, ("p", "old", "/a", "2026-01-01", None, None), ("p", "new", "/b", "2026-02-01", "done", None), ("q", "only", "/c", None, None, None))
    assert [r["source_url"] for r in pending_process(latest.to_process(df, ["source_url", "processed_at"])).collect()] == ["only"]


def test_compaction(spark):
    m = meta(spark, ("p", "u1", "/a", "1", "x", "2026-01-01"), ("p", "u2", "/b", "2", "x", "2026-02-01"), ("q", None, "/c", "1", "x", None))
    ev = spark.createDataFrame([("u1", 1), ("u2", 2), (None, 3), ("gone", 4)], "bulletin_source_url string, n int")
    once = process.compact(ev, m)
    assert sorted(r["n"] for r in once.collect()) == [2, 3]
    assert sorted(r["n"] for r in process.compact(once, m).collect()) == [2, 3]


def snapshot_frames(spark):
    parish = spark.createDataFrame([(1, "p", "P", "h")], "id bigint, slug string, name string, homepage_url string")
    church = spark.createDataFrame([(5, 1, "c", "C")], "id bigint, parish_id bigint, slug string, name string")
    for c in ("address_line1", "address_line2", "city", "state", "postal_code"):
        church = church.withColumn(c, F.lit(None).cast("string"))
    church = church.withColumn("latitude", F.lit(1.0)).withColumn("longitude", F.lit(2.0))
    bulletin = spark.createDataFrame([(1, 1, "url", "2026-01-01", None, None), (2, 1, None, "2026-02-01", None, None)],
                                     "id bigint, parish_id bigint, source_url string, published_date string, fetched_at string, processed_at string")
    event = spark.createDataFrame([(i, 5, b, "mass", "weekly", "Sunday", None, 480 + i, None, 0, 1, None) for i, b in enumerate([1, 2, 2, None])], schemas.EVENT)
    return church, parish, bulletin, event


def test_newest_without_url_splits_the_two_choices(spark):
    church, parish, bulletin, event = snapshot_frames(spark)
    assert snapshot.snapshot_church(church, parish, bulletin).first()["bulletin_url"] == "url"
    assert sorted(r["id"] for r in snapshot.snapshot_event(event, bulletin).collect()) == [1, 2]


def test_gate_edges(spark):
    church, _, _, event = snapshot_frames(spark)
    one = event.select(*snapshot.EVENT_COLUMNS)
    none = one.where("false")
    def result(a, b):
        r = snapshot.gate(church, a, church, b).first()
        return r["event_delta_pct"], r["weekly_match_pct"], r["passed"]
    assert result(none, none) == (0.0, 100.0, True)
    assert result(one, none) == (100.0, 0.0, False)
    assert result(one, one) == (0.0, 100.0, True)
    assert result(none, one) == (100.0, 0.0, False)


def test_failed_gate_keeps_the_published_version(spark, scratch):
    church, parish, bulletin, event = snapshot_frames(spark)
    root = scratch("snap")
    assert snapshot.refresh(church, parish, bulletin, event, root, "t1")["passed"]
    assert not snapshot.refresh(church, parish, bulletin, event.where("false"), root, "t2")["passed"]
    assert snapshot.published_versions(spark, root) == [1]
    assert snapshot.refresh(church, parish, bulletin, event, root, "t3")["version"] == 2
    assert snapshot.published_versions(spark, root) == [2, 1]
    missing = snapshot.gate_versions(spark, root, 9, 1)
    assert not missing["passed"] and "v=9" in missing["errors"][0]


def test_event_load_skips_and_quarantine(spark):
    church, _, bulletin, _ = snapshot_frames(spark)
    row = lambda **k: {**dict(church_slug="c", bulletin_source_url="url", event_type="mass", event_kind="weekly", day_of_week="Sunday", date="x",
                              start_time="8 AM", end_time="??", cancelled=None, page_number=1, note=" "), **k}
    raw = [row(), row(church_slug="nope"), row(church_slug=""), row(start_time="soon"), row(event_kind="specific_date", date="soon"),
           row(start_time="13:00 PM"), row(event_kind="specific_date", date="4/5/26", bulletin_source_url="other")]
    df = spark.createDataFrame([{**r, "idx": i} for i, r in enumerate(raw)], "idx bigint, " + schemas.RAW_EVENT)
    good, bad = load.load_events(df, church, bulletin)
    rows = {r["id"]: r for r in good.collect()}
    assert sorted(rows) == [0, 6] and rows[0]["end_time"] is None and rows[0]["date"] is None and rows[0]["note"] is None
    assert rows[0]["bulletin_id"] == 1 and rows[6]["bulletin_id"] is None and rows[6]["date"] == "2026-04-05"
    assert {r["idx"]: r["reason"] for r in bad.collect()} == {
        1: "unknown church", 2: "no church slug", 3: "unreadable start_time", 4: "unreadable date", 5: "start_time out of range"}
    with pytest.raises(Exception, match="start_time out of range"):
        load.load_events(df, church, bulletin, strict=True)[0].collect()


def test_range_rules(spark):
    df = spark.createDataFrame([(0, None, 0), (1439, 1439, 1), (1440, None, 0), (5, 2000, 0), (None, None, 0), (5, None, 2)], "s int, e int, c int")
    got = [r["p"] for r in df.select(quality.range_problem(F.col("s"), F.col("e"), F.col("c")).alias("p")).collect()]
    assert got == [None, None, "start_time out of range", "end_time out of range", "start_time missing", "cancelled not 0/1"]


def test_csv_round_trip_and_header(spark, scratch):
    path = scratch("roster") + "/parishes.csv"
    rows = spark.createDataFrame([('a', 'St. "X", the', "https://a", " ", None), ("b", "Ünïcode", "https://b", "other", "7")],
                                 ", ".join(f"{c} string" for c in schemas.PARISH_CSV))
    sinks.write_csv(rows, path, schemas.PARISH_CSV)
    back = {r["slug"]: r for r in files.parish_csv(spark, path).collect()}
    assert back["a"]["name"] == 'St. "X", the' and back["a"]["bulletin_provider"] is None and back["b"]["provider_id"] == "7"
    with pytest.raises(ValueError, match=r"missing required columns: \['city', 'line1', 'parish_id', 'postal_code', 'state'\]"):
        files.church_csv(spark, path)
    assert files.parish_csv(spark, path + ".absent").count() == 0
    with pytest.raises(ValueError, match="no header row"):
        files.check_header([], ["slug"], "x.csv")


def test_json_sources(spark, scratch):
    path = scratch("list")
    spark.createDataFrame([('[{"church_slug":"a","note":"ü"},{"church_slug":"b"}]',)], "value string").coalesce(1).write.text(path)
    rows = files.json_list(spark, path, schemas.RAW_EVENT).orderBy("idx").collect()
    assert [(r["church_slug"], r["note"]) for r in rows] == [("a", "ü"), ("b", None)]
    assert files.json_list(spark, path + "-absent", schemas.RAW_EVENT).count() == 0
    path = scratch("dict")
    spark.createDataFrame([('{"s1":{"x":"1"},"s2":{"x":"2"}}',)], "value string").coalesce(1).write.text(path)
    assert [(r["slug"], r["value"]["x"]) for r in files.json_dict(spark, path, "struct<x:string>").orderBy("idx").collect()] == [("s1", "1"), ("s2", "2")]
    path = scratch("dict") + "/results.jsonl"
    spark.createDataFrame([('{"s1":{"x":"1"},"s2":{"x":"2"}}',), ("broken",), ('{"s3":{"x":"3"}}',)], "value string").repartition(3).write.text(path)
    many = files.json_dict(spark, path, "struct<x:string>").collect()
    assert sorted(r["slug"] for r in many) == ["s1", "s2", "s3"] and len({r["idx"] for r in many}) == 3
    path = scratch("list") + "/events.jsonl"
    spark.createDataFrame([('{"church_slug":"a"}',), ('{"church_slug":"b"}',)], "value string").coalesce(1).write.text(path)
    assert [r["church_slug"] for r in files.json_list(spark, path, schemas.RAW_EVENT).orderBy("idx").collect()] == ["a", "b"]
    path = scratch("out")
    sinks.write_json(spark.createDataFrame([("a", None)], "k string, v string"), path)
    assert spark.read.text(path).first()["value"] == '{"k":"a","v":null}'


def test_verified_parishes_need_churches(spark):
    parish = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, slug string")
    church = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 0)], "parish_id bigint, name_verified int, address_verified int")
    assert [r["slug"] for r in verify.verified_parishes(parish, church).collect()] == ["a"]


ROSTER = "idx bigint, " + ", ".join(f"{c} string" for c in schemas.CHURCH_CSV)


def test_verdicts_are_applied_in_document_order(spark):
    roster = spark.createDataFrame([(0, "p", "a", "Old", "1 A", "", "T", "NY", "1", "", "", "", "")], ROSTER)
    addr = lambda line1: (line1, None, None, None, None)
    v = lambda slug, ns, as_, name=None, address=None: (slug, ns, as_, name, address, False)
    docs = [
        (0, "p", ([v("a", "incorrect", "incorrect", "Better", addr("2 B")), v("n", "verified", "verified")], [("New", "n", None), ("Twin", "a", None), ("NoSlug", None, None)])),
        (1, "q", ([v("a", "verified", "unverifiable"), v("n", "incorrect", "verified", "Newer")], [("Late", "n", None)])),
    ]
    results = spark.createDataFrame(docs, f"idx bigint, slug string, value {schemas.VERIFICATION}")
    out = merge.apply_verify(roster, results)
    rows = {r["slug"]: r for r in out.collect()}
    a, n = rows["a"], rows["n"]
    assert (a["name"], a["line1"], a["city"], a["name_verified"], a["address_verified"], a["corrected"]) == ("Better", "2 B", "", "true", "false", True)
    assert (n["name"], n["parish_id"], n["name_verified"], n["address_verified"], n["added"]) == ("Newer", "p", "true", "true", True)
    assert merge.verify_counters(out).first().asDict() == {"corrections_applied": 2, "new_churches_added": 1}


def test_repeated_roster_slug_is_corrected_in_its_last_row(spark):
    row = lambda i, name: (i, "p", "a", name, "", "", "", "", "", "", "", "", "")
    roster = spark.createDataFrame([row(0, "One"), row(1, "Two")], ROSTER)
    value = ([("a", "incorrect", "verified", "Better", None, False)], [])
    results = spark.createDataFrame([(0, "p", value)], f"idx bigint, slug string, value {schemas.VERIFICATION}")
    got = {r["idx"]: (r["name"], r["name_verified"]) for r in merge.apply_verify(roster, results).collect()}
    assert got == {0: ("One", ""), 1: ("Better", "true")}


def test_geocode_last_usable_result_wins(spark):
    cols = "line1 string, line2 string, city string, state string, postal_code string"
    roster = spark.createDataFrame([(1, "1 A", None, "T", None, None, None, None), (2, "1 A", "", "T", "", "", None, None), (3, "9", "", "", "", "", 5.0, 6.0)],
                                   f"id int, {cols}, latitude double, longitude double")
    results = spark.createDataFrame([(0, "1 A", "", "T", "", "", 1.0, 1.0), (1, "1 A", "", "T", "", "", 2.0, 2.0), (2, "1 A", "", "T", "", "", 99.0, 2.0)], schemas.GEOCODE)
    got = {r["id"]: (r["latitude"], r["updated"]) for r in merge.apply_geocode(roster, results).collect()}
    assert got == {1: (2.0, True), 2: (2.0, True), 3: (5.0, False)}


def test_detect_results_replace_with_empty_text(spark):
    roster = spark.createDataFrame([("a", "other", "1"), ("b", None, None)], "slug string, bulletin_provider string, provider_id string")
    results = spark.createDataFrame([("a", "ecatholic", None)], "slug string, bulletin_provider string, provider_id string")
    got = {r["slug"]: tuple(r)[1:] for r in merge.apply_detect(roster, results).select("slug", "bulletin_provider", "provider_id", "updated").collect()}
    assert got == {"a": ("ecatholic", "", True), "b": ("", "", False)}


def test_refreshed_snapshot_holds_the_whole_event_table(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    want = snapshot.snapshot_event(d.event, d.bulletin).groupBy("event_type").count().collect()
    got = QUERIES["str_snapshot_refresh"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["count"] for r in want) > 0
    assert Counter(r.event_type for r in got) == {r.event_type: r["count"] for r in want}
