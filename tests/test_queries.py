import itertools
import json
import math
import os
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from belfry.operators import agreement, filters, search
from belfry.plans import compare, extract_run, extractors, links, process, serve
from belfry.schemas import CHURCH, METADATA, RAW_EVENT, RESULT
from belfry.streaming import ingest

URL = "bulletin_source_url"
EV = "classifier string, idx bigint, bulletin_source_url string, church_slug string, event_type string, event_kind string, " \
     "day_of_week string, date string, start_time string, end_time string, cancelled boolean, page_number int, note string"


def ev(run, idx, url, start, page=1, day="Sunday"):
    return (run, idx, url, "c", "mass", "weekly", day, None, start, None, None, page, None)


def runs(spark, rows, listed=()):
    manifest = spark.createDataFrame(list(listed) or [("-", "-")], "classifier string, bulletin_source_url string")
    return spark.createDataFrame(rows, EV), manifest


def metrics(spark, rows, listed=(), names=("a", "b")):
    events, manifest = runs(spark, rows, listed)
    return agreement.pair_metrics(agreement.pair_counts(agreement.url_counts(events, manifest, list(names)), list(names)))


def test_agreement(spark):
    same = [ev(r, i, "u", t) for r in "ab" for i, t in enumerate(("8", "9"))]
    m = metrics(spark, same).first()
    assert (m["micro_jaccard"], m["mean_jaccard"], m["median_jaccard"]) == (1.0, 1.0, 1.0)
    half = [ev("a", 0, "u", "8"), ev("a", 1, "u", "9"), ev("a", 2, "u", "10"), ev("b", 0, "u", "8"), ev("b", 1, "u", "9"), ev("b", 2, "u", "11")]
    assert metrics(spark, half).first()["micro_jaccard"] == 0.5


def test_identity_ignores_page_and_repeats_and_matches_nulls(spark):
    rows = [ev("a", 0, "u", "8", 1, None), ev("a", 1, "u", "8", 2, None), ev("b", 0, "u", "8", 9, None)]
    m = metrics(spark, rows).first()
    assert (m["events_total_a"], m["events_in_both"], m["events_in_union"]) == (1, 1, 1)
    first = agreement.first_by_key(runs(spark, rows)[0]).where("classifier = 'a'").first()
    assert first["ev"]["page_number"] == 1 and first["ev"]["cancelled"] is False


def test_empty_and_one_sided_documents(spark):
    listed = [("a", "both"), ("b", "both"), ("a", "x"), ("b", "x"), ("a", "only")]
    rows = [ev("b", 0, "x", "8")]
    m = metrics(spark, rows, listed).first()
    assert (m["bulletins_in_both"], m["bulletins_only_in_a"], m["one_sided_zero"], m["micro_jaccard"], m["mean_jaccard"]) == (2, 1, 1, 0.0, 0.5)
    none = metrics(spark, [ev("c", 0, "z", "8")], [("a", "u"), ("b", "u")]).first()
    assert none["micro_jaccard"] is None and none["mean_jaccard"] == 1.0


def test_agreement_is_symmetric(spark):
    rng = random.Random(3)
    rows = [ev(r, i, f"u{rng.randrange(4)}", str(rng.randrange(6))) for r in "ab" for i in range(30)]
    ab, ba = metrics(spark, rows).first(), metrics(spark, rows, names=("b", "a")).first()
    assert (ab["micro_jaccard"], ab["mean_jaccard"], ab["median_jaccard"]) == (ba["micro_jaccard"], ba["mean_jaccard"], ba["median_jaccard"])
    with pytest.raises(ValueError, match="at least two"):
        agreement.pairs_of(["a"])


def test_counts_and_events_are_made_once(spark):
    """Totals and medians come from kept counts; event rows travel once before they are grouped."""
    events, manifest = runs(spark, [ev(r, i, f"u{i % 4}", str(i % 3)) for r in "ab" for i in range(30)])
    counts = agreement.url_counts(events, manifest, ["a", "b"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert URL not in plan(agreement.pair_metrics(agreement.pair_counts(counts, ["a", "b"])))
    assert URL not in plan(agreement.run_stats(counts, ["a", "b"]))
    for df in (agreement.event_rows(events, ["a", "b"]), agreement.first_by_key(events), agreement.key_cells(events, ["a", "b"])):
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange") == 1 and "Aggregate" not in physical[physical.index("Exchange"):]


def test_report_levels_are_made_once(spark, scratch, monkeypatch):
    kept = []
    monkeypatch.setattr(compare, "written", lambda df, name, write=compare.written: kept.append(name) or write(df, name))
    events, manifest = runs(spark, [ev("a", 0, "u", "8"), ev("b", 0, "u", "8")])
    report = compare.compare(events, manifest, spark.createDataFrame([], METADATA), ["a", "b"])
    compare.write_report(report, ["a", "b"], scratch("report"), "now")
    assert {"report-events", "report-per_bulletin"} <= set(kept)


def test_first_event_keeps_missing_parts(spark):
    rows = [(*ev("a", i, "u", start)[:-1], note) for i, start, note in ((2, "8", "late"), (1, None, "early"), (3, "", "empty"))]
    first = {r["key"]["start_time"]: r["ev"] for r in agreement.first_by_key(runs(spark, rows)[0]).collect()}
    assert (first[""]["start_time"], first[""]["note"], first["8"]["note"]) == (None, "early", "late") and len(first) == 2


def test_markdown_report(spark):
    events, manifest = runs(spark, [ev("a", 0, "u", "8"), ev("b", 0, "u", "8"), ev("b", 1, "u", "9")])
    meta = spark.createDataFrame([(0, "p", "u", "/f.pdf", None, None, None, "2026-01-04")], METADATA)
    lines = [r["line"] for r in compare.markdown(compare.compare(events, manifest, meta, ["a", "b"]), ["a", "b"]).orderBy(*compare.LINE_KEY).collect()]
    assert lines[0] == "# Classifier Compare" and "| a | b | 1 | 1 | 2 | 0.5 | 0.5 | 0 |" in lines
    assert lines[lines.index("### a vs b") + 1:] == [
        "", "#### p - 2026-01-04", "- Source URL: u", "- Source PDF: `/f.pdf`", "- Counts: same 1, only a 0, only b 1, Jaccard 0.5",
        "", "**Same**", "- c | mass weekly | Sunday | 8 | page 1", "", "**Only a**", "- None", "", "**Only b**", "- c | mass weekly | Sunday | 9 | page 1"]


FIELDS = ["church_slug", "event_type", "event_kind", "day_of_week", "date", "start_time", "end_time", "cancelled", "page_number", "note"]


def nested_report(rows, listed, meta, names):
    """The report as plain dictionaries, run by run and document by document."""
    run = {n: {u: [] for m, u in listed if m == n} for n in names}
    for r in rows:
        run[r[0]].setdefault(r[2], []).append(dict(zip(FIELDS, (*r[3:10], bool(r[10]), *r[11:]))))
    key = lambda e: tuple("" if e[f] is None and f in ("church_slug", "event_type", "event_kind", "start_time") else e[f] for f in FIELDS[:8])
    text = lambda k: ["" if x is None else str(x).lower() if isinstance(x, bool) else x for x in k]
    by_key = {n: {u: {k: next(e for e in es if key(e) == k) for k in dict.fromkeys(map(key, es))} for u, es in run[n].items()} for n in names}
    stats = []
    for n in names:
        sizes = [len(x) for x in by_key[n].values()]
        stats.append({"classifier": n, "version": None, "bulletins": len(sizes), "events_total": sum(sizes), "events_per_bulletin_mean": round(statistics.fmean(sizes), 2),
                      "events_per_bulletin_median": statistics.median(sizes), "events_per_bulletin_max": max(sizes), "cache_hits": None,
                      "cache_misses": None, "wall_seconds": None, "errors": 0})
    pairs = []
    for a, b in itertools.combinations(names, 2):
        x, y = by_key[a], by_key[b]
        both = sorted(set(x) & set(y))
        same, union = [len(set(x[u]) & set(y[u])) for u in both], [len(set(x[u]) | set(y[u])) for u in both]
        ratios = [s / n if n else 1.0 for s, n in zip(same, union)]
        docs = []
        for u in set(x) | set(y):
            p, q = x.get(u, {}), y.get(u, {})
            common, only_a, only_b = (sorted(ks, key=text) for ks in (set(p) & set(q), set(p) - set(q), set(q) - set(p)))
            total = len(set(p) | set(q))
            path, slug, day = meta.get(u, (None, None, None))
            docs.append({URL: u, "pdf_path": path, "parish_slug": slug, "published_date": day, f"{a}_event_count": len(p), f"{b}_event_count": len(q),
                         "same_count": len(common), f"only_in_{a}_count": len(only_a), f"only_in_{b}_count": len(only_b), "jaccard": round(len(common) / total if total else 1.0, 4),
                         "same": [{a: p[k], b: q[k]} for k in common], f"only_in_{a}": [p[k] for k in only_a], f"only_in_{b}": [q[k] for k in only_b]})
        pairs.append({"classifier_a": a, "classifier_b": b, "bulletins_in_both": len(both), "bulletins_only_in_a": len(set(x) - set(y)),
                      "bulletins_only_in_b": len(set(y) - set(x)), f"events_total_{a}": sum(len(x[u]) for u in both), f"events_total_{b}": sum(len(y[u]) for u in both),
                      "events_in_both": sum(same), "events_in_union": sum(union), "micro_jaccard": round(sum(same) / sum(union), 4) if sum(union) else None,
                      "mean_jaccard": round(statistics.fmean(ratios), 4) if ratios else None, "median_jaccard": round(statistics.median(ratios), 4) if ratios else None,
                      "one_sided_zero_event_bulletins": [{URL: u, f"{a}_event_count": len(x[u]), f"{b}_event_count": len(y[u])} for u in both if (not x[u]) != (not y[u])],
                      "per_bulletin": sorted(docs, key=lambda d: (d["parish_slug"] or "", d["published_date"] or "", d[URL]))})
    return {"generated_at": "now", "classifiers": names, "per_classifier": stats, "pairwise": pairs}


def test_nested_report(spark, scratch):
    rng = random.Random(3)
    rows = [ev(rng.choice(['a', 'b "x"', "c"]), i, f"u{rng.randrange(6)}", rng.choice(["8", "9 é", "10"]), i, rng.choice(["Sunday", None])) for i in range(60)]
    rows += [ev("a", 90, "u9", "8", 1, ""), ev("a", 91, "u9", "8", 2, None), ev("c", 92, "u9", "8", 3, "")]
    listed = [("a", "u7"), ('b "x"', "u7"), ("c", "u8"), ("a", "u1"), ('b "x"', "u9")]
    names = ["a", 'b "x"', "c"]
    meta = [(0, "p", "u1", "/1", None, None, None, "2026-01-04"), (1, "p", "u2", None, None, None, None, "2026-01-02"), (2, "o", "u7", "/7", None, None, None, None)]
    known = {m[2]: (m[3], m[1], m[7]) for m in meta}
    events, manifest = runs(spark, rows, listed)
    report = compare.compare(events, manifest, spark.createDataFrame(meta, METADATA), names)
    path = scratch("report")
    compare.write_report(report, names, path, "now")
    folder = path.removeprefix("file:") + "/report.json"
    text = "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.startswith("part"))
    assert json.loads(text) == nested_report(rows, listed, known, names)
    none = compare.compare(events.limit(0), manifest.limit(0), spark.createDataFrame(meta, METADATA), names)
    lines = [r["line"] for r in compare.json_lines(none, names, "now").orderBy(*compare.JSON_KEY).collect()]
    assert [p["per_bulletin"] for p in json.loads("".join(lines))["pairwise"]] == [[], [], []]


def test_medians(spark):
    rng = random.Random(12)
    rows = [(g, rng.choice([0.5, rng.random(), 1.0])) for g in range(5) for _ in range(g * 40 + 1)] + [(3, None)]
    got = agreement.medians(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", "m")
    want = {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in range(5)}
    assert {r["g"]: r["m"] for r in got.collect()} == pytest.approx(want, abs=1e-15)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
    assert agreement.medians(spark.createDataFrame([], "g int, v double"), ["g"], "v", "m").count() == 0


# --- serving ---------------------------------------------------------------------------------

SNAP = "id bigint, church_id bigint, event_type string, event_kind string, day_of_week string, date string, start_time int, end_time int, " \
       "cancelled int, page_number int, note string"


def snap(spark, *rows):
    return spark.createDataFrame([(i, c, t, k, d, dt, s, None, x, 1, None) for i, c, t, k, d, dt, s, x in rows], SNAP)


def test_filter_predicate(spark):
    rows = [(1, 1, "mass", "weekly", "monday", None, 480, 0), (2, 1, "mass", "weekly", None, None, 480, 0), (3, 1, "mass", "weekly", "Someday", None, 480, 0),
            (4, 1, "mass", "specific_date", None, "2026-06-08", 480, 0), (5, 1, "mass", "specific_date", None, "June", 480, 0),
            (6, 1, "mass", "specific_date", None, None, 480, 0), (7, 1, "mass", "weekly", "Monday", None, 480, 1), (8, 1, "mass", "weekly", "Monday", None, 900, 0)]
    df = snap(spark, *rows)
    ids = lambda *a: sorted(r["id"] for r in df.where(filters.event_matches(*a)).collect())
    assert ids([0], None, None) == [1, 2, 4, 6, 8] and ids([0], 480, 600) == [1, 2, 4, 6]
    assert ids([], 600, 480) == [] and ids([], 480, None) == [1, 2, 3, 4, 5, 6, 8]


def test_many_filters_equal_one_by_one(spark):
    rng = random.Random(5)
    days = ["Monday", "tuesday", "SUNDAY", "Someday", None]
    rows = [(i, rng.randrange(4), rng.choice(["mass", "confession"]), rng.choice(["weekly", "specific_date"]), rng.choice(days),
             rng.choice(["2026-06-08", "2026-06-09", None, "June"]), rng.randrange(1440), int(rng.random() < .1)) for i in range(300)]
    events = snap(spark, *rows)
    wanted = [(i, rng.choice(["mass", "confession"]), sorted(rng.sample(range(7), rng.randrange(4))), *rng.choice([(0, 1439), (480, 600), (700, 650), (59, 61)]))
              for i in range(8)]
    table = spark.createDataFrame(wanted, "filter_id int, event_type string, days array<int>, time_from int, time_to int")
    got = {(r["filter_id"], r["church_id"]): r["n_events"] for r in filters.match_filters(events, table).collect()}
    want = {}
    for i, kind, on, lo, hi in wanted:
        for r in serve.matching_events(events, [kind], on, lo, hi).groupBy("church_id").count().collect():
            want[i, r["church_id"]] = r["count"]
    assert got == want


def test_filter_urls_round_trip(spark):
    df = spark.createDataFrame([(1, "https://m/map?z=3&type=adoration&days=fri,MON, fri,xx&from=0800&to=2400"), (2, "https://m/map?type=picnic&from=9&days="), (3, "https://m/map")],
                               "filter_id int, url string")
    first = filters.decode_filters(df)
    rows = first.orderBy("filter_id").collect()
    assert (rows[0]["event_type"], rows[0]["days"], rows[0]["time_from"], rows[0]["time_to"]) == ("adoration", [0, 4], 480, 1439)
    assert (rows[1]["event_type"], rows[1]["days"], rows[1]["time_from"], rows[1]["time_to"]) == ("mass", [], 0, 1439)
    coded = first.select("filter_id", F.concat(F.lit("https://m/map?"), filters.encode_filters(F.col("url"))).alias("url"))
    assert coded.orderBy("filter_id").first()["url"] == "https://m/map?z=3&type=adoration&days=mon%2Cfri&from=0800"
    again = filters.decode_filters(coded).orderBy("filter_id").collect()
    assert [tuple(r)[2:] for r in again] == [tuple(r)[2:] for r in rows]


def test_popup_prefers_weekly_rows(spark):
    rows = [(1, 1, "mass", "weekly", "Sunday", None, 480, 0), (2, 1, "confession", "weekly", "SUNDAY", None, 480, 0), (3, 1, "mass", "weekly", "Monday", None, 420, 0),
            (4, 1, "mass", "specific_date", None, "2026-06-20", 1, 0)]
    rows += [(10 + i, 2, "mass", "specific_date", None, f"2026-06-{20 - i}", 600, 0) for i in range(7)]
    church = spark.createDataFrame([(1, 1, "a", "A"), (2, 1, "b", "B"), (3, 1, "c", "C")], "id bigint, parish_id bigint, slug string, name string")
    for c in ("address_line1", "address_line2", "city", "state", "postal_code"):
        church = church.withColumn(c, F.lit(None).cast("string"))
    church = church.withColumn("latitude", F.lit(1.0)).withColumn("longitude", F.lit(1.0))
    out = {r["slug"]: r for r in serve.map_query(church, snap(spark, *rows), F.lit("2026-06-15").cast("date")).collect()}
    assert [e["id"] for e in out["a"]["upcoming_events"]] == [1, 3] and out["a"]["event_types"] == ["confession", "mass"]
    assert [e["id"] for e in out["b"]["upcoming_events"]] == [15, 14, 13, 12, 11] and "c" not in out
    with pytest.raises(LookupError, match="Church not found: zz"):
        serve.church_detail(church, "zz")


def edit_rows(query, text):
    """Edit distances of ``query`` to every start of ``text``."""
    row = list(range(len(query) + 1))
    yield row[-1]
    for c in text:
        row = list(itertools.accumulate(zip(row, row[1:], query), lambda left, x: min(left + 1, x[1] + 1, x[0] + (x[2] != c)), initial=row[0] + 1))
        yield row[-1]


def stretch_distance(query, text):
    near = min(min(edit_rows(query, text[p:])) / len(query) + p / 100 for p in range(len(text)))
    return near if near <= 0.4 else None


def test_bit_parallel_matcher():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    pairs = [(word(rng.randrange(1, 14)), word(rng.randrange(1, 70))) for _ in range(1500)]
    pairs += [(q, t[:p] + "".join(c for c in q if rng.random() > 0.1) + t[p:]) for q, t, p in ((word(n), word(30), rng.randrange(30)) for n in (9, 20, 62, 63, 64, 65, 90) for _ in range(20))]
    got = search.match_distances([q for q, _ in pairs], [t for _, t in pairs])
    want = [stretch_distance(q, t) for q, t in pairs]
    assert [None if math.isnan(g) else g for g in got] == want and sum(w is not None for w in want) > 300


def test_rarest_grams_do_not_overlap():
    rng = random.Random(6)
    for _ in range(200):
        size, counts = rng.choice([1, 2]), [rng.randrange(9) for _ in range(rng.randrange(1, 10))]
        need = rng.randrange(1, (len(counts) + size - 1) // size + 1)
        sets = [c for c in itertools.combinations(range(len(counts)), need) if all(b - a >= size for a, b in zip(c, c[1:]))]
        got = search.rarest_apart(counts, size, need)
        assert tuple(got) in sets and sum(counts[i] for i in got) == min(sum(counts[i] for i in c) for c in sets)


def test_search_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["saint", "mary", "anne", "joseph", "lake", "north", "holy", "cross"]
    churches = [(i, 1, f"s{i}", " ".join(rng.sample(words, 2)), f"{i % 9} {rng.choice(words)} st", None, rng.choice(words), "ny", f"148{i % 50:02d}",
                 None if i % 10 == 0 else 1.0, 1.0, 1, 1, None) for i in range(120)]
    asked = [(0, "saint mary"), (1, "sait mary"), (2, "ny"), (3, "14812"), (4, "x"), (5, "qqqq"), (6, "lake st"), (7, "Josephh")]
    asked += [(8, "Mxry"), (9, " marry "), (10, "saint anne"), (11, "north"), (12, "norht"), (13, "anx"), (14, "crossnorth saint mary lake josephine anne holy cross north lake saint")]
    fields = dict(zip(search.WEIGHTS, (3, 6, 7, 8, 4, 5)))
    want = set()
    for qid, q in asked:
        q, scored = q.strip().lower(), []
        for c in churches:
            if c[9] is None or len(q) < 2:
                continue
            total, hit = 0.0, False
            for f, w in search.WEIGHTS.items():
                text = (c[fields[f]] or "").lower()
                near = stretch_distance(q, text) if text else None
                if near is not None:
                    near = 2.0 ** -52 if text == q else max(near, 0.001)
                    total, hit = total - math.log(near) * w * round(len(text.split()) ** -0.5, 3), True
            if hit:
                scored.append((-round(total, 9), c[0]))
        want |= {(qid, n + 1, cid) for n, (_, cid) in enumerate(sorted(scored)[:10])}
    assert {q for q, _, _ in want} >= {0, 1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13} and not {q for q, _, _ in want} & {4, 5}
    found = search.search(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(churches, CHURCH))
    assert {(r["query_id"], r["rank"], r["church_id"]) for r in found.collect()} == want


# --- links -----------------------------------------------------------------------------------

def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id int, url string, html string")


def test_navigation_and_posts(spark):
    html = ('<a href="/bulletin.pdf">bulletin</a><a href="/x">Bulletin board</a><a href="/bulletins">Bulletins</a>')
    assert links.navigation_link(pages(spark, (1, "https://h.org/", html))).first()["target"] == "https://h.org/bulletins"
    posts = ('<a href="/bulletin/">bulletin march 9</a><a href="/p1">Bulletin March 1</a><a href="/p8">Bulletin March 8</a><a href="/p8b">Bulletin March 8</a>')
    found = links.latest_post(pages(spark, (1, "https://h.org/bulletin", posts)), F.lit("2026-03-10").cast("date")).first()
    assert found["target"] == "https://h.org/p8"


def test_candidate_choice(spark):
    ref = F.lit("2026-03-10").cast("date")
    best = lambda html: links.best_candidate(links.pdf_candidates(pages(spark, (1, "https://h.org/b", html)), ref), ref).first()["source_url"]
    assert best('<a href="a.pdf">Feb 1</a><a href="b.pdf">March 8</a><a href="c.pdf">March 15</a><a href="d.pdf">March 22</a>') == "https://h.org/c.pdf"
    assert best('<a href="a.pdf">first</a><a href="b.pdf">Jan 1</a>') == "https://h.org/a.pdf"
    assert best(r'<a href="/x">x</a><script>"https:\/\/h.org\/2026-03-08.pdf"</script>') == "https://h.org/2026-03-08.pdf"


# --- extraction stages -----------------------------------------------------------------------

class Stub:
    name, version = "stub", "v1"

    def extract(self, content, *, churches, today):
        if content == b"bad":
            raise RuntimeError("no")
        return {"events": [{"church_slug": churches[0]["slug"], "type": "mass", "kind": "weekly", "day_of_week": "Sunday", "start_time": content.decode()}],
                "published_date": "2026-01-01", "wrong_bulletin": content == b"wrong"}


def corpus(spark):
    meta = spark.createDataFrame([(0, "p", "u0", "/0", "h0", "2026-01-01", "done", "2025-12-01"), (1, "p", "u1", "/1", "h1", "2026-02-01", None, None),
                                  (2, "q", "u2", "/2", "h2", "2026-01-01", None, None), (3, "r", "u3", "/gone", "h3", "2026-01-01", None, None),
                                  (4, "s", "u4", "/4", None, "2026-01-01", None, None)],
                                 METADATA.replace("content_hash string, fetched_at string, processed_at string, published_date string",
                                                  "content_hash string, fetched_at string, processed_at string, published_date string"))
    parish = spark.createDataFrame([(i, s, s.upper()) for i, s in enumerate("pqrs")], "id bigint, slug string, name string")
    church = spark.createDataFrame([(i, i, f"c-{s}", "C", None, None, None, None, None, None, None, 1, 1, None) for i, s in enumerate("pqrs")], CHURCH)
    docs = spark.createDataFrame([("/1", b"8 AM"), ("/2", b"bad"), ("/4", b"wrong")], "path string, content binary")
    cache = spark.createDataFrame([], f"classifier string, version string, content_hash string, result {RESULT}")
    events = spark.createDataFrame([("c-p", "u0", "mass", "weekly", "Sunday", None, "7", None, False, 1, None)], RAW_EVENT)
    return meta, events, parish, church, docs, cache


def test_process_twice(spark):
    meta, events, parish, church, docs, cache = corpus(spark)
    run = lambda m, e, c: process.process_bulletins(m, e, parish, church, docs, c, Stub(), now="now", today=date(2026, 2, 2))
    one = run(meta, events, cache)
    assert {r["idx"]: r["status"] for r in one.outcomes.collect()} == {1: "extracted", 2: "error", 3: "skipped", 4: "extracted"}
    assert [(r["bulletin_source_url"], r["start_time"]) for r in one.events.collect()] == [("u1", "8 AM")]
    after = {r["idx"]: (r["processed_at"], r["published_date"]) for r in one.metadata.collect()}
    assert after[1] == ("now", "2026-01-01") and after[4] == ("now", "2026-01-01") and after[2] == (None, None)
    assert one.summary.first().asDict() == {"processed_bulletins": 2, "inserted_events": 1, "cache_hits": 0}
    assert [r["content_hash"] for r in one.new_results.collect()] == ["h1"]
    two = run(one.metadata, one.events, one.new_results)
    assert {r["idx"] for r in two.outcomes.collect()} == {2, 3} and two.events.count() == 1
    reset = run(meta, events, one.new_results)
    assert reset.summary.first()["cache_hits"] == 1 and [r["bulletin_source_url"] for r in reset.events.collect()] == ["u1"]


def test_extract_run_counts(spark, scratch):
    from belfry.sources.runs import read_runs
    meta, _, parish, church, docs, cache = corpus(spark)
    run = extract_run.extract_run(meta, parish, church, docs, cache, Stub(), today=date(2026, 2, 2))
    s = run.summary.first()
    assert (s["bulletins_total"], s["bulletins_served"], s["cache_misses"], s["skipped"], s["errors"], s["events_written"]) == (4, 1, 1, 2, 1, 1)
    assert run.errors.first()["source_url"] == "u2"
    empty = extract_run.extract_run(meta, parish, church, docs, cache, Stub(), today=date(2026, 2, 2), parish_name="nobody")
    assert empty.summary.first()["bulletins_total"] == 0
    root = scratch("run")
    extract_run.write_run(run, root, "stub", "now", 1.0)
    extract_run.write_run(empty, root, "stub", "now", 1.0)
    assert read_runs(spark, root, ["stub"])[0].count() == 0
    with pytest.raises(FileNotFoundError):
        read_runs(spark, root, ["stub", "absent"])


def test_extractor_registry():
    extractors.register("stub", Stub)
    assert extractors.get_extractor("stub").version == "v1"
    with pytest.raises(KeyError, match="Available: .*stub"):
        extractors.get_extractor("absent")


def test_streamed_winner_equals_batch_in_any_arrival_order(spark, scratch):
    from belfry.operators import latest
    rows = [(i, f"p{i % 3}", f"u{i}", f"2026-01-{(i * 7) % 28 + 1:02d}", "f", None if i % 5 == 0 else "x") for i in range(30)]
    schema = "idx bigint, parish_slug string, source_url string, published_date string, fetched_at string, processed_at string"
    batch = spark.createDataFrame(rows, schema)
    want = {(r["parish_slug"], r["idx"]) for r in latest.to_show(batch, ["idx"]).collect()}
    for seed, order in itertools.islice(enumerate(itertools.permutations(range(3))), 2):
        src, root = scratch("in"), scratch("out")
        for part in order:
            spark.createDataFrame([r for r in rows if r[0] % 3 == part or False], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = ingest.start(stream, ingest.winner_upsert(root), scratch("state"))
        q.awaitTermination()
        got = ingest.current_winners(spark, root)
        assert {(r["parish_slug"], r["idx"]) for r in got.collect()} == want
