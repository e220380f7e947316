"""Run-comparison checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from belfry.operators import agreement
from belfry.plans import compare
from belfry.session import scratch_path, shuffles_freed
from belfry.sources import sinks
from belfry.sources.runs import metadata_documents, read_run_documents
from catalog.registry import define, query

NAMES = ["alpha", "beta"]
URL = "bulletin_source_url"
_ID = "church_slug, event_type, event_kind, day_of_week, date, start_time, end_time, cancelled"

define("key_flag", f"""select bulletin_source_url, {_ID}, max((classifier = 'alpha')::int) as in_a, max((classifier = 'beta')::int) as in_b
    from run_event group by bulletin_source_url, {_ID}""")
define("known_url", """select bulletin_source_url, max((classifier = 'alpha')::int) as has_a, max((classifier = 'beta')::int) as has_b
    from (select classifier, bulletin_source_url from run_manifest union all select classifier, bulletin_source_url from run_event) group by 1""")
define("url_count", """select u.bulletin_source_url, has_a = 1 as in_a, has_b = 1 as in_b, coalesce(a_count, 0) as a_count, coalesce(b_count, 0) as b_count,
    coalesce(same_count, 0) as same_count, coalesce(a_count + b_count - same_count, 0) as union_count from known_url u left join
    (select bulletin_source_url, sum(in_a) as a_count, sum(in_b) as b_count, sum(in_a * in_b) as same_count from key_flag group by 1) k using (bulletin_source_url)""")
define("pair_row", "select *, case when union_count = 0 then 1.0::double else same_count / union_count::double end as jaccard from url_count")
define("both_row", "select * from pair_row where in_a and in_b")


def pairs(d):
    return agreement.pair_counts(agreement.url_counts(d.run_event, d.run_manifest, NAMES), NAMES)


def metrics(d):
    return agreement.pair_metrics(pairs(d))


@query("agg_distinct_keys", f"select classifier, bulletin_source_url, count(*) as n from (select distinct classifier, bulletin_source_url, {_ID} from run_event) group by all")
def _(d):
    keys = agreement.with_key(d.run_event).select("classifier", URL, "key").distinct()
    return keys.groupBy("classifier", URL).agg(F.count(F.lit(1)).alias("n"))


@query("agg_first_by_key", f"""select classifier, bulletin_source_url, church_slug, start_time, page_number, note from (select *, row_number() over
    (partition by classifier, bulletin_source_url, {_ID} order by idx) as rn from run_event) where rn = 1""")
def _(d):
    return agreement.first_by_key(d.run_event).select("classifier", URL, "ev.church_slug", "ev.start_time", "ev.page_number", "ev.note")


@query("join_runs_full", "select bulletin_source_url, in_a, in_b from url_count")
def _(d):
    return pairs(d).select(URL, "in_a", "in_b")


@query("join_keys_null_safe", f"select bulletin_source_url, {_ID}, in_a, in_b from key_flag")
def _(d):
    cells = agreement.key_cells(d.run_event, NAMES)
    return cells.select(URL, "key.*", F.col("in_0").alias("in_a"), F.col("in_1").alias("in_b"))


@query("join_report_metadata", "select p.bulletin_source_url, m.pdf_path, m.parish_slug, m.published_date from pair_row p left join metadata m on m.source_url = p.bulletin_source_url")
def _(d):
    return agreement.bulletin_details(pairs(d), agreement.run_metadata(d.metadata)).select(URL, "pdf_path", "parish_slug", "published_date")


THREE = ["alpha", "beta", "gamma"]
define("three_run", """select classifier, bulletin_source_url from run_manifest union all select classifier, bulletin_source_url from run_event union all
    select 'gamma', bulletin_source_url from run_manifest where classifier = 'alpha' and length(bulletin_source_url) % 2 = 0""")


@query("join_classifier_pairs", """select a.classifier as a, b.classifier as b, count(*) as shared from (select distinct * from three_run) a join (select distinct * from three_run) b
    using (bulletin_source_url) where a.classifier < b.classifier group by all""")
def _(d):
    gamma = d.run_manifest.where((F.col("classifier") == "alpha") & (F.length(URL) % 2 == 0)).withColumn("classifier", F.lit("gamma"))
    counts = agreement.url_counts(d.run_event, d.run_manifest.unionByName(gamma), THREE)
    return agreement.pair_metrics(agreement.pair_counts(counts, THREE)).select("a", "b", F.col("bulletins_in_both").alias("shared"))


@query("agg_micro_jaccard", "select round(sum(same_count) / sum(union_count)::double, 9) as micro from both_row")
def _(d):
    return metrics(d).select(F.round("micro_jaccard", 9).alias("micro"))


@query("agg_mean_jaccard", "select round(avg(jaccard), 9) as mean from both_row")
def _(d):
    return metrics(d).select(F.round("mean_jaccard", 9).alias("mean"))


@query("agg_median_jaccard", "select round(median(jaccard), 9) as median from both_row")
def _(d):
    return metrics(d).select(F.round("median_jaccard", 9).alias("median"))


_TOTALS = """select 'alpha' as a, 'beta' as b, count_if(in_a and in_b) as bulletins_in_both, count_if(not in_b) as bulletins_only_in_a, count_if(not in_a) as bulletins_only_in_b,
    sum(a_count) filter (in_a and in_b) as events_total_a, sum(b_count) filter (in_a and in_b) as events_total_b,
    sum(same_count) filter (in_a and in_b) as events_in_both, sum(union_count) filter (in_a and in_b) as events_in_union,
    count_if(in_a and in_b and (a_count = 0) <> (b_count = 0)) as one_sided_zero from pair_row"""
_TOTAL_COLS = ["a", "b", "bulletins_in_both", "bulletins_only_in_a", "bulletins_only_in_b", "events_total_a", "events_total_b",
               "events_in_both", "events_in_union", "one_sided_zero"]


@query("agg_pair_totals", _TOTALS)
def _(d):
    return metrics(d).select(*_TOTAL_COLS)


@query("agg_one_sided_zero", "select bulletin_source_url, a_count, b_count from both_row where (a_count = 0) <> (b_count = 0)")
def _(d):
    return agreement.one_sided_zero(pairs(d)).select(URL, "a_count", "b_count")


_DETAIL = """select p.bulletin_source_url, m.parish_slug, m.published_date, a_count, b_count, same_count, a_count - same_count as only_a_count,
    b_count - same_count as only_b_count, round(jaccard, 4) as jaccard from pair_row p left join metadata m on m.source_url = p.bulletin_source_url"""


def details(d):
    return compare.rounded(agreement.bulletin_details(pairs(d), agreement.run_metadata(d.metadata))).select(
        URL, "parish_slug", "published_date", "a_count", "b_count", "same_count", "only_a_count", "only_b_count", "jaccard")


@query("agg_bulletin_detail", _DETAIL)
def _(d):
    return details(d)


@query("srt_report_rows", f"{_DETAIL} order by coalesce(m.parish_slug, ''), coalesce(m.published_date, ''), p.bulletin_source_url")
def _(d):
    return details(d).orderBy(F.coalesce("parish_slug", F.lit("")), F.coalesce("published_date", F.lit("")), URL)


@query("srt_event_keys", f"""select bulletin_source_url, case when in_a + in_b = 2 then 'same' when in_a = 1 then 'only_a' else 'only_b' end as bucket,
    concat_ws(chr(1), church_slug, event_type, event_kind, coalesce(day_of_week, ''), coalesce(date, ''), start_time, coalesce(end_time, ''), cancelled::varchar) as sort_text from key_flag""")
def _(d):
    rows = agreement.event_rows(d.run_event, NAMES).orderBy(URL, "bucket", *agreement.sort_parts())
    return rows.select(URL, "bucket", F.concat_ws("\u0001", *agreement.sort_parts()).alias("sort_text"))


@query("prj_report_event", "select idx, church_slug, event_type, event_kind, day_of_week, date, start_time, end_time, coalesce(cancelled, false) as cancelled, page_number, note from raw_event")
def _(d):
    return d.raw_event.select("idx", agreement.report_event().alias("e")).select("idx", "e.*")


define("run_size", """select classifier, u.bulletin_source_url, coalesce(n, 0) as n from (select distinct classifier, bulletin_source_url from run_manifest union select classifier, bulletin_source_url from run_event) u
    left join (select classifier, bulletin_source_url, count(*) as n from (select distinct classifier, bulletin_source_url, """ + _ID + """ from run_event) group by all) k using (classifier, bulletin_source_url)""")


@query("agg_classifier_stats", """select classifier, count(*) as bulletins, sum(n) as events_total, round(avg(n), 2) as events_per_bulletin_mean,
    median(n) as events_per_bulletin_median, max(n) as events_per_bulletin_max from run_size group by classifier""")
def _(d):
    stats = agreement.run_stats(agreement.url_counts(d.run_event, d.run_manifest, NAMES), NAMES)
    return stats.withColumn("events_per_bulletin_mean", F.bround("events_per_bulletin_mean", 2))


# metadata as JSON lines: an earlier entry of some URLs, wrong types, entries that are no objects, a broken line
@query("src_run_metadata", """select source_url, case when idx % 7 <> 2 then pdf_path end as pdf_path, case when idx % 5 <> 1 then parish_slug end as parish_slug,
    published_date from metadata where source_url is not null""")
def _(d):
    path = scratch_path(d.spark, "metadata") + "/entries.jsonl"
    fields = {"source_url": F.col("source_url"), "pdf_path": F.col("pdf_path"), "parish_slug": F.col("parish_slug"), "published_date": F.col("published_date")}
    line = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    line = F.when(F.expr("idx % 5 = 1"), F.regexp_replace(line, '"parish_slug":"[^"]*"', '"parish_slug":17')).otherwise(line)
    line = F.when(F.expr("idx % 7 = 2"), F.regexp_replace(line, '"pdf_path":"[^"]*"', '"pdf_path":{"at":1}')).otherwise(line)
    earlier = d.metadata.where("idx % 3 = 0").select(F.lit(0).alias("step"), "idx", F.to_json(F.struct("source_url", F.lit("1900-01-01").alias("published_date"))).alias("value"))
    odd = d.nation.select(F.lit(1).alias("step"), F.col("n_nationkey").cast("bigint").alias("idx"), F.element_at(
        F.array(*map(F.lit, ['"text"', "5", "null", '{"source_url":9}', '{"source_url":"u', "[]"])), (F.col("n_nationkey") % 6 + 1).cast("int")).alias("value"))
    rows = earlier.unionByName(odd).unionByName(d.metadata.select(F.lit(2).alias("step"), "idx", line.alias("value")))
    sinks.write_lines(rows.withColumnRenamed("value", "line"), path, ["step", "idx"])
    return agreement.run_metadata(metadata_documents(d.spark, path))


# runs as JSON documents: some manifest entries name their document by the other field, or not at all; one manifest is broken
@query("src_runs", """select classifier, bulletin_source_url, sum(events)::bigint as n_events, sum(listed)::bigint as n_listed from (
    select classifier, bulletin_source_url, 1 as events, 0 as listed from run_event union all select classifier, bulletin_source_url, 0, 1 from run_manifest
    union all select 'gamma', bulletin_source_url, 1, 0 from run_event where classifier = 'alpha') group by all""")
def _(d):
    root = scratch_path(d.spark, "run-documents")
    field = F.when(F.length(URL) % 3 == 0, F.concat(F.lit('{"bulletin_source_url":'), F.element_at(F.array(*map(F.lit, ["null", '""', "false"])), (F.crc32(URL) % 3 + 1).cast("int")),
                                                    F.lit(',"source_url":"'), F.col(URL), F.lit('"}')))
    entry = field.otherwise(F.concat(F.lit('{"source_url":7,"bulletin_source_url":"'), F.col(URL), F.lit('"}')))
    strays = d.nation.select(F.element_at(F.array(*map(F.lit, ['{"bulletin_source_url":3,"source_url":"https://no.example.org/"}', "[1]", "{}"])), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("value"))
    events, listed = d.view("run_event"), d.view("run_manifest")
    for name in NAMES:
        sinks.write_json(events.where(F.col("classifier") == name).drop("classifier"), f"{root}/{name}/events.jsonl", "gzip")
        listed.where(F.col("classifier") == name).select(entry.alias("value")).unionByName(strays).write.text(f"{root}/{name}/bulletins.jsonl")
    sinks.write_json(events.where(F.col("classifier") == "alpha").drop("classifier"), f"{root}/gamma/events.jsonl", "gzip")
    d.nation.select(F.lit('[{"bulletin_source_url":"cut').alias("value")).coalesce(1).write.text(f"{root}/gamma/bulletins.json")
    found, manifest, _ = read_run_documents(d.spark, root, [*NAMES, "gamma"])
    one = lambda df, e, m: df.select("classifier", URL, F.lit(e).alias("e"), F.lit(m).alias("m"))
    return one(found, 1, 0).unionByName(one(manifest, 0, 1)).groupBy("classifier", URL).agg(F.sum("e").alias("n_events"), F.sum("m").alias("n_listed"))


def stored_runs(d):
    """Both runs on storage, partitioned by classifier; returns the directory."""
    root = scratch_path(d.spark, "runs")
    d.run_event.write.partitionBy("classifier").parquet(f"{root}/events")
    manifest = d.run_manifest.withColumns({c: F.lit(None).cast("string") for c in ("pdf_path", "parish_slug", "published_date")})
    manifest = manifest.withColumn("event_count", F.lit(0).cast("bigint")).withColumn("wrong_bulletin", F.lit(False))
    manifest.write.partitionBy("classifier").parquet(f"{root}/manifest")
    return root


@query("pipe_compare", f"""select t.*, round(x.micro, 4) as micro_jaccard, round(x.mean, 4) as mean_jaccard, round(x.median, 4) as median_jaccard from ({_TOTALS}) t,
    (select sum(same_count) / sum(union_count)::double as micro, avg(jaccard) as mean, median(jaccard) as median from both_row) x""")
def _(d):
    report = compare.compare_runs(d.spark, stored_runs(d), d.metadata, NAMES)
    return report.pairwise.select(*_TOTAL_COLS, "micro_jaccard", "mean_jaccard", "median_jaccard")


# every document and every event of the nested report, read back from its lines
_SIDE = "concat_ws('|', church_slug, event_type, event_kind, coalesce(day_of_week, '-'), coalesce(date, '-'), start_time, coalesce(end_time, '-'), coalesce(cancelled, false)::varchar, coalesce(page_number::varchar, '-'), coalesce(note, '-'))"
define("report_side", f"""select classifier, bulletin_source_url, {_SIDE} as side, {_ID} from (select *, row_number() over
    (partition by classifier, bulletin_source_url, {_ID} order by idx) as rn from run_event) where rn = 1""")
_SAME = " and ".join(f"a.{c} is not distinct from b.{c}" for c in ["bulletin_source_url", *_ID.split(", ")])


@query("snk_compare_report", f"""select 'document' as kind, concat_ws('|', p.bulletin_source_url, coalesce(m.pdf_path, '-'), coalesce(m.parish_slug, '-'), coalesce(m.published_date, '-'), a_count, b_count,
      same_count, a_count - same_count, b_count - same_count) as content, round(jaccard, 4) as jaccard, 1 as n from pair_row p left join metadata m on m.source_url = p.bulletin_source_url
    union all select kind, content, null, count(*) from (
      select case when a.side is null or b.side is null then 'only' else 'same' end as kind, concat_ws(' / ', a.side, b.side) as content
      from (select * from report_side where classifier = 'alpha') a full join (select * from report_side where classifier = 'beta') b on {_SAME}) group by kind, content""")
def _(d):
    path = scratch_path(d.spark, "report")
    with shuffles_freed(d.spark):
        report = compare.compare(d.run_event, d.run_manifest, d.metadata, NAMES)
        compare.write_report(report, NAMES, path, "2001-01-01T00:00:00Z", "gzip")
    lines = d.spark.read.text(f"{path}/report.json").select(F.regexp_replace("value", "^,", "").alias("j"))
    event = ", ".join(f"{c} {t}" for c, t in zip(agreement.REPORT_FIELDS, ["string"] * 7 + ["boolean", "int", "string"]))
    nested = event.replace(" ", ":").replace(",:", ",")
    counts = ["alpha_event_count", "beta_event_count", "same_count", "only_in_alpha_count", "only_in_beta_count"]
    about = f"bulletin_source_url string, pdf_path string, parish_slug string, published_date string, {', '.join(f'{c} bigint' for c in counts)}, jaccard double"
    opened = lines.where(F.col("j").endswith(', "same": [')).select(F.from_json(F.regexp_replace("j", r', "same": \[$', "}"), about).alias("e")).select("e.*")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    documents = opened.select(F.lit("document").alias("kind"), F.concat_ws("|", URL, shown("pdf_path"), shown("parish_slug"), shown("published_date"), *counts).alias("content"),
                              "jaccard", F.lit(1).cast("bigint").alias("n"))
    side = lambda e: F.concat_ws("|", *[shown(f"{e}.{c}") for c in agreement.REPORT_FIELDS])
    both = lines.where(F.col("j").startswith('{"alpha":')).select(F.from_json("j", f"alpha struct<{nested}>, beta struct<{nested}>").alias("e"))
    one = lines.where(F.col("j").startswith('{"church_slug":')).select(F.from_json("j", event).alias("e"))
    events = both.select(F.lit("same").alias("kind"), F.concat_ws(" / ", side("e.alpha"), side("e.beta")).alias("content")).unionByName(
        one.select(F.lit("only").alias("kind"), side("e").alias("content")))
    return documents.unionByName(events.groupBy("kind", "content").agg(F.lit(None).cast("double").alias("jaccard"), F.count(F.lit(1)).alias("n")))
