"""Comparison report over any number of extractor runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.functions.text import KEY_PARTS, empty_to_null, event_line
from belfry.operators import agreement
from belfry.operators.agreement import URL
from belfry.session import shuffles_freed, unwritten, written
from belfry.sources.runs import read_runs
from belfry.sources.sinks import write_json, write_lines


@dataclass
class Report:
    stats: DataFrame
    pairwise: DataFrame
    one_sided: DataFrame
    per_bulletin: DataFrame
    events: DataFrame


def compare(events: DataFrame, manifest: DataFrame, metadata: DataFrame, names: list[str],
            summaries: DataFrame | None = None) -> Report:
    agreement.pairs_of(names)
    counts = written(agreement.url_counts(events, manifest, names), "url-counts")
    pairs = agreement.pair_counts(counts, names)
    return Report(
        stats=agreement.run_stats(counts, names, summaries),
        pairwise=rounded(agreement.pair_metrics(pairs)),
        one_sided=agreement.one_sided_zero(pairs),
        per_bulletin=rounded(agreement.bulletin_details(pairs, agreement.run_metadata(metadata))),
        events=agreement.event_rows(events, names))


def compare_runs(spark: SparkSession, root: str, metadata: DataFrame, names: list[str]) -> Report:
    """Compare stored runs by name."""
    agreement.pairs_of(names)
    events, manifest, summaries = read_runs(spark, root, names)
    return compare(events, manifest, metadata, names, summaries)


def rounded(df: DataFrame) -> DataFrame:
    """Ratios to four places, half to even."""
    ratios = [c for c in df.columns if c.endswith("jaccard")]
    return df.withColumns({c: F.bround(c, 4) for c in ratios})


def _text(c: str, missing: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def _cells(*parts) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def summary_lines(report: Report, names: list[str]) -> DataFrame:
    """(part, pos, line): the two tables of the short report.

    Parts 1 and 3 are the rows; the fixed headings are attached by :func:`markdown`.
    """
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("classifier"))
    has = set(report.stats.columns)
    get = lambda c, missing="": _text(c, missing) if c in has else F.lit(missing)
    stats = report.stats.select(
        F.lit(1).alias("part"), order.cast("bigint").alias("pos"), _cells(
            F.col("classifier"), get("classifier_version"), _text("bulletins"), _text("events_total"),
            F.bround("events_per_bulletin_mean", 2).cast("string"),
            F.concat(get("cache_hits", "0"), F.lit("/"), get("cache_misses", "0")), get("wall_seconds"),
            get("errors", "0")).alias("line"))
    pairs = report.pairwise.select(
        F.lit(3).alias("part"), F.col("pair").cast("bigint").alias("pos"), _cells(
            F.col("a"), F.col("b"), _text("bulletins_in_both"), _text("events_in_both"), _text("events_in_union"),
            _text("micro_jaccard", "None"), _text("mean_jaccard", "None"), _text("one_sided_zero")).alias("line"))
    return stats.unionByName(pairs)


# Headings of the Markdown report.
STATS_HEAD = ["## Per-classifier", "",
              "| Classifier | Version | Bulletins | Events | Mean/bulletin | Cache hits/misses | Wall (s) | Errors |",
              "|---|---|---:|---:|---:|---|---:|---:|"]
PAIRS_HEAD = ["", "## Pairwise agreement (exact tuple match)", "",
              "| A | B | Bulletins shared | Events ∩ | Events ∪ | Micro-Jaccard | Mean Jaccard | One-sided-zero |",
              "|---|---|---:|---:|---:|---:|---:|---:|"]
LINE_KEY = ["part", "pos", "parish", "published", URL, "step", *KEY_PARTS, "missing"]


# --- events on their way into the texts ----------------------------------------------------------------------
# Both texts are sorts of every event.  What is sorted is narrow: the identity once, and of each run's event what
# it has beside it; a line is spelled out only after its row has found its place.

OPTIONAL = [p for p in KEY_PARTS if p not in agreement.REQUIRED and p != "cancelled"]
REST = "struct<missing:int,page_number:int,note:string>"
NO_EVENT = {**{p: "" for p in KEY_PARTS}, "cancelled": False, "missing": 0}
PLACES = {"same": 1, "only_a": 3, "only_b": 5}


def _bit(part: str, parts: list[str]) -> int:
    """The earlier part has the greater bit, so that of equal texts the one that misses an earlier part comes later."""
    return 1 << (len(parts) - 1 - parts.index(part))


def _bits(value: Column, parts: list[str]) -> Column:
    return reduce(lambda x, y: x + y, [F.when(value[p].isNull(), _bit(p, parts)).otherwise(0) for p in parts])


def _rest(event: Column) -> Column:
    """What an event has beside its identity; null where there is none."""
    return F.when(event.isNotNull(), F.struct(_bits(event, agreement.REQUIRED).alias("missing"), event["page_number"].alias("page_number"),
                                              event["note"].alias("note")))


def _event(rest: Column) -> Column:
    """The event again, from its row and its rest; null where there is none."""
    def part(c: str) -> Column:
        if c in OPTIONAL:
            return F.when(F.col("missing").bitwiseAND(_bit(c, OPTIONAL)) == 0, F.col(c))
        if c in agreement.REQUIRED:
            return F.when(rest["missing"].bitwiseAND(_bit(c, agreement.REQUIRED)) == 0, F.col(c))
        return F.col(c) if c in KEY_PARTS else rest[c]
    return F.when(rest.isNotNull(), F.struct(*[part(c).alias(c) for c in agreement.REPORT_FIELDS]))


def _documents(report: Report) -> DataFrame:
    return report.per_bulletin.withColumns({"parish": F.coalesce("parish_slug", F.lit("")), "published": F.coalesce("published_date", F.lit(""))})


def _narrow(report: Report) -> DataFrame:
    key = F.col("key")
    parts = [(F.coalesce(key[p], F.lit("")) if p in OPTIONAL else key[p]).alias(p) for p in KEY_PARTS]
    place = reduce(lambda when, b: when.when(F.col("bucket") == b, PLACES[b]), PLACES, F)
    return report.events.select("pair", URL, place.alias("place"), *parts, _bits(key, OPTIONAL).alias("missing"),
                                _rest(F.col("event_a")).alias("rest_a"), _rest(F.col("event_b")).alias("rest_b"))


def event_places(report: Report) -> DataFrame:
    """Per pair and document with events: what it is sorted by, and the first event of each of its lists."""
    at = F.struct(*KEY_PARTS, "missing")
    first = _narrow(report).groupBy("pair", URL).agg(*[F.min(F.when(F.col("place") == n, at)).alias(f"first_{n}") for n in PLACES.values()])
    return _documents(report).select("pair", URL, "parish", "published").join(first, ["pair", URL])


def placed_events(report: Report, places: DataFrame | None = None) -> DataFrame:
    """Every event with the sort columns of its document; ``later`` if it is not the first of its list."""
    first = reduce(lambda when, n: when.when(F.col("place") == n, F.col(f"first_{n}")), PLACES.values(), F)
    rows = _narrow(report).join(event_places(report) if places is None else places, ["pair", URL])
    return rows.select("pair", URL, "parish", "published", "place", *KEY_PARTS, "missing", "rest_a", "rest_b",
                       (F.struct(*KEY_PARTS, "missing") != first).alias("later"))


def markdown_rows(report: Report, names: list[str], placed: DataFrame) -> DataFrame:
    """Side-by-side report as rows (sort columns, texts of one line each, and of an event its rest); :func:`markdown_texts` spells them.

    Every event is its own row, so the report of any size is one distributed sort.  Lines of a document that no event
    can part are one row.
    """
    spark = report.stats.sparkSession
    schema = "part int, pos bigint, step int, texts array<string>"
    fixed = [(-1, 0, 0, ["# Classifier Compare", ""]), (0, 0, 0, STATS_HEAD), (2, 0, 0, PAIRS_HEAD), (4, 0, 0, ["", "## Per-bulletin side-by-side"])]
    fixed += [(5, p, 0, ["", f"### {a} vs {b}"]) for p, (a, b) in enumerate(agreement.pairs_of(names))]
    blank = F.lit("")
    no_event = {**{c: F.lit(v) for c, v in NO_EVENT.items()}, "rest": F.lit(None).cast(REST)}
    no_doc = {"parish": blank, "published": blank, URL: blank, **no_event}
    head = spark.createDataFrame(fixed, schema).withColumns(no_doc)
    tables = summary_lines(report, names).withColumn("texts", F.array("line")).drop("line").withColumn("step", F.lit(0)).withColumns(no_doc)

    title = F.coalesce(empty_to_null(F.concat_ws(" - ", empty_to_null(F.col("parish_slug")),
                                                 empty_to_null(F.col("published_date")))), F.col(URL))
    none = lambda count: F.when(F.col(count) == 0, "- None")
    texts = {
        2: [F.lit(""), F.concat(F.lit("#### "), title), F.concat(F.lit("- Source URL: "), F.col(URL)),
            F.concat(F.lit("- Source PDF: `"), F.col("pdf_path"), F.lit("`")),
            F.concat(F.lit("- Counts: same "), _text("same_count"), F.lit(", only "), F.col("a"), F.lit(" "),
                     _text("only_a_count"), F.lit(", only "), F.col("b"), F.lit(" "), _text("only_b_count"),
                     F.lit(", Jaccard "), _text("jaccard")),
            F.lit(""), F.lit("**Same**"), none("same_count")],
        20: [F.lit(""), F.concat(F.lit("**Only "), F.col("a"), F.lit("**")), none("only_a_count")],
        30: [F.lit(""), F.concat(F.lit("**Only "), F.col("b"), F.lit("**")), none("only_b_count")]}
    lines = F.array(*[F.struct(F.lit(i).alias("step"), F.array_compact(F.array(*ts)).alias("texts")) for i, ts in texts.items()])
    bulletins = (_documents(report).select(F.lit(5).alias("part"), F.col("pair").cast("bigint").alias("pos"), "parish",
                                           "published", URL, F.explode(lines).alias("l"))
                 .select("part", "pos", "parish", "published", URL, "l.step", "l.texts").withColumns(no_event))
    step = F.when(F.col("place") == PLACES["same"], 13).when(F.col("place") == PLACES["only_a"], 23).otherwise(33)
    events = placed.select(F.lit(5).alias("part"), F.col("pair").cast("bigint").alias("pos"), "parish", "published", URL, step.alias("step"),
                           *KEY_PARTS, "missing", F.lit(None).cast("array<string>").alias("texts"), F.coalesce("rest_a", "rest_b").alias("rest"))
    return reduce(DataFrame.unionByName, [head, tables, bulletins, events])


def markdown_texts() -> Column:
    return F.coalesce("texts", F.array(F.concat(F.lit("- "), event_line(_event(F.col("rest"))))))


def markdown(report: Report, names: list[str]) -> DataFrame:
    """Side-by-side report as rows (sort columns, line); sort by ``LINE_KEY`` to read it."""
    rows = markdown_rows(report, names, placed_events(report)).select(*LINE_KEY, F.posexplode(markdown_texts()).alias("nth", "line"))
    return rows.withColumn("step", F.col("step") + F.col("nth")).drop("nth")


# --- the report as one nested document -------------------------------------------------------------------
# Every element of every array is a line of its own, placed by its sort columns; what opens and closes an array
# is a line, too.  An element that is not the first of its array starts with a comma.  So a document with any
# number of events is one distributed sort, and the files read one after the other are one JSON text.

JSON_KEY = ["part", "pos", "step", "parish", "published", URL, "place", *KEY_PARTS, "missing"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), KEEP_NULLS)


def _opened(text: Column, rest: str) -> Column:
    """A JSON object left open, with the beginning of its next field."""
    return F.concat(F.left(text, F.length(text) - 1), F.lit(rest))


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def json_rows(report: Report, names: list[str], placed: DataFrame, generated_at: str) -> DataFrame:
    """The nested report as rows (sort columns, text, ``later``, and of an event its rests); :func:`json_line` spells them."""
    spark = report.stats.sparkSession
    blank, pairs, no_rest = F.lit(""), agreement.pairs_of(names), F.lit(None).cast(REST)
    no_event = {**{c: F.lit(v) for c, v in NO_EVENT.items()}, "rest_a": no_rest, "rest_b": no_rest}

    head = json.dumps({"generated_at": generated_at, "classifiers": names}, ensure_ascii=False)
    rows = [(0, 0, 0, head[:-1] + ', "per_classifier": ['), (2, 0, 0, '], "pairwise": ['), (4, 0, 0, "]}")]
    for pos in range(len(pairs)):
        rows += [(3, pos, 2, '], "per_bulletin": ['), (3, pos, 4, "]}")]
    no_doc = {"parish": blank, "published": blank, URL: blank, "place": F.lit(0), "later": F.lit(False)}
    fixed = spark.createDataFrame(rows, "part int, pos bigint, step int, text string").withColumns({**no_doc, **no_event})

    def framed(df: DataFrame, text: Column, *, part: int, step: int, pos: Column, place: Column = F.lit(0), later: Column = F.lit(False),
               doc: bool = False, url: Column = blank) -> DataFrame:
        sort = {"part": F.lit(part), "pos": pos.cast("bigint"), "step": F.lit(step), "parish": F.col("parish") if doc else blank,
                "published": F.col("published") if doc else blank, URL: url, "place": place}
        return df.select(*_named({**sort, "text": text, "later": later, **no_event}))

    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("classifier"))
    has = set(report.stats.columns)
    get = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    stats = _json(*_named({
        "classifier": F.col("classifier"), "version": get("classifier_version", "string"), "bulletins": F.col("bulletins"),
        "events_total": F.col("events_total"), "events_per_bulletin_mean": F.bround("events_per_bulletin_mean", 2),
        "events_per_bulletin_median": F.col("events_per_bulletin_median"), "events_per_bulletin_max": F.col("events_per_bulletin_max"),
        "cache_hits": get("cache_hits", "bigint"), "cache_misses": get("cache_misses", "bigint"),
        "wall_seconds": get("wall_seconds", "double"), "errors": F.coalesce(get("errors", "bigint"), F.lit(0))}))

    out = [fixed, framed(report.stats, stats, part=1, step=0, pos=order, later=order > 1)]
    documents = _documents(report)
    for pos, (a, b) in enumerate(pairs):
        here = F.lit(pos)
        mine = [df.where(F.col("pair") == pos) for df in (report.pairwise, report.one_sided, documents)]
        total = _json(*_named({
            "classifier_a": F.lit(a), "classifier_b": F.lit(b), **{c: F.col(c) for c in ("bulletins_in_both", "bulletins_only_in_a", "bulletins_only_in_b")},
            f"events_total_{a}": F.col("events_total_a"), f"events_total_{b}": F.col("events_total_b"), "events_in_both": F.col("events_in_both"),
            "events_in_union": F.col("events_in_union"), **{c: F.col(c) for c in ("micro_jaccard", "mean_jaccard", "median_jaccard")}}))
        # two runs without any document have no totals: those of nothing open the object then
        nothing = json.dumps({"classifier_a": a, "classifier_b": b, "bulletins_in_both": 0, "bulletins_only_in_a": 0, "bulletins_only_in_b": 0,
                              f"events_total_{a}": 0, f"events_total_{b}": 0, "events_in_both": 0, "events_in_union": 0,
                              "micro_jaccard": None, "mean_jaccard": None, "median_jaccard": None}, ensure_ascii=False)
        opening = mine[0].agg(F.coalesce(F.max(total), F.lit(nothing)).alias("total"))
        out.append(framed(opening, F.concat(F.lit("," if pos else ""), _opened(F.col("total"), ', "one_sided_zero_event_bulletins": [')),
                          part=3, step=0, pos=here))
        sided = _json(*_named({URL: F.col(URL), f"{a}_event_count": F.col("a_count"), f"{b}_event_count": F.col("b_count")}))
        first = mine[1].groupBy("pair").agg(F.min(URL).alias("first"))  # one row, as every frame here is of one pair
        out.append(framed(mine[1].join(F.broadcast(first), "pair"), sided, part=3, step=1, pos=here, later=F.col(URL) != F.col("first"), url=F.col(URL)))

        first = mine[2].groupBy("pair").agg(F.min(F.struct("parish", "published", URL)).alias("first"))
        about = _json(*_named({
            URL: F.col(URL), "pdf_path": F.col("pdf_path"), "parish_slug": F.col("parish_slug"), "published_date": F.col("published_date"),
            f"{a}_event_count": F.col("a_count"), f"{b}_event_count": F.col("b_count"), "same_count": F.col("same_count"),
            f"only_in_{a}_count": F.col("only_a_count"), f"only_in_{b}_count": F.col("only_b_count"), "jaccard": F.col("jaccard")}))
        frame = {0: _opened(about, ', "same": ['), 2: F.lit(f"], {json.dumps(f'only_in_{a}')}: ["), 4: F.lit(f"], {json.dumps(f'only_in_{b}')}: ["), 6: F.lit("]}")}
        is_later = F.struct("parish", "published", URL) != F.col("first")
        lines = F.array(*[F.struct(F.lit(n).alias("place"), text.alias("text")) for n, text in frame.items()])
        each = mine[2].join(F.broadcast(first), "pair").select("parish", "published", URL, is_later.alias("is_later"), F.explode(lines).alias("l"))
        out.append(framed(each, F.col("l.text"), part=3, step=3, pos=here, place=F.col("l.place"), later=F.col("is_later") & (F.col("l.place") == 0),
                          doc=True, url=F.col(URL)))
    out.append(placed.select(F.lit(3).alias("part"), F.col("pair").cast("bigint").alias("pos"), F.lit(3).alias("step"), "parish", "published", URL, "place",
                             *KEY_PARTS, "missing", F.lit(None).cast("string").alias("text"), "later", "rest_a", "rest_b"))
    return reduce(DataFrame.unionByName, out)


def json_line(names: list[str]) -> Column:
    text = lambda rest: F.to_json(_event(F.col(rest)), KEEP_NULLS)
    name = lambda i: F.element_at(F.array(*[F.lit(json.dumps(pair[i], ensure_ascii=False)) for pair in agreement.pairs_of(names)]), F.col("pos").cast("int") + 1)
    both = F.concat(F.lit("{"), name(0), F.lit(":"), text("rest_a"), F.lit(","), name(1), F.lit(":"), text("rest_b"), F.lit("}"))
    line = F.when(F.col("text").isNotNull(), F.col("text")).when(F.col("place") == PLACES["same"], both).otherwise(F.coalesce(text("rest_a"), text("rest_b")))
    return F.concat(F.when(F.col("later"), ",").otherwise(""), line)


def json_lines(report: Report, names: list[str], generated_at: str) -> DataFrame:
    """The nested report as rows (sort columns, line); sort by ``JSON_KEY`` to read it."""
    return json_rows(report, names, placed_events(report), generated_at).select(*JSON_KEY, json_line(names).alias("line"))


def write_report(report: Report, names: list[str], path: str, generated_at: str = "", compression: str = "none") -> None:
    """Rows per report level (gzipped JSON lines), the nested JSON text, and the Markdown text, both as ``compression`` says.

    Every level is made once and kept while the report is written: the texts mention events and documents many times.
    """
    levels = ("stats", "pairwise", "one_sided", "per_bulletin", "events")
    with shuffles_freed(report.stats.sparkSession):
        report = replace(report, **{name: written(getattr(report, name), f"report-{name}") for name in levels})
        for name in levels:
            write_json(getattr(report, name), f"{path}/{name}", "gzip")
        places = written(event_places(report), "report-places")
        placed = written(placed_events(report, places), "report-placed")
        unwritten(places, report.events)
        write_lines(json_rows(report, names, placed, generated_at), f"{path}/report.json", JSON_KEY, json_line(names), compression)
        write_lines(markdown_rows(report, names, placed), f"{path}/markdown", LINE_KEY, F.array_join(markdown_texts(), "\n"), compression)
    unwritten(placed, *[getattr(report, name) for name in levels if name != "events"])
