"""Exact-key agreement between extractor runs.

Runs arrive as one frame with a ``classifier`` column.  Every (document, key) cell is
reduced once to a presence flag per run; pair counts are sums over those flags, so no
run is ever joined to another and the number of rows does not grow with the pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belfry.functions.text import KEY_PARTS, event_key
from belfry.session import written

URL = "bulletin_source_url"
REPORT_FIELDS = ["church_slug", "event_type", "event_kind", "day_of_week", "date", "start_time",
                 "end_time", "cancelled", "page_number", "note"]


def pairs_of(names: list[str]) -> list[tuple[str, str]]:
    if len(names) < 2:
        raise ValueError("Need at least two classifiers to compare")
    return list(combinations(names, 2))


def with_key(events: DataFrame) -> DataFrame:
    return events.where(F.col(URL).isNotNull()).withColumn("key", event_key())


def report_event() -> Column:
    """The reported projection of an event row; a missing cancelled flag is false."""
    return F.struct(*[F.coalesce("cancelled", F.lit(False)).alias(c) if c == "cancelled" else F.col(c)
                      for c in REPORT_FIELDS])


REQUIRED = ["church_slug", "event_type", "event_kind", "start_time"]


def _dealt(events: DataFrame, *also: str) -> tuple[DataFrame, list[str]]:
    """Rows dealt out by document and identity part, and the columns they are dealt by.

    Every row travels once and narrow: the identity and, in ``rest``, what the reported event has beside it.
    Hardly two rows of a run agree, so nothing would be gained by grouping them before.
    """
    by = [*also, URL, *[f"k_{p}" for p in KEY_PARTS]]
    rest = F.struct(*[F.col(p).isNull().alias(f"no_{p}") for p in REQUIRED], "page_number", "note")
    keyed = with_key(events).select("classifier", "idx", URL, *[F.col(f"key.{p}").alias(f"k_{p}") for p in KEY_PARTS], rest.alias("rest"))
    return keyed.repartition(*by), by


def _key() -> Column:
    return F.struct(*[F.col(f"k_{p}").alias(p) for p in KEY_PARTS]).alias("key")


def _event(rest: Column) -> Column:
    """:func:`report_event` of a dealt row; null where there is none."""
    part = lambda c: F.when(~rest[f"no_{c}"], F.col(f"k_{c}")) if c in REQUIRED else F.col(f"k_{c}") if c in KEY_PARTS else rest[c]
    return F.when(rest.isNotNull(), F.struct(*[part(c).alias(c) for c in REPORT_FIELDS]))


def key_cells(events: DataFrame, names: list[str]) -> DataFrame:
    """(url, key, in_0, in_1, ...): one row per distinct event identity of a document."""
    flags = [F.max((F.col("classifier") == n).cast("int")).alias(f"in_{i}") for i, n in enumerate(names)]
    dealt, by = _dealt(events.where(F.col("classifier").isin(*names)))
    return dealt.groupBy(*by).agg(*flags).select(URL, _key(), *[f"in_{i}" for i in range(len(names))])


def url_counts(events: DataFrame, manifest: DataFrame, names: list[str]) -> DataFrame:
    """Per document: has_i, n_i per run and same_i_j per pair, over every known URL."""
    cells = key_cells(events, names).select(URL, F.lit(1).alias("is_key"),
                                            *[f"in_{i}" for i in range(len(names))])
    listed = (manifest.where(F.col(URL).isNotNull() & F.col("classifier").isin(*names))
              .select(URL, F.lit(0).alias("is_key"),
                      *[(F.col("classifier") == n).cast("int").alias(f"in_{i}") for i, n in enumerate(names)]))
    n = range(len(names))
    return cells.unionByName(listed).groupBy(URL).agg(
        *[(F.max(f"in_{i}") == 1).alias(f"has_{i}") for i in n],
        *[F.sum(F.col(f"in_{i}") * F.col("is_key")).alias(f"n_{i}") for i in n],
        *[F.sum(F.col(f"in_{i}") * F.col(f"in_{j}") * F.col("is_key")).alias(f"same_{i}_{j}")
          for i, j in combinations(n, 2)])


def pair_counts(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row per pair and document either run knows."""
    rows = [F.struct(
        F.lit(pos).alias("pair"), F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"),
        F.col(f"has_{i}").alias("in_a"), F.col(f"has_{j}").alias("in_b"),
        F.col(f"n_{i}").alias("a_count"), F.col(f"n_{j}").alias("b_count"),
        F.col(f"same_{i}_{j}").alias("same_count"),
        (F.col(f"n_{i}") + F.col(f"n_{j}") - F.col(f"same_{i}_{j}")).alias("union_count"))
        for pos, (i, j) in enumerate(combinations(range(len(names)), 2))]
    exploded = counts.select(URL, F.explode(F.array(*rows)).alias("p")).select(URL, "p.*")
    jaccard = F.when(F.col("union_count") == 0, F.lit(1.0)).otherwise(
        F.col("same_count") / F.nullif(F.col("union_count"), F.lit(0)))
    return exploded.where(F.col("in_a") | F.col("in_b")).withColumn("jaccard", jaccard)


def medians(frame: DataFrame, by: list[str], value: str, out: str, times: str | None = None) -> DataFrame:
    """Exact median per group: the mean of the two middle values (one and the same for an odd number).

    A row stands for ``times`` values, or for one.

    Equal values travel once, with their number.  The different values of all groups are dealt out by range, each
    range counts how many rows precede it in its group, and only the ranges that hold a middle row look it up:
    no task ever holds a whole group.
    """
    number = F.sum(times) if times else F.count(F.lit(1))
    freq = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(number.alias("times"))
    ranged = written(freq.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "value-ranges")
    sizes = ranged.groupBy(*by, "part").agg(F.sum("times").alias("size"))
    group = Window.partitionBy(*by)
    first_row = F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "part", "size", F.coalesce(first_row, F.lit(0)).alias("first"), F.sum("size").over(group).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holding = starts.where((F.col("first") <= high) & (F.col("first") + F.col("size") > low))
    up_to = F.col("first") + F.sum("times").over(Window.partitionBy(*by, "part").orderBy(value))
    rows = ranged.join(holding, [*by, "part"]).withColumn("up_to", up_to)
    middle = [F.max(F.when((F.col("up_to") > at) & (F.col("up_to") - F.col("times") <= at), F.col(value))) for at in (low, high)]
    return rows.groupBy(*by).agg((middle[0] * 0.5 + middle[1] * 0.5).alias(out))


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """One row per pair: totals over shared documents, micro / mean / median Jaccard.

    Documents with the same counts travel once, with their number; they are counted in one pass and kept.
    """
    alike = ["pair", "a", "b", "in_a", "in_b", "a_count", "b_count", "same_count", "union_count", "jaccard"]
    pairs = written(pairs.groupBy(*alike).agg(F.count(F.lit(1)).alias("times")), "pair-counts")
    both, times = F.col("in_a") & F.col("in_b"), F.col("times")
    number = lambda test: F.coalesce(F.sum(F.when(test, times)), F.lit(0))
    totals = pairs.groupBy("pair", "a", "b").agg(
        number(both).alias("bulletins_in_both"),
        number(~F.col("in_b")).alias("bulletins_only_in_a"),
        number(~F.col("in_a")).alias("bulletins_only_in_b"),
        *[F.coalesce(F.sum(F.when(both, F.col(c) * times)), F.lit(0)).alias(out) for c, out in (
            ("a_count", "events_total_a"), ("b_count", "events_total_b"),
            ("same_count", "events_in_both"), ("union_count", "events_in_union"))],
        (F.sum(F.when(both, F.col("jaccard") * times)) / F.nullif(number(both), F.lit(0))).alias("mean_jaccard"),
        number(both & ((F.col("a_count") == 0) != (F.col("b_count") == 0))).alias("one_sided_zero"))
    middle = medians(pairs.where(both), ["pair"], "jaccard", "median_jaccard", "times")
    micro = F.try_divide(F.col("events_in_both"), F.col("events_in_union"))
    return totals.withColumn("micro_jaccard", micro).join(middle, "pair", "left")


def one_sided_zero(pairs: DataFrame) -> DataFrame:
    """Shared documents where exactly one run found nothing."""
    return (pairs.where(F.col("in_a") & F.col("in_b") & ((F.col("a_count") == 0) != (F.col("b_count") == 0)))
            .select("pair", "a", "b", URL, "a_count", "b_count"))


def bulletin_details(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per pair and document: counts, Jaccard and the metadata of the document."""
    known = metadata.select(F.col("source_url").alias(URL), "pdf_path", "parish_slug", "published_date")
    return pairs.join(known, URL, "left").select(
        "pair", "a", "b", URL, "pdf_path", "parish_slug", "published_date", "a_count", "b_count", "same_count",
        (F.col("a_count") - F.col("same_count")).alias("only_a_count"),
        (F.col("b_count") - F.col("same_count")).alias("only_b_count"), "jaccard")


def run_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata keyed by URL; of repeated URLs the last row counts."""
    last = F.max_by(F.struct("pdf_path", "parish_slug", "published_date"), "idx").alias("m")
    return metadata.where(F.col("source_url").isNotNull()).groupBy("source_url").agg(last).select("source_url", "m.*")


def first_by_key(events: DataFrame) -> DataFrame:
    """The first row (by idx) of each identity key of each run and document."""
    dealt, by = _dealt(events, "classifier")
    first = dealt.groupBy(*by).agg(F.min_by("rest", "idx").alias("rest"))
    return first.select("classifier", URL, _key(), _event(F.col("rest")).alias("ev"))


def event_rows(events: DataFrame, names: list[str]) -> DataFrame:
    """Event-level report rows: pair, document, bucket (same, only_a, only_b), both renderings.

    Rows stay flat and sortable by ``key``: a document with very many events is never
    gathered into one array.
    """
    dealt, by = _dealt(events.where(F.col("classifier").isin(*names)))
    cells = dealt.groupBy(*by).agg(*[
        F.min_by(F.when(F.col("classifier") == n, F.col("rest")),
                 F.when(F.col("classifier") == n, F.col("idx"))).alias(f"rest_{i}") for i, n in enumerate(names)])
    cells = cells.select(URL, _key(), *[_event(F.col(f"rest_{i}")).alias(f"ev_{i}") for i in range(len(names))])
    rows = [F.struct(F.lit(pos).alias("pair"), F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"),
                     F.col(f"ev_{i}").alias("event_a"), F.col(f"ev_{j}").alias("event_b"))
            for pos, (i, j) in enumerate(combinations(range(len(names)), 2))]
    out = cells.select(URL, "key", F.explode(F.array(*rows)).alias("p")).select(URL, "key", "p.*")
    a, b = F.col("event_a").isNotNull(), F.col("event_b").isNotNull()
    return out.where(a | b).withColumn(
        "bucket", F.when(a & b, "same").when(a, "only_a").otherwise("only_b"))


def run_stats(counts: DataFrame, names: list[str], summaries: DataFrame | None = None) -> DataFrame:
    """Per run: documents, distinct events, mean, median and maximum per document, cache counters."""
    rows = F.explode(F.array(*[F.struct(
        F.lit(n).alias("classifier"), F.col(f"has_{i}").alias("has"), F.col(f"n_{i}").alias("n"))
        for i, n in enumerate(names)]))
    # documents with the same number of events travel once, with their number; they are counted in one pass and kept
    per_url = counts.select(rows.alias("r")).select("r.*").where("has")
    sizes = written(per_url.groupBy("classifier", "n").agg(F.count(F.lit(1)).alias("times")), "run-sizes")
    total, number = F.sum(F.col("n") * F.col("times")), F.sum("times")
    stats = sizes.groupBy("classifier").agg(
        number.alias("bulletins"), total.alias("events_total"),
        (total / number).alias("events_per_bulletin_mean"), F.max("n").alias("events_per_bulletin_max"))
    stats = stats.join(medians(sizes, ["classifier"], "n", "events_per_bulletin_median", "times"), "classifier")
    if summaries is None:
        return stats
    return stats.join(summaries.select("classifier", "classifier_version", "cache_hits", "cache_misses",
                                       "wall_seconds", "errors"), "classifier", "left")


def sort_parts() -> list[Column]:
    """Sort columns of the identity key: every part as text, null as empty text."""
    return [F.coalesce(F.col(f"key.{p}").cast("string"), F.lit("")) for p in KEY_PARTS]
