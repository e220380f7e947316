"""Weighted approximate church search for a table of queries.

A field text matches a query of length m where a stretch of the text, starting at place p, lies at edit
distance e with ``e / m + p / 100 <= 0.4``; the smallest such value is the match's distance.  So at most
``2 * m // 5`` edits are allowed, and of one gram more than that, taken from the query without overlap, one
must stand in the text unchanged and near its place.  The query's rarest such grams are looked up in the
grams of all distinct texts, and the pairs found are verified by a bit-parallel matcher that runs over many
pairs at once.  Only texts that can still reach the top ten go on to the churches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from belfry.functions.text import strip
from belfry.operators.filters import has_coords
from belfry.session import written

# Field weights, match threshold, cost of a place, result size, shortest query, least distances.
WEIGHTS = {"name": 0.62, "city": 0.13, "state": 0.08, "postal_code": 0.08,
           "address_line1": 0.07, "address_line2": 0.02}
MAX_DISTANCE = 0.4
PLACES = 100
TOP = 10
MIN_QUERY = 2
NEAR, EQUAL = 0.001, 2.0 ** -52  # of any match, and of a text that equals the query

SALTS = 16    # parts of the texts that hold one gram
PAIRS = 8192  # pairs matched at once
WORD = 63     # letters of a query that fit a machine word; longer ones use integers of any size


def allowed_edits(length: Column) -> Column:
    return F.floor(length * 2 / 5).cast("int")


def grams(text: Column, size: int) -> Column:
    """(at, gram) structs of a text's letters or letter pairs."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    found = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), text.substr(i, F.lit(size)).alias("gram")))
    return F.when(F.length(text) >= size, found).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))


def rarest_apart(counts: list[int], size: int, need: int) -> list[int]:
    """Starts of ``need`` grams that do not overlap and together occur least often; ``counts`` per start."""
    n = len(counts)
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * need for _ in range(n + size)]
    for at in range(n - 1, -1, -1):
        for k in range(1, need + 1):
            without, rest = best[at + 1][k], best[at + size][k - 1]
            taken = (rest[0] + counts[at], (at, *rest[1])) if rest else None
            best[at][k] = min((x for x in (without, taken) if x), default=None)
    return list(best[0][need][1])


@F.pandas_udf(ArrayType(IntegerType()))
def _rarest(counts: pd.Series, size: pd.Series, need: pd.Series) -> pd.Series:
    return pd.Series([rarest_apart([int(x) for x in c], int(s), int(n)) for c, s, n in zip(counts, size, need)])


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, one row per text, cut or filled with 0 to ``width``."""
    out = np.zeros((len(texts), width), dtype=np.uint32)
    for i, t in enumerate(texts):
        held = np.frombuffer(t[:width].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i, :len(held)] = held
    return out


def match_distances(queries: list[str], texts: list[str]) -> np.ndarray:
    """Per pair the smallest ``edits / length + place / 100`` of at most 0.4, or NaN.

    Texts are read from right to left; bit i of state e says that the last i + 1 letters of the query stand at
    the current place with at most e edits.
    """
    out = np.full(len(queries), np.nan)
    m = np.array([len(q) for q in queries], dtype=np.int64)
    for long in (False, True):
        rows = np.flatnonzero((m > WORD) == long)
        for low in range(0, len(rows), PAIRS):
            some = rows[low:low + PAIRS]
            out[some] = _matched([queries[i] for i in some], [texts[i] for i in some], object if long else np.uint64)
    return out


def _matched(queries: list[str], texts: list[str], kind: type) -> np.ndarray:
    one = 1 if kind is object else np.uint64(1)
    size = np.array([len(q) for q in queries])
    edits = size * 2 // 5
    names = {q: i for i, q in enumerate(dict.fromkeys(queries))}
    which = np.array([names[q] for q in queries])
    letters = np.array(sorted({ord(c) for q in names for c in q}), dtype=np.uint32)
    masks = np.zeros((len(names), len(letters) + 1), dtype=kind)
    place = {int(c): i for i, c in enumerate(letters)}
    for q, i in names.items():
        for bit, c in enumerate(reversed(q)):
            masks[i, place[ord(c)]] |= one << kind(bit) if kind is not object else 1 << bit
    lengths = np.array([len(t) for t in texts])
    # beyond the last place allowed and the longest stretch from there, letters do not matter
    width = int(min(lengths.max(initial=0), (int(MAX_DISTANCE * PLACES) + size + edits).max(initial=0)))
    codes = _codes(texts, width)
    found = np.searchsorted(letters, codes)
    known = letters[np.minimum(found, len(letters) - 1)] == codes
    found = np.where(known, found, len(letters))
    top = [one << kind(int(n) - 1) if kind is not object else 1 << (int(n) - 1) for n in size]
    top = np.array(top, dtype=kind)
    levels = int(edits.max(initial=0)) + 1
    state = [np.full(len(queries), (1 << e) - 1, dtype=kind) for e in range(levels)]
    best = np.full(len(queries), np.inf)
    for at in range(width - 1, -1, -1):
        inside = at < lengths
        mask = masks[which, found[:, at]]
        before_old = before_new = None
        for e in range(levels):
            old = state[e]
            new = ((old << one) | one) & mask
            if e:
                new = new | (before_old << one) | (before_new << one) | before_old | one
            new = np.where(inside, new, old)
            before_old, before_new, state[e] = old, new, new
            hit = inside & (e <= edits) & ((new & top) != 0)
            value = e / size + at / PLACES
            best = np.where(hit & (value < best), value, best)
    return np.where(best <= MAX_DISTANCE, best, np.nan)


@F.pandas_udf(DoubleType())
def match_distance(queries: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series(match_distances(queries.tolist(), texts.tolist())).astype(object).where(lambda x: x.notna(), None)


def field_texts(church: DataFrame) -> DataFrame:
    """(church_id, field, text) in lower case for named churches that have coordinates."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("text")) for f in WEIGHTS]))
    return (church.where(has_coords() & (F.col("name") != ""))
            .select(F.col("id").alias("church_id"), fields.alias("f"))
            .where(F.length(F.trim("f.text")) > 0).select("church_id", "f.field", "f.text"))


def candidates(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(wanted, text): different queries and texts that share one of the query's chosen grams near its place."""
    size, edits = F.when(F.col("m").isin(3, 5), 1).otherwise(2), allowed_edits(F.col("m"))
    asked = queries.select("wanted").distinct().withColumn("m", F.length("wanted")).select("wanted", edits.alias("edits"), size.alias("size"))
    by_gram = written(texts.select("text", F.explode(F.concat(grams(F.col("text"), 1), grams(F.col("text"), 2))).alias("g"))
                      .select("text", "g.gram", F.col("g.at").alias("place")), "text-grams")
    common = by_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    pieces = asked.select("*", F.explode(F.when(F.col("size") == 1, grams(F.col("wanted"), 1)).otherwise(grams(F.col("wanted"), 2))).alias("g"))
    counted = pieces.select("wanted", "edits", "size", "g.at", "g.gram").join(common, "gram", "left")
    in_order = F.array_sort(F.collect_list(F.struct("at", F.coalesce("df", F.lit(0)).alias("df"), "gram")))
    chosen = (counted.groupBy("wanted", "edits", "size").agg(in_order.alias("found"))
              .withColumn("starts", _rarest(F.transform("found", lambda x: x["df"]), "size", F.col("edits") + 1))
              .select("wanted", "edits", F.explode(F.filter("found", lambda x: F.array_contains("starts", x["at"]))).alias("g"))
              .select("wanted", "edits", F.col("g.at").alias("at"), "g.gram"))
    part = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
    probes = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shift = F.col("place") - F.col("at")
    met = by_gram.withColumn("part", part).join(probes, ["gram", "part"]).where(
        (shift >= -F.col("edits")) & (shift <= F.lit(int(MAX_DISTANCE * PLACES)) + F.col("edits")))
    return met.select("wanted", "text").distinct()


def text_matches(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(wanted, text, distance) of the different queries and texts that match.

    ``queries`` holds ``wanted`` (stripped, lower case), ``texts`` distinct ``text`` values.
    """
    near = candidates(queries, texts).withColumn("distance", match_distance("wanted", "text")).where("distance is not null")
    return near.select("wanted", "text", F.when(F.col("wanted") == F.col("text"), F.lit(EQUAL))
                       .otherwise(F.greatest("distance", F.lit(NEAR))).alias("distance"))


def share(field: Column, text: Column, distance: Column) -> Column:
    """What a matching field adds: the negative logarithm of its distance, weighted, less for texts of many words."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return -F.log(distance) * F.try_element_at(weight, field) * F.round(F.lit(1.0) / F.sqrt(words), 3)


def contenders(matches: DataFrame, top: int) -> DataFrame:
    """Matches that can still lead into the best ``top``; exact, nothing that could win is lost.

    A church holding a matching text scores at least that field's share, so the field
    alone shows which score ``top`` churches reach for sure.  A match whose best possible
    total stays below that score cannot win.
    """
    levels = matches.groupBy("wanted", "field", "share").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("wanted", "field").orderBy(F.desc("share"))
    sure = levels.withColumn("reached", F.sum("n").over(down)).groupBy("wanted").agg(
        F.coalesce(F.max(F.when(F.col("reached") >= top, F.col("share"))), F.lit(0.0)).alias("sure"))
    best = levels.groupBy("wanted", "field").agg(F.max("share").alias("best"))
    total = best.groupBy("wanted").agg(F.sum("best").alias("total"))
    bound = F.col("share") + F.col("total") - F.col("best")
    return (matches.join(best, ["wanted", "field"]).join(total, "wanted").join(sure, "wanted")
            .where(bound + 1e-9 >= F.col("sure")).select("wanted", "field", "text", "share"))


def search(queries: DataFrame, church: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, church_id, score) of the best ``top`` churches per query; the smallest score is the best."""
    asked = queries.select("query_id", F.lower(strip(F.col("query"))).alias("wanted")).where(F.length("wanted") >= MIN_QUERY)
    fields = field_texts(church)
    texts = fields.groupBy("field", "text").agg(F.count(F.lit(1)).alias("n"))
    near = text_matches(asked, texts.select("text").distinct())
    matches = written(near.join(texts, "text").select("wanted", "field", "text", "n", share(
        F.col("field"), F.col("text"), F.col("distance")).alias("share")), "text-matches")
    hits = fields.join(contenders(matches, top), ["field", "text"])
    per_church = hits.groupBy("wanted", "church_id").agg(F.round(F.sum("share"), 9).alias("total"))
    best = Window.partitionBy("wanted").orderBy(F.desc("total"), "church_id")
    ranked = per_church.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return asked.join(ranked, "wanted").select("query_id", "rank", "church_id", F.round(F.exp(-F.col("total")), 6).alias("score"))
