"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All word n-grams of the corpus meet those of the test items in an equality join, and every hit is a seed: no
gram is left out for being frequent.  (With acceptance from half the score on, a third of an item's words may be
replaced, which can break all grams but the most frequent one; rarer seeds alone would lose such copies.)  A document's seed hits that lie near one another form a region, which
is aligned with the item if it holds enough of the item's words to be accepted; the score is the best local
alignment over the item's length.  A copy that shares no whole n-gram with its item is not found.

Edge cases: null texts have no words; items of fewer than ``GRAM`` words cannot be seeded and are never
reported; items or documents without id are reported with a null id; repeated document rows each
get their rows, repeated item ids are reported once with their best score; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from belfry.operators.keyfilter import likely, with_likely
from belfry.session import written

GRAM = 4
PIECE = 1 << 14  # words of a region aligned at once, so that very long regions need bounded memory
ACCEPT = 0.5
MISMATCH = GAP = 0.5
WORDS = r"[\p{L}\p{N}]+"
LEAK = "doc_id string, item_id long, score double, first_word long, last_word long"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0))


def _grams(words: str) -> Column:
    """Hash per start; the last ``GRAM - 1`` starts have none."""
    return F.transform(words, lambda w, i: F.when(
        i <= F.size(words) - GRAM, F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, GRAM)])))


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def align(region: list[str], item: list[str]) -> tuple[float, int, int]:
    """Best local alignment (match 1, mismatch and gap -0.5): score, first and last matched place in ``region``."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([codes.get(w, -1) for w in region])
    ramp = np.arange(len(a) + 1) * GAP
    above = np.zeros(len(a) + 1)
    table = [above]
    for w in item:
        step = np.where(a == codes[w], 1.0, -MISMATCH)
        row = np.zeros(len(a) + 1)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + step, above[1:] - GAP))
        row = np.maximum(row, np.maximum.accumulate(row + ramp) - ramp)
        table.append(row)
        above = row
    grid = np.array(table)
    i, j = np.unravel_index(int(grid.argmax()), grid.shape)
    best, last, first = float(grid[i, j]), j - 1, j - 1
    while i and j and grid[i, j] > 0:
        step = 1.0 if a[j - 1] == codes[item[i - 1]] else -MISMATCH
        if grid[i, j] == grid[i - 1, j - 1] + step:
            i, j, first = i - 1, j - 1, j - 1
        elif grid[i, j] == grid[i - 1, j] - GAP:
            i -= 1
        else:
            j -= 1
    return best, int(first), int(last)


def best_alignment(words: list[str], low: int, high: int, item: list[str], accept: float, piece: int = PIECE) -> tuple[float, int, int] | None:
    """Best accepted alignment of ``item`` with words low .. high: score over the item's length, first and last matched word.

    An accepted alignment has fewer than two unmatched words per missing point, so it spans at most three items'
    length; pieces overlap by as much.  None: no more words in common than would be rejected, or no accepted alignment.
    """
    best, need = None, Counter(item)
    overlap = 3 * len(item)
    for at in range(low, max(low, min(high, len(words)) - overlap) + 1, piece):
        region = words[at:min(high, at + piece + overlap)]
        held = Counter(w for w in region if w in need)
        if sum(min(n, need[w]) for w, n in held.items()) / len(item) < accept:
            continue
        score, first, last = align(region, item)
        if score / len(item) >= accept and (best is None or score / len(item) > best[0]):
            best = score / len(item), at + first, at + last
    return best


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, item_words, low, high): regions of distinct texts worth aligning."""
    tests = items.select("item_id", F.col("text")).distinct().select("item_id", _words("text").alias("item_words"))
    places = tests.select("item_id", "item_words", F.posexplode(_grams("item_words")).alias("item_at", "h")).where("h is not null")
    places = written(places.select("item_id", "item_words", "item_at", "h"), "item-grams")
    grams = (docs.where(F.length("text") > 0).select(_key().alias("key"), _words("text").alias("words"))
             .select("key", F.posexplode(_grams("words")).alias("at", "h")).where("h is not null"))
    hits = grams.join(places.select("h").distinct(), "h", "left_semi")
    met = (hits.join(places, "h")
           .groupBy("key", "item_id", "item_words", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.lit(1).alias("one")))
    order = Window.partitionBy("key", "item_id", "item_words").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.size("item_words")).cast("int"), F.lit(1))
    return (met.withColumn("new", new).withColumn("region", F.sum("new").over(order))
            .groupBy("key", "item_id", "item_words", "region")
            .agg((F.min("diagonal") - F.size("item_words")).alias("low"), (F.max("diagonal") + 2 * F.size("item_words")).alias("high")))


def leaks(docs: DataFrame, items: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, score, first_word, last_word."""
    return _aligned(docs, items, accept).withColumn("doc_id", F.col("doc_id").cast("long"))


def _aligned(docs: DataFrame, items: DataFrame, accept: float) -> DataFrame:
    """The same with the id as text (pandas would turn a long column with nulls into doubles)."""
    per_text = written(candidates(docs, items).groupBy("key").agg(
        F.collect_list(F.struct("item_id", "item_words", "low", "high")).alias("regions")), "leak-regions")
    # texts without a region cannot pass the bitmap of the regions' keys, so only few texts move
    work = likely(docs.select("doc_id", "text", _key().alias("key")), per_text, "key").join(per_text, "key").select(
        F.col("doc_id").cast("string").alias("doc_id"), _words("text").alias("words"), "regions")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, words, regions in zip(batch["doc_id"], batch["words"], batch["regions"]):
                best: dict = {}
                words = list(words)
                for r in regions:
                    low, item = max(0, int(r["low"])), list(r["item_words"])
                    found = best_alignment(words, low, int(r["high"]), item, accept)
                    if found and found[0] > best.get(r["item_id"], (0,))[0]:
                        best[r["item_id"]] = found
                rows += [(doc_id, item_id, *found) for item_id, found in best.items()]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "first_word", "last_word"])
            yield out.astype({"doc_id": object, "item_id": "Int64"})

    return work.mapInPandas(aligned, LEAK)


def without_leaks(docs: DataFrame, items: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Documents in which no item was found; rows of equal text share their fate, extra columns travel unchanged."""
    texts = docs.select(F.hex(_key()).alias("doc_id"), "text")
    found = written(_aligned(texts, items, accept).select(F.unhex("doc_id").alias("__text_key")).distinct(), "leaked-texts")
    flagged = with_likely(docs.withColumn("__key", _key()), found, "__key", "__text_key", "__likely")
    clean = flagged.where("not __likely")
    doubtful = flagged.where("__likely").join(found, F.col("__key") == F.col("__text_key"), "left_anti")
    return clean.unionByName(doubtful).select(*[F.col(c) for c in docs.columns])
