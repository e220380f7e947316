"""Ranked lexical search by pipelined term partitioning.

Every task turns its documents into blocks: a directory (ids and lengths) and one posting row per term that an
item may hold (a bitmap of fixed size, made from the items, leaves out most others).  Terms have ``len(OWNERS)``
owners, rarest terms first.  Bundles of items pass from owner to owner; for every (bundle, block) a cogroup
joins the sparse accumulators of the bundle's items with the owner's postings and adds the integer
contributions.  After each owner only documents stay that can still reach the ten best of their block: the
contributions that later owners can add to an item are bounded by its weights, so nothing is lost.  The
ten best of every block are merged by an ordinary top-k.

Edge cases: null and empty texts have no terms and are not found; each document row is a document, repeated rows
are ranked each; documents without doc_id take part and come last among equal scores; equal item rows count once,
an id with several texts is ranked for each; items without a term of the corpus have no rows; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belfry.session import scratch_path, written

BEST = 10
K1, NORM, KEPT = 1000, 8, 75            # of the score: see contributions() and gains
TOP = 10 ** 9                           # a contribution's numerator per occurrence
MOST = TOP // K1                        # no occurrence count brings more than this
OWNERS = (64, 8, 2, 1)                  # owner i has the terms in at most one document of so many; the last one the rest
BITMAP = 1 << 20                        # bits; more item terms only make it less selective
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 500_000
BUNDLE = 256                            # items carried together
SALTS = 64                              # parts of the postings of one term while they meet the items
#: every byte that can stand in a term, lower-cased; all others are spaces
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LETTERS).split()


def contributions(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one point of weight brings in documents of these occurrence counts and lengths."""
    m = 100 - KEPT + (KEPT * lengths.astype(np.int64) * n_docs) // n_terms
    return (TOP * counts.astype(np.int64)) // (K1 * counts.astype(np.int64) + NORM * m)


def bundled(items: DataFrame) -> DataFrame:
    """Different items with the bundle they belong to and their number in it."""
    rows = items.select("item_id", F.col("text").alias("item_text")).distinct()
    bundles = max(1, -(-rows.count() // BUNDLE))
    place = Window.partitionBy("bundle").orderBy("item_id", "item_text")
    dealt = rows.withColumn("bundle", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(bundles)).cast("int"))
    return written(dealt.withColumn("number", F.row_number().over(place)), "items")


def item_terms(items: DataFrame) -> DataFrame:
    """(bundle, number, term, times) of every term of every item."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bundle, number, found, times = [], [], [], []
            for b, n, text in zip(*(batch.column(c).to_pylist() for c in ("bundle", "number", "item_text"))):
                held = Counter(terms(text))
                bundle += [b] * len(held)
                number += [n] * len(held)
                found += held.keys()
                times += held.values()
            yield pa.RecordBatch.from_arrays([pa.array(bundle, pa.int32()), pa.array(number, pa.int32()), pa.array(found, pa.binary()),
                                              pa.array(times, pa.int64())], names=["bundle", "number", "term", "times"])

    return written(items.select("bundle", "number", "item_text").mapInArrow(counted, "bundle int, number int, term binary, times long"), "item-terms")


def bitmap(wanted: DataFrame) -> bytes:
    """Which term hashes the items hold; at most ``BITMAP`` bits reach the driver."""
    places = wanted.select(F.pmod(F.crc32("term"), F.lit(BITMAP)).alias("at")).distinct().collect()
    bits = np.zeros(BITMAP, dtype=np.uint8)
    bits[[r["at"] for r in places]] = 1
    return np.packbits(bits).tobytes()


POSTINGS = "block long, term binary, docs array<int>, counts array<int>, ids array<long>, n_docs long, n_terms long"


class Block:
    """Documents of one task, gathered until they are enough for a block."""

    def __init__(self, bits: bytes, most_docs: int, most_postings: int):
        self.bits = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).tobytes()
        self.most_docs, self.most_postings = most_docs, most_postings
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.places: list[int] = []
        self.docs: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        words, doc, bits, numbers = terms(text), len(self.ids), self.bits, self.numbers
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        held = [(w, n) for w, n in Counter(words).items() if bits[crc32(w) % len(bits)]]
        self.places += [numbers.setdefault(w, len(numbers)) for w, _ in held]
        self.counts += [n for _, n in held]
        self.docs += [doc] * len(held)

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or len(self.docs) >= self.most_postings

    def rows(self, block: int) -> pa.RecordBatch:
        """The directory (term null) and the posting rows."""
        place = np.array(self.places, dtype=np.int64)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(len(self.numbers) + 1)).astype(np.int32)
        lengths = np.array(self.lengths, dtype=np.int32)
        sizes = np.r_[0, len(lengths), len(lengths) + bounds[1:]].astype(np.int32)

        def lists(directory: np.ndarray, postings: list[int]) -> pa.Array:
            flat = np.concatenate([directory, np.array(postings, dtype=np.int32)[order]]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))

        rest = [None] * len(self.numbers)
        names = [c.split(" ")[0] for c in POSTINGS.split(", ")]
        return pa.RecordBatch.from_arrays([
            pa.array([block] * (len(rest) + 1), pa.int64()), pa.array([None, *self.numbers], pa.binary()),
            lists(np.arange(len(lengths)), self.docs), lists(lengths, self.counts), pa.array([self.ids, *rest], pa.list_(pa.int64())),
            pa.array([int((lengths > 0).sum()), *rest], pa.int64()), pa.array([int(lengths.sum(dtype=np.int64)), *rest], pa.int64())], names=names)


def postings(docs: DataFrame, bits: bytes) -> DataFrame:
    """Directories and posting rows of all documents, written once."""
    most_docs, most_postings = BLOCK_DOCS, BLOCK_POSTINGS

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        block = Block(bits, most_docs, most_postings)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                block.add(doc_id, text.as_py())
                if block.full():
                    yield block.rows(number)
                    number += 1
                    block.clear()
        if block.ids:
            yield block.rows(number)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks, POSTINGS), "postings")


def weighted(wanted: DataFrame, posted: DataFrame, n_docs: int) -> DataFrame:
    """(term, owner, bundle, gains): the term's gain for every item of the bundle, and what later owners can add to the item."""
    df = posted.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    owner = F.lit(len(OWNERS) - 1)
    for i in reversed(range(len(OWNERS) - 1)):
        owner = F.when(F.col("df") * OWNERS[i] <= n_docs, F.lit(i)).otherwise(owner)
    known = (wanted.join(df, "term").select("bundle", "number", "term", owner.alias("owner"), (F.col("times") * weight).alias("gain"))
             .where("gain > 0"))
    item = Window.partitionBy("bundle", "number").orderBy("owner").rangeBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.sum("gain").over(item), F.lit(0)) * MOST
    return written(known.withColumn("later", later).groupBy("term", "owner", "bundle").agg(
        F.collect_list(F.struct("number", "gain", "later")).alias("gains")), "term-gains")


def _hits(posted: DataFrame, gains: DataFrame) -> str:
    """Path of the posting rows that items ask for, by owner; a frequent term's rows are dealt over ``SALTS`` tasks."""
    salted = posted.where("term is not null").select("block", "term", "docs", "counts", F.pmod(F.hash("block"), F.lit(SALTS)).alias("salt"))
    asked = gains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    path = scratch_path(posted.sparkSession, "term-hits")
    (salted.join(asked, ["term", "salt"]).select("owner", "bundle", "block", "docs", "counts", "gains")
     .write.partitionBy("owner").parquet(path))
    return path


HITS = "bundle int, block long, docs array<int>, counts array<int>, gains array<struct<number:int,gain:long,later:long>>, owner int"
STATE = "bundle int, block long, number int, docs array<int>, scores array<long>"
FOUND = "bundle int, number int, doc_id long, score long"


def _best_first(scores: np.ndarray, ids: list, docs: np.ndarray) -> list[int]:
    order = sorted(range(len(docs)), key=lambda i: (-scores[i], ids[docs[i]] is None, ids[docs[i]] or 0))
    return order[:BEST]


def owner_stage(n_docs: int, n_terms: int, last: bool):
    """One owner's cogroup function: accumulators (number 0: the directory) and postings of one bundle and block."""

    def run(state: pa.Table, hits: pa.Table) -> pa.Table:
        numbers = state.column("number").to_pylist()
        at = numbers.index(0)
        lengths = np.array(state.column("docs")[at].values, dtype=np.int64)
        ids = state.column("scores")[at].as_py()
        key = state.column("bundle")[0].as_py(), state.column("block")[0].as_py()
        sums: dict[int, np.ndarray] = {}
        for i, number in enumerate(numbers):
            if number:
                held = sums[number] = np.zeros(len(ids), dtype=np.int64)
                held[np.array(state.column("docs")[i].values)] = np.array(state.column("scores")[i].values)
        later: dict[int, int] = {}
        for i in range(hits.num_rows):
            docs = np.array(hits.column("docs")[i].values)
            points = contributions(np.array(hits.column("counts")[i].values), lengths[docs], n_docs, n_terms)
            for gain in hits.column("gains")[i].as_py():
                held = sums.get(gain["number"])
                if held is None:
                    held = sums[gain["number"]] = np.zeros(len(ids), dtype=np.int64)
                held[docs] += gain["gain"] * points
                later[gain["number"]] = gain["later"]
        rows = []
        for number, held in sums.items():
            docs = np.flatnonzero(held)
            if number in later and len(docs) > BEST:
                enough = np.partition(held[docs], len(docs) - BEST)[len(docs) - BEST]
                docs = docs[held[docs] + later[number] >= enough]
            rows.append((number, docs, held[docs]))
        if last:
            best = [(number, ids[docs[i]], int(scores[i])) for number, docs, scores in rows for i in _best_first(scores, ids, docs)]
            number, doc_id, score = zip(*best) if best else ((), (), ())
            return pa.table({"bundle": pa.array([key[0]] * len(best), pa.int32()), "number": pa.array(number, pa.int32()),
                             "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64())})
        size = len(rows) + 1
        return pa.table({"bundle": pa.array([key[0]] * size, pa.int32()), "block": pa.array([key[1]] * size, pa.int64()),
                         "number": pa.array([0, *(r[0] for r in rows)], pa.int32()),
                         "docs": pa.array([lengths, *(r[1] for r in rows)], pa.list_(pa.int32())),
                         "scores": pa.array([ids, *(r[2] for r in rows)], pa.list_(pa.int64()))})

    return run


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten highest-scoring documents of every item."""
    spark = docs.sparkSession
    known = bundled(items)
    wanted = item_terms(known)
    posted = postings(docs, bitmap(wanted))
    totals = posted.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    n_docs, n_terms = totals["n_docs"] or 0, totals["n_terms"] or 0
    path = _hits(posted, weighted(wanted, posted, n_docs))
    hits = spark.read.schema(HITS)
    met = hits.parquet(path).select("bundle", "block").distinct()
    state = (posted.where("term is null").join(met, "block")
             .select("bundle", "block", F.lit(0).alias("number"), F.col("counts").alias("docs"), F.col("ids").alias("scores")))
    for owner in range(len(OWNERS)):
        last = owner == len(OWNERS) - 1
        owned = hits.parquet(path).where(F.col("owner") == owner).drop("owner")
        state = (state.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block"))
                 .applyInArrow(owner_stage(n_docs, n_terms, last), FOUND if last else STATE))
    order = Window.partitionBy("bundle", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return best.join(known.select("bundle", "number", "item_id"), ["bundle", "number"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
