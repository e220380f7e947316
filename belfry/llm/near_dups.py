"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Every shingle (five words) is a weighted element.  Darts are thrown by hash into cells of the element's
weight and a rank, cell by cell in growing rank, until every coordinate of the signature is hit; a
coordinate keeps its dart of least rank.  The number of darts per text depends on the signature's length
only, so long texts cost little more than hashing their shingles.  Weights default to one per different
shingle (the weighted similarity is then the Jaccard similarity of the shingle sets); ``counted`` weighs
by occurrence.

Texts equal in one band form a bucket.  In two rounds every bucket's members are compared with one leader,
which brings most of a group of copies into one class at n pairs per bucket.  What is then left in buckets
of more than one class is compared in blocks: a block holds a bounded number of rows and bytes, only pairs
of different classes count, members of the bucket's largest class never meet one another, and a block
returns at most one link per row.  So every pair of a bucket is either compared on whole shingle sets or
already known to be in one class: no link that the bands find is lost.

Edge cases: null text is the empty text; texts without words (empty or white space only) are one class; texts of
one to four words have one shingle, all their words; equal texts share a class; repeated rows each get their row;
extra columns are not read by ``near_dup_classes`` and travel unchanged through ``one_per_class``; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from belfry.llm.repeats import gram_hashes, mixed
from belfry.session import written

SHINGLE = 5
SIMILAR = 0.8
LENGTH = 128
BANDS = 32
LEADER_ROUNDS = 2
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20  # of one side of a block; a bucket with more is cut into several
COLUMNS = 4096  # shared shingles counted at once
FIRST_RANK = 2.0 ** -4
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"  # what separates words
HEAVY = 1000  # a text held by more than one row in so many is heavy: there are at most so many of them
ONE = np.uint64(1)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of a text, ascending, and their counts."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    return np.unique(gram_hashes(hashes, min(SHINGLE, len(words))), return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities, up to where the rest no longer matters."""
    top = int(mean + 12 * mean ** 0.5 + 12)
    k = np.arange(top)
    log_p = -mean + k * np.log(mean) - np.r_[0, np.cumsum(np.log(np.arange(1, top)))]
    return np.cumsum(np.exp(log_p))


def dart_signature(elements: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Weighted minwise signature; texts agree in a coordinate with the probability of their weighted Jaccard similarity."""
    best = np.full(length, np.inf)
    name = np.zeros(length, dtype=np.uint64)
    if not len(elements):
        return name
    layers = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(owner)) - np.repeat(np.cumsum(layers) - layers, layers)
    cell = mixed(elements[owner] + mixed(layer.astype(np.uint64) + ONE))
    enough = length * (np.log(length) + 2)  # darts that usually hit every coordinate; their levels are thrown at once
    low, level = 0.0, 0
    while True:
        ranges = []
        while not ranges or len(cell) * low < enough:
            high = low * 2 or FIRST_RANK
            ranges.append((low, high))
            low = high
        lows, highs = np.array(ranges).T
        levels = np.arange(level + 1, level + 1 + len(ranges), dtype=np.uint64)
        level += len(ranges)
        here = mixed(cell[None, :] ^ mixed(levels)[:, None])
        number = np.concatenate([np.searchsorted(_poisson(b - a), u) for (a, b), u in zip(ranges, _uniform(here))])
        source = np.repeat(np.arange(len(number)), number)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(number) - number, number)
        dart = mixed(here.ravel()[source] + mixed(nth.astype(np.uint64) + np.uint64(77)))
        at_level, at_cell = np.divmod(source, len(cell))
        rank = lows[at_level] + (highs - lows)[at_level] * _uniform(mixed(dart + ONE))
        inside = layer[at_cell] + _uniform(mixed(dart + np.uint64(2))) < weights[owner[at_cell]]
        dart, rank = dart[inside], rank[inside]
        place = (mixed(dart + np.uint64(3)) % np.uint64(length)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        place, rank, dart = place[order], rank[order], dart[order]
        better = rank < best[place]
        best[place[better]] = rank[better]  # ascending quality: the last write is the least rank
        name[place[better]] = dart[better]
        if np.isfinite(best).all():
            return name


def _has_words() -> Column:
    return F.coalesce(F.col("text").rlike(f"[^{BLANK}]"), F.lit(False))


def _key() -> Column:
    """128-bit digest of the text; all texts without words share that of the empty text."""
    text = F.when(_has_words(), F.col("text")).otherwise(F.lit(""))
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def bands(docs: DataFrame, n_bands: int = BANDS, length: int = LENGTH, counted: bool = False) -> DataFrame:
    """(bucket, key) of every different text; the bucket hashes the band's number and coordinates."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, out = [], []
            for key, text in zip(batch["key"], batch["text"]):
                elements, counts = shingles(text)
                if len(elements):
                    weights = counts.astype(float) if counted else np.ones(len(elements))
                    grid = dart_signature(elements, weights, length).reshape(n_bands, -1)
                    h = np.arange(n_bands, dtype=np.uint64)
                    for j in range(grid.shape[1]):
                        h = mixed(h ^ grid[:, j]) + ONE
                    keys.append(key)
                    out.append(h.view(np.int64))
            if keys:  # an untyped empty column would not pass as an array
                yield pd.DataFrame({"bucket": out, "key": keys})

    texts = docs.where(_has_words()).select(_key().alias("key"), "text")
    return texts.mapInPandas(signed, "bucket array<long>, key binary").select(F.explode("bucket").alias("bucket"), "key")


def _sets(texts: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "shingles": [shingles(t)[0].tobytes() for t in batch["text"]]})
    return texts.mapInPandas(hashed, "key binary, shingles binary")


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out)


def linked_roots(docs: DataFrame, similar: float = SIMILAR, counted: bool = False) -> DataFrame:
    """(key, root): every text with a verified partner and the smallest key it is connected to.

    Later rounds link the roots so far, so every round's components are those of a smaller graph.
    """
    members = written(bands(docs, counted=counted).distinct(), "dart-bands")
    many = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    open_members = written(members.join(many, "bucket", "left_semi"), "dart-open")
    involved = open_members.select("key").distinct()
    texts = docs.select(_key().alias("key"), "text").join(involved, "key", "left_semi")
    sets = written(_sets(texts).dropDuplicates(["key"]), "dart-sets")
    roots = None
    open_members = open_members.withColumn("root", F.col("key"))
    for turn in range(LEADER_ROUNDS):
        order = F.col("key") if turn == 0 else F.xxhash64("bucket", "key")  # later rounds: another leader in every bucket
        leaders = open_members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "key", "root")).alias("first"))
        met = written(open_members.join(leaders.select("bucket", F.col("first.key").alias("leader"), F.col("first.root").alias("theirs")), "bucket")
                      .where("key <> leader"), "dart-met")
        pairs = met.where("root <> theirs").select("key", "leader", "root", "theirs").distinct()
        scored = (pairs.join(sets, "key").join(sets.select(F.col("key").alias("leader"), F.col("shingles").alias("others")), "leader")
                  .where(jaccard("shingles", "others") >= similar).select(F.col("theirs").alias("a"), F.col("root").alias("b")))
        roots = _led_on(roots, components(scored))
        rest = (met.select("bucket", "key").join(roots, "key", "left")
                .select("bucket", "key", F.coalesce("root", "key").alias("root")))
        mixed_buckets = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        open_members = written(rest.join(mixed_buckets, "bucket", "left_semi"), "dart-open")
    return _led_on(roots, components(_block_links(open_members, sets, similar)))


def _led_on(roots: DataFrame | None, further: DataFrame) -> DataFrame:
    """(key, root) after the roots so far were connected as ``further`` (key, root) says."""
    if roots is None:
        return further
    moved = (roots.join(further.select(F.col("key").alias("root"), F.col("root").alias("beyond")), "root", "left")
             .select("key", F.coalesce("beyond", "root").alias("root")))
    return written(moved.unionByName(further.join(roots.select("key"), "key", "left_anti")), "roots")


def _block_links(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(a, b): roots of different classes of a bucket that a link joins, from all its pairs of different classes.

    Blocks of the bucket's largest class (numbered last) meet the other blocks only.
    """
    sized = members.join(sets.select("key", F.octet_length("shingles").alias("bytes")), "key")
    per_class = sized.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    top = per_class.groupBy("bucket").agg(F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(rows: Column, size: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    plan = top.select("bucket", F.col("top.root").alias("largest"), blocks(F.col("top.n"), F.col("top.bytes")).alias("inner"),
                      blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("outer"))
    of_largest, h = F.col("root") == F.col("largest"), F.xxhash64("key")
    block = F.when(of_largest, F.col("outer") + F.pmod(h, "inner")).otherwise(F.pmod(h, "outer")).cast("int")
    meets = F.sequence(F.lit(0), F.when(of_largest, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    cells = (members.join(plan, "bucket").select("bucket", "key", "root", block.alias("block"), F.explode(meets).alias("other"))
             .select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "key", "root"))
    place = ["bucket", "one", "two"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for batch in batches:
            for row in zip(*(batch[c] for c in (*place, "root", "shingles"))):
                if row[:3] != at:
                    yield linked(held)
                    held, at = [], row[:3]
                held.append(row[3:])
        yield linked(held)

    def linked(held: list[tuple]) -> pd.DataFrame:
        names = [row[0] for row in held]
        roots = np.unique(np.array([name.hex() for name in names]), return_inverse=True)[1]
        first = block_classes([np.frombuffer(row[1], dtype=np.uint64) for row in held], roots, similar)
        return pd.DataFrame({(names[r], names[i]) for i, r in enumerate(first) if roots[r] != roots[i]}, columns=["a", "b"])

    return (cells.join(sets, "key").repartition(*place).sortWithinPartitions(*place)
            .mapInPandas(compared, "a binary, b binary"))


def block_classes(sets: list[np.ndarray], known: np.ndarray, similar: float) -> np.ndarray:
    """Per set the first set it is connected to by pairs of at least ``similar`` whose ``known`` classes differ."""
    n = len(sets)
    label = np.arange(n)
    if n < 2 or len(set(known.tolist())) < 2:
        return label
    sizes = np.array([len(x) for x in sets])
    column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = counts[column] > 1
    row, column = np.repeat(np.arange(n), sizes)[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        grid = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - low)), dtype=np.float32)
        grid[row[a:b], column[a:b] - low] = 1
        both += grid @ grid.T
    union = sizes[:, None] + sizes[None, :] - both
    left, right = np.nonzero((both / np.maximum(union, 1) >= similar) & (known[:, None] != known[None, :]))
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        label = label[label]
        if (label == before).all():
            break
    return label


def components(pairs: DataFrame) -> DataFrame:
    """(key, root): every linked key with the smallest key it is connected to."""
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
                   F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))  # every key is its own neighbour too
    edges = written(pairs.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct(), "edges")
    label = written(edges.groupBy("a").agg(F.min("b").alias("root")), "roots")
    while True:
        step = (edges.join(label.select(F.col("a").alias("b"), "root"), "b").groupBy("a")
                .agg(F.min("root").alias("root"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("old")))
        jump = label.select(F.col("a").alias("root"), F.col("root").alias("beyond"))
        after = written(step.join(jump, "root").select("a", "beyond", "root", "old"), "roots")
        if after.where("beyond <> old").isEmpty():
            return label.select(F.col("a").alias("key"), "root")
        label = after.select("a", F.col("beyond").alias("root"))


def _class_texts(docs: DataFrame, similar: float, counted: bool) -> DataFrame:
    """(key, root, least, none, n) of every different text: its class, smallest id (none: it has no id), and rows."""
    roots = linked_roots(docs.select("text"), similar, counted)
    rows = docs.select("doc_id", _key().alias("key"))
    return written(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(roots, "key", "left")
                   .select("key", "least", F.col("least").isNull().alias("none"), "n", F.coalesce("root", "key").alias("root")), "class-texts")


def near_dup_classes(docs: DataFrame, similar: float = SIMILAR, counted: bool = False) -> DataFrame:
    """Per document row: doc_id, class_id (the smallest doc_id of its class; null only if all its ids are)."""
    texts = _class_texts(docs, similar, counted)
    names = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = texts.join(names, "root").select("key", "class_id", "n")
    total = texts.agg(F.sum("n")).first()[0] or 0
    rows = docs.select("doc_id", _key().alias("key"))
    # rows of texts with very many copies meet their class by a broadcast of at most HEAVY rows, not in one task
    heavy = classes.where(F.col("n") * HEAVY > total)
    of_heavy = rows.join(F.broadcast(heavy), "key")
    others = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(classes, "key")
    return of_heavy.unionByName(others).select("doc_id", "class_id")


def one_per_class(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class: of its smallest doc_id (rows without id come last), then of the smallest text digest.

    Classes are told by their texts, so different texts under one id do not replace one another.
    """
    texts = _class_texts(docs, similar, False)
    keep = texts.groupBy("root").agg(F.min(F.struct("none", "least", "key")).alias("first"))
    keep = keep.select(F.col("first.key").alias("__text_key"), F.col("first.least").alias("__least"))
    met = docs.withColumn("__key", _key()).join(keep, (F.col("__key") == F.col("__text_key")) & F.col("doc_id").eqNullSafe(F.col("__least")))
    return met.dropDuplicates(["__key"]).select(*[F.col(c) for c in docs.columns])
