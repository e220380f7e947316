"""Which windows of a corpus occur more than once: packed runs of windows that share a minimiser.

Every window has a minimiser (the smallest hash of its grams, leftmost on ties).  Its key is that gram's
hash with the coarse place of the gram in the window, so equal windows always have equal keys.
Neighbouring windows with one key travel as one string.  Equal strings are counted before they move
(so a group of copies is one row), only keys that hold two different strings are compared, and only
those strings are fetched.  A key with more than ``HEAVY`` bytes of different strings (a passage beside
very many contexts) is not judged in one task: digests of its single windows are counted by an aggregation,
in which equal windows agree and others part.  Nothing is sampled or capped.

Rows are known by the digest of their whole text, so null or repeated ids do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.session import written

BLOCK = 1 << 20   # windows handled at once, so that very long texts need bounded memory
MAX_RUN = 2048    # windows in one string
SHARD = 1 << 19   # bytes compared at once (and one key more, of HEAVY bytes at most)
HEAVY = 1 << 20   # bytes of different strings of one key, above which its windows are counted one by one
ROWS, BYTES = 10_000, 4 << 20  # rows and bytes of strings in one batch that leaves a task
RUN = "text_key binary, start long, size int, key long, looped boolean, digest binary, bytes int"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (fixed multipliers of a public mixing function)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive units (64-bit values): a polynomial, put together from doubled pieces by the bits of ``k``."""
    n = len(units) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out, done = np.zeros(n, dtype=np.uint64), 0
    piece, size, factor = units, 1, int(MULTIPLIER)  # of every ``size`` units; the multiplier to the power ``size``
    while True:
        if k & size:
            out = out * np.uint64(factor) + piece[done:done + n]
            done += size
        if 2 * size > k:
            return mixed(out)
        piece = piece[:-size] * np.uint64(factor) + piece[size:]
        size, factor = 2 * size, factor * factor & 0xFFFFFFFFFFFFFFFF


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every ``width`` consecutive values, the leftmost on ties (len <= 2**30)."""
    n = len(values)
    packed = (values >> np.uint64(30) << np.uint64(30)) | np.arange(n, dtype=np.uint64)
    total = -(-n // width) * width
    grid = np.full(total, np.iinfo(np.uint64).max)
    grid[:n] = packed
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1:width - 1 + m]) & np.uint64((1 << 30) - 1)).astype(np.int64)


def runs(units: np.ndarray, window: int, k: int, coarse: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first window, number of windows, key, looped) of every run of one text.

    A run keeps one minimiser position unless the text loops; only then can it hold a window twice.
    """
    last = len(units) - window + 1
    for low in range(0, max(last, 0), BLOCK):
        high = min(last, low + BLOCK)
        grams = gram_hashes(units[low:high + window - 1], k)
        at = _leftmost_minima(grams, window - k + 1)
        place = (at - np.arange(len(at))) // coarse
        keys = mixed(grams[at] + place.astype(np.uint64)).view(np.int64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = np.r_[0, cuts, len(keys)].tolist()
        for a, b in zip(bounds, bounds[1:]):
            key = int(keys[a])
            for first in range(a, b, MAX_RUN):
                n = min(MAX_RUN, b - first)
                yield low + first, n, key, bool(at[first] != at[first + n - 1])


def _window_digests(string: bytes, windows: Callable, window: int) -> np.ndarray:
    """128-bit digest of every window of a string, as two signed integers each."""
    raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in windows(string, window))
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)


def _place_ranges(lists: pd.Series) -> pd.Series:
    """[first, last) ranges, flat, of the places in each list."""
    out = []
    for p in lists:
        p = np.sort(np.asarray(p, dtype=np.int64))
        cuts = np.flatnonzero(np.diff(p) > 1)
        out.append(np.stack([p[np.r_[0, cuts + 1]], p[np.r_[cuts, len(p) - 1]] + 1], axis=1).ravel().tolist())
    return pd.Series(out, dtype=object)


def _counted_windows(contents: DataFrame, windows: Callable, window: int) -> DataFrame:
    """(key, digest, spans) of the strings held once, by counting all windows of all strings of ``contents``."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.iloc[low:low + 1000]
                pairs = [_window_digests(bytes(t), windows, window) for t in part["string"]]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "digest": part["digest"].to_numpy(), "once": (part["n"] == 1).to_numpy(),
                                    "a": [p[:, 0] for p in pairs], "b": [p[:, 1] for p in pairs]})

    ranges = F.pandas_udf(_place_ranges, "array<int>")
    hashed = written(contents.mapInPandas(digests, "key long, digest binary, once boolean, a array<long>, b array<long>"), "heavy-windows")
    each = hashed.select("key", "digest", "once", F.posexplode(F.arrays_zip("a", "b")).alias("at", "h")).select(
        "key", "digest", "once", "at", "h.a", "h.b")
    again = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    return (each.where("once").join(again, ["a", "b"], "left_semi").groupBy("key", "digest").agg(F.collect_list("at").alias("places"))
            .select("key", "digest", ranges("places").alias("spans")))


def _true_ranges(mask: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edges.tolist()


def wanted_strings(batches: Iterator[pd.DataFrame], cut: Callable, pack: Callable, window: int) -> Iterator[pd.DataFrame]:
    """The strings that each text is asked for; one batch holds those of many texts."""
    names = ["key", "digest", "n", "string"]
    rows, size = [], 0
    for batch in batches:
        for value, wants in zip(batch["text"], batch["wants"]):
            parts = cut(value)
            for w in wants:
                string = pack(parts, int(w["start"]), int(w["size"]) + window - 1)
                rows.append((w["key"], w["digest"], w["n"], string))
                size += len(string)
                if len(rows) >= ROWS or size >= BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
    yield pd.DataFrame(rows, columns=names)


def repeated_windows(docs: DataFrame, cut: Callable, hashed: Callable, pack: Callable, judge: Callable, windows: Callable,
                     window: int, k: int, coarse: int, shortest: int, text: str = "text") -> DataFrame:
    """(text_key, spans): per distinct text the [first, last) ranges of repeated window starts, flat, in no order.

    ``cut(text) -> parts``, ``hashed(parts) -> unit hashes``, ``pack(parts, first, size) -> bytes`` is the string of units first ..
    first + size, and ``judge(strings, window)`` marks per string the starts whose window occurs again among them;
    ``windows(string, window)`` lists the windows of one string as bytes.  Texts of fewer than ``shortest`` bytes hold no window.
    """

    columns = [c.split(" ")[0] for c in RUN.split(", ")]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key_of_text, value in zip(batch["text_key"], batch["text"]):
                parts = cut(value)
                for first, n, key, looped in runs(hashed(parts), window, k, coarse):
                    raw = pack(parts, first, n + window - 1)
                    rows.append((key_of_text, first, n, key, looped, hashlib.blake2b(raw, digest_size=16).digest(), len(raw)))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    texts = docs.select(text_key(text).alias("text_key"), F.col(text).alias("text")).where(F.octet_length("text") >= shortest)
    raw_runs = written(texts.mapInPandas(found, RUN), "runs")
    # a key seen once cannot repeat: counting keys alone is narrow, and most runs end here
    again = raw_runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("looped").alias("loops")).where("n > 1 or loops").select("key")
    every = written(raw_runs.join(again, "key", "left_semi"), "repeated-runs")
    strings = written(every.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("looped").alias("looped"), F.max("bytes").alias("bytes"), F.min(F.struct("text_key", "start", "size")).alias("at")), "run-strings")
    # only keys with two or more different strings, or with a looping one, need their contents
    shared = written(strings.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("looped").alias("looped"), F.sum("bytes").alias("bytes"))
                     .where("kinds > 1 or looped").select("key", (F.col("bytes") > HEAVY).alias("heavy")), "shared-keys")
    wanted = (strings.join(shared.select("key"), "key", "left_semi")
              .select("key", "digest", "n", "at.*").withColumnRenamed("text_key", "wanted_key"))
    # one holder per distinct text hands out its strings
    wants = wanted.groupBy("wanted_key").agg(F.collect_list(F.struct("key", "digest", "n", "start", "size")).alias("wants"))

    def handed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return wanted_strings(batches, cut, pack, window)

    contents = (texts.join(wants, F.col("text_key") == F.col("wanted_key")).select("text", "wants")
                .mapInPandas(handed, "key long, digest binary, n long, string binary")
                .dropDuplicates(["key", "digest"]))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(batch["key"], batch["digest"], batch["n"], batch["string"]):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield verdicts(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield verdicts(held)

    def verdicts(held: list[tuple]) -> pd.DataFrame:
        rows = [(key, digest, _true_ranges(mask))
                for (key, digest, n, _), mask in zip(held, judge([bytes(h[3]) for h in held], window)) if n == 1]
        return pd.DataFrame([r for r in rows if r[2]], columns=["key", "digest", "spans"])

    heavy = shared.where("heavy").select("key")
    counted = None
    if not heavy.isEmpty():
        contents = written(contents, "run-contents")
        counted = _counted_windows(contents.join(heavy, "key", "left_semi"), windows, window)
        contents = contents.join(heavy, "key", "left_anti")
    partly = (contents.repartition("key").sortWithinPartitions("key")
              .mapInPandas(judged, "key long, digest binary, spans array<int>"))
    # strings seen twice or more are repeated from end to end
    fully = strings.where("n > 1").select("key", "digest", F.lit(None).cast("array<int>").alias("spans"))
    verdicts_of_all = partly.unionByName(fully) if counted is None else partly.unionByName(fully).unionByName(counted)
    verdict = written(verdicts_of_all, "run-verdicts")
    marked = every.join(verdict, ["key", "digest"]).select("text_key", "start", "size", "spans").distinct()
    spans = F.coalesce("spans", F.array(F.lit(0), F.col("size")))
    return (marked.withColumn("spans", F.transform(spans, lambda x: x + F.col("start")))
            .groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def text_key(text: str = "text"):
    """128-bit digest of the whole text (null: empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


def covered(n: int, spans, window: int) -> np.ndarray:
    """Units covered by the windows that start in ``spans``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if spans is not None and len(spans):
        flat = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
        np.add.at(edge, flat[:, 0], 1)
        np.add.at(edge, flat[:, 1] + window - 1, -1)
    return np.cumsum(edge)[:n] > 0
