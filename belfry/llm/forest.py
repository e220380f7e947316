"""Nearest neighbours by a hash-prefix forest.

Each block of rows holds ``trees`` sorted arrays of long hash strings (signs of random projections).  A
query descends every tree of the block to the longest prefix it shares with some row; all trees then
ascend together, one bit at a time, until the rows under their prefixes are enough, and those are
scored exactly in double precision.  Queries meet the row blocks in blocks of their own; every block
passes on its best ``k`` only.

Edge cases: vectors that are null, of zero length, of another dimension than most, or hold null or
non-finite components take no part; rows without vec_id take no part; repeated rows (same id and vector) count
once, an id with several vectors is a candidate with each; with fewer than ``k`` candidates all are returned; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belfry.session import written

TREES = 24
BITS = 32
ENOUGH = 1.0     # rows under all prefixes together, as a share of the block (a row counts once per tree)
BLOCK_ROWS = 16_384
QUERY_ROWS = 4096
K = 20
SEED = 20_24


def planes(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((trees * bits, dim))


def hash_strings(vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """trees x rows; the first bit of a string is its highest."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = (unit @ planes(vectors.shape[1], trees, bits).T > 0).reshape(len(vectors), trees, bits)
    return (signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).T


class Forest:
    def __init__(self, vectors: np.ndarray):
        hashes = hash_strings(vectors)
        self.vectors = vectors
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def near(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Row numbers under each query's prefixes at the longest common level that reaches ``enough`` rows."""
        hashes = hash_strings(queries)
        low = np.zeros((len(hashes), len(queries)), dtype=np.int64)
        high = np.zeros_like(low)
        open_ = np.arange(len(queries))
        for length in range(BITS, -1, -1):
            shift = BITS - length
            for t, rows in enumerate(self.sorted):
                prefix = hashes[t, open_] >> shift << shift
                low[t, open_] = np.searchsorted(rows, prefix)
                high[t, open_] = np.searchsorted(rows, prefix + (1 << shift))
            open_ = open_[(high - low)[:, open_].sum(axis=0) < enough]
            if not len(open_):
                break
        for i in range(len(queries)):
            yield np.unique(np.concatenate([self.order[t, low[t, i]:high[t, i]] for t in range(len(hashes))]))


def clean_vectors(df: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return (df.where(F.col("vec_id").isNotNull() & ok & F.exists(x, lambda v: v != 0))
            .select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"]))


def nearest(df: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    vectors = written(clean_vectors(df), "vectors")
    common = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("embedding") == common["d"])
    total = vectors.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = vectors.where(F.col("vec_id") % every == 0)
    portions = max(1, -(-total // (every * QUERY_ROWS)))
    queries = (asked.withColumn("portion", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(portions)).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    rows = rows.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))

    def searched(_, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(wanted):
            ids = held["vec_id"].to_numpy()
            forest = Forest(np.stack(held["embedding"].to_numpy()).astype(np.float64))
            asked_ids, asked_rows = wanted["vec_id"].to_numpy(), np.stack(wanted["embedding"].to_numpy()).astype(np.float64)
            enough = max(20 * k, int(ENOUGH * len(ids)))
            for one, vector, found in zip(asked_ids, asked_rows, forest.near(asked_rows, enough)):
                found = found[ids[found] != one]
                scores = forest.vectors[found] @ vector
                best = np.lexsort((ids[found], -scores))[:k]
                out.append(pd.DataFrame({"query_id": one, "vec_id": ids[found][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    part = ["block", "portion"]
    found = (rows.groupBy(*part).cogroup(queries.groupBy(*part))
             .applyInPandas(searched, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
