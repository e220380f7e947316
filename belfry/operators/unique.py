"""First-wins and last-wins deduplication with explicit input order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.session import written


def _winner(df: DataFrame, keys: list[str], idx: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.col(idx))
    return df.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """The earliest row of each key; rows with a null in the key are dropped."""
    return _winner(df.dropna(subset=keys), keys, idx, F.min_by)


def last_wins(df: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """The latest row of each key; rows with a null in the key are dropped."""
    return _winner(df.dropna(subset=keys), keys, idx, F.max_by)


def first_wins_null_free(df: DataFrame, keys: list[str], nullable: str, idx: str = "idx") -> DataFrame:
    """First wins, but rows whose ``nullable`` key part is null never conflict."""
    return first_wins(df, keys, idx).unionByName(df.where(F.col(nullable).isNull()))


def greedy_unique(df: DataFrame, key_a: str, key_b: str, required: list[str], idx: str = "idx") -> DataFrame:
    """Insert-or-ignore under two unique keys: a refused row does not claim its other key.

    Rows alone under both keys are accepted at once; only the others, and of them only ``idx`` and the keys, go
    through rounds.  A round accepts the rows that come first under both keys among the undecided ones,
    refuses those that share a key with an accepted row, and writes what is left once, together with what
    it accepted.  Which rows win depends on their order, so a chain of conflicts of n rows needs up to n / 2
    rounds; conflicts in no particular order need about log n.
    """
    usable = df.dropna(subset=[key_a, key_b, *required])
    narrow = usable.select(idx, F.col(key_a).alias("a"), F.col(key_b).alias("b"))
    repeated = [narrow.groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(k, F.lit(True).alias(f"many_{k}")) for k in "ab"]
    marked = written(narrow.join(repeated[0], "a", "left").join(repeated[1], "b", "left").select(
        idx, "a", "b", (F.col("many_a").isNull() & F.col("many_b").isNull()).alias("won")), "keys")
    accepted, undecided = [marked.where("won").select(idx)], marked.where("not won")
    while not undecided.isEmpty():
        firsts = [undecided.groupBy(k).agg(F.min(idx).alias(f"first_{k}")) for k in "ab"]
        judged = undecided.join(firsts[0], "a").join(firsts[1], "b").withColumn(
            "won", (F.col(idx) == F.col("first_a")) & (F.col(idx) == F.col("first_b")))
        # a key is taken if its first row won: the row that is first under one key may still lose under the other
        taken = [judged.where("won").select(k, F.lit(True).alias(f"taken_{k}")) for k in "ab"]
        left = judged.join(taken[0], "a", "left").join(taken[1], "b", "left").where(
            F.col("won") | (F.col("taken_a").isNull() & F.col("taken_b").isNull())).select(idx, "a", "b", "won")
        left = written(left, "undecided")
        accepted.append(left.where("won").select(idx))
        undecided = left.where("not won")
    return usable.join(reduce(DataFrame.unionByName, accepted), idx, "left_semi").select(*df.columns)
