"""Exact duplicates by composable polynomial fingerprints.

A text (white-space runs made one space, UTF-8) is read as the digits of a number in four fixed bases,
each modulo a prime.  The residues of two neighbouring chunks combine to those of both together: the left
ones are shifted by the length of the right one.  So a text is hashed chunk by chunk, and a text of more
than ``PIECE`` bytes is cut into rows that all tasks share, hashed apart, shifted by what follows them
and added up.  Length and residues are the fingerprint.

Equal fingerprints are not trusted: all texts of a fingerprint are compared piece by piece, by keeping the
smallest and the largest bytes of every piece, which are equal exactly if all are.  Where texts differ
although their fingerprints agree, their rows are grouped by the whole texts instead.

Fingerprints that more than one row in ``HEAVY`` holds are at most ``HEAVY`` in number, so they may be broadcast;
their rows are dealt over ``SALTS`` parts, and the parts' pieces are compared in a second step.

Edge cases: null text is the empty text; every input row gives one output row, repeated rows too, of which
one stays; rows without doc_id stay only where no equal text has one (then ``keep_id`` is null); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from belfry.session import written

# Four primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 747796405, 1664525069, 1288490209)
CHUNK = 1 << 16   # bytes hashed at once: 2**16 digits of 8 bits times residues of 31 bits stay below 2**55
PIECE = 1 << 18   # bytes in one row of a cut text
HEAVY = 1000      # a fingerprint held by more than one row in so many is heavy
SALTS = 32
KEY = ["n_bytes", "k0", "k1"]
SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"  # white-space runs that are not one space already

Residues = tuple[int, ...]


def _powers(base: int, prime: int) -> np.ndarray:
    """base**(CHUNK - 1) .. base**0, modulo the prime."""
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.uint64)


_tables: list[np.ndarray] = []


def chunk_residues(raw: bytes) -> Residues:
    """Residues of at most ``CHUNK`` bytes."""
    if not _tables:
        _tables.extend(_powers(b, p) for b, p in zip(BASES, PRIMES))
    digits = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(digits @ t[CHUNK - len(digits):]) % p for t, p in zip(_tables, PRIMES))


def shifted(residues: Residues, length: int) -> Residues:
    """Residues of a text once ``length`` more bytes follow, those bytes counted as nothing."""
    return tuple(r * pow(b, length, p) % p for r, b, p in zip(residues, BASES, PRIMES))


def combined(left: Residues, right: Residues, right_length: int) -> Residues:
    """Residues of two neighbouring byte strings together."""
    return tuple((a + b) % p for a, b, p in zip(shifted(left, right_length), right, PRIMES))


def residues(raw: bytes) -> Residues:
    """Residues of a byte string of any length, chunk by chunk."""
    out: Residues = (0,) * len(PRIMES)
    for at in range(0, len(raw), CHUNK):
        part = raw[at:at + CHUNK]
        out = combined(out, chunk_residues(part), len(part))
    return out


@F.pandas_udf(StructType([StructField("k0", LongType()), StructField("k1", LongType())]))
def fingerprint(raws: pd.Series) -> pd.DataFrame:
    rows = [residues(raw) for raw in raws]
    return pd.DataFrame([(a << 31 | b, c << 31 | d) for a, b, c, d in rows], columns=["k0", "k1"])


@F.pandas_udf(ArrayType(LongType()))
def shifted_residues(pieces: pd.Series, rest: pd.Series) -> pd.Series:
    """Residues of a piece, shifted by the bytes that follow it in its text."""
    return pd.Series([list(shifted(residues(raw), int(n))) for raw, n in zip(pieces, rest)])


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _read(docs: DataFrame, large: bool | None) -> DataFrame:
    """doc_id, text_sha256, n_bytes and the normalised bytes; of texts over ``PIECE`` bytes, of the others, or of all."""
    docs = docs.select("doc_id", "text")
    if large is not None:
        over = F.octet_length(F.coalesce("text", F.lit(""))) > PIECE
        docs = docs.where(over if large else ~over)
    raw = docs.select("doc_id", normalised().cast("binary").alias("raw"))
    return raw.select("doc_id", F.sha2("raw", 256).alias("text_sha256"), F.octet_length("raw").cast("long").alias("n_bytes"), "raw")


def _with_fingerprint(read: DataFrame) -> DataFrame:
    return read.withColumn("f", fingerprint("raw")).select("*", "f.k0", "f.k1").drop("f")


def _pieces(docs: DataFrame) -> DataFrame:
    """Rows of the texts over ``PIECE`` bytes: the text's number, its columns, the place and bytes of the piece."""
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / PIECE) - 1, F.lit(0)).cast("int"))
    cut = F.transform(places, lambda i: F.substring("raw", i * PIECE + 1, F.lit(PIECE)))
    return (_read(docs, True).withColumn("text_no", F.monotonically_increasing_id())
            .select("text_no", "doc_id", "text_sha256", "n_bytes", F.posexplode(cut).alias("at", "piece")))


def _summed(pieces: DataFrame) -> DataFrame:
    """One row per cut text: its columns and fingerprint, added up from the pieces dealt over all tasks."""
    dealt = pieces.repartition("text_no", "at")
    rest = F.col("n_bytes") - F.col("at").cast("long") * PIECE - F.octet_length("piece")
    each = dealt.withColumn("r", shifted_residues("piece", rest))
    sums = each.groupBy("text_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.first("n_bytes").alias("n_bytes"),
        *[F.pmod(F.sum(F.col("r")[i]), F.lit(p)).alias(f"r{i}") for i, p in enumerate(PRIMES)])
    return sums.select("text_no", "doc_id", "text_sha256", "n_bytes", (F.shiftleft("r0", 31) + F.col("r1")).alias("k0"),
                       (F.shiftleft("r2", 31) + F.col("r3")).alias("k1"))


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
            .select(*key, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def _differing(docs: DataFrame, pieces: DataFrame, cut: DataFrame, groups: DataFrame, heavy: DataFrame) -> DataFrame:
    """Fingerprints whose texts are not all equal, from comparing every piece of all texts with a shared fingerprint."""
    whole = _with_fingerprint(_read(docs, False)).select(*KEY, F.lit(0).alias("at"), F.col("raw").alias("piece"))
    parts = pieces.select("text_no", "at", "piece").join(cut.select("text_no", *KEY), "text_no").select(*KEY, "at", "piece")
    salt = F.when(F.col("is_heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    every = whole.unionByName(parts).join(F.broadcast(heavy), KEY, "left").withColumn("salt", salt)
    shared = groups.where("group_size > 1").select(*KEY).join(F.broadcast(heavy), KEY, "left")
    salts = F.when(F.col("is_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    met = every.join(shared.select(*KEY, F.explode(salts).alias("salt")), [*KEY, "salt"], "left_semi")
    near = met.groupBy(*KEY, "salt", "at").agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.max("is_heavy").alias("is_heavy"))
    open_ = (near.select(*KEY, "at", (F.col("low") != F.col("high")).alias("differs"), F.when(F.col("is_heavy"), F.col("low")).alias("low"))
             .where("differs or low is not null"))
    far = open_.groupBy(*KEY, "at").agg(F.max("differs").alias("differs"), F.min("low").alias("low"), F.max("low").alias("high"))
    return far.where("differs or low <> high").select(*KEY).distinct()


def exact_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256."""
    pieces = written(_pieces(docs), "text-pieces")
    cut = written(_summed(pieces), "cut-texts")
    small = _with_fingerprint(_read(docs, False)).select("doc_id", "text_sha256", *KEY)
    rows = written(small.unionByName(cut.drop("text_no")).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    groups = written(_groups(rows, KEY), "fingerprint-groups")
    total = rows.count()
    # more than one row in HEAVY each: never more than HEAVY fingerprints, so their broadcast is bounded
    heavy_groups = groups.where((F.col("group_size") > 1) & (F.col("group_size") * HEAVY > total))
    heavy = heavy_groups.select(*KEY, F.lit(True).alias("is_heavy"))
    broken = written(_differing(docs, pieces, cut, groups, heavy), "broken-fingerprints")
    trusted = rows
    by_text = None
    if not broken.isEmpty():
        trusted = rows.join(broken, KEY, "left_anti")
        groups, heavy_groups = (g.join(broken, KEY, "left_anti") for g in (groups, heavy_groups))
        again = written(_with_fingerprint(_read(docs, None)).join(broken, KEY, "left_semi")
                        .withColumn("row", F.monotonically_increasing_id()), "broken-texts")
        by_text = _named(again.join(_groups(again, ["raw"]), "raw"))
    of_heavy = _named(trusted.join(F.broadcast(heavy_groups), KEY))
    others = trusted.join(F.broadcast(heavy_groups.select(*KEY)), KEY, "left_anti")
    found = of_heavy.unionByName(_named(others.join(groups, KEY)))
    return found if by_text is None else found.unionByName(by_text)
