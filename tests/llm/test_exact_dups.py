"""Exact duplicates: fingerprints, collisions, cut texts, odd rows."""

import hashlib
import random
import re

import duckdb
import pytest

from belfry.llm import exact_dups, queries


def expected(rows):
    """doc_id, keep_id, group_size, kept, digest of every row, sorted; one row per group is kept."""
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = {}
    for i, (d, t) in enumerate(norm):
        groups.setdefault(t, []).append((d is None, d if d is not None else 0, i))
    out = []
    for i, (d, t) in enumerate(norm):
        least = min(groups[t])
        out.append((d, None if least[0] else least[1], len(groups[t]), i == least[2], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, exact_dups.exact_classes(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_residues_of_parts_combine(monkeypatch):
    monkeypatch.setattr(exact_dups, "CHUNK", 16)
    monkeypatch.setattr(exact_dups, "_tables", [])
    r = random.Random(2)
    for _ in range(50):
        raw = bytes(r.randrange(256) for _ in range(r.randrange(0, 90)))
        at = r.randrange(0, len(raw) + 1)
        want = tuple(sum((c + 1) * pow(b, len(raw) - 1 - i, p) for i, c in enumerate(raw)) % p for b, p in zip(exact_dups.BASES, exact_dups.PRIMES))
        assert exact_dups.residues(raw) == want
        assert exact_dups.combined(exact_dups.residues(raw[:at]), exact_dups.residues(raw[at:]), len(raw) - at) == want


def test_odd_rows(spark, odd_docs):
    extra = [(9, "a b"), (8, "a\t\n b"), (7, "a \x0bb"), (7, "a b"), (None, "a b"), (11, " "), (12, "\n\n"), (13, "a\x00b"), (14, "\x00"), (15, "\x00\x00"), (16, "a b")]
    docs = odd_docs.unionByName(spark.createDataFrame([(*x, 0) for x in extra], odd_docs.schema))
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert exact_dups.exact_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("piece, heavy", [(7, 1000), (1 << 18, 4), (5, 3)])
def test_cut_texts_and_heavy_groups(spark, monkeypatch, piece, heavy):
    monkeypatch.setattr(exact_dups, "PIECE", piece)
    monkeypatch.setattr(exact_dups, "HEAVY", heavy)
    r = random.Random(piece)
    rows = [(i, r.choice(["copy  of one text", "copy of one\ttext", "é" * 9, "x" * r.randrange(1, 12), "ab c" * r.randrange(0, 5), None])) for i in range(200)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


@pytest.mark.parametrize("piece, heavy", [(1 << 18, 1000), (4, 3)])
def test_equal_fingerprints_of_different_texts(spark, monkeypatch, piece, heavy):
    """With one tiny prime nearly all texts of a length collide; the comparison must part them."""
    from pyspark.sql import functions as F
    import pandas as pd
    monkeypatch.setattr(exact_dups, "PIECE", piece)
    monkeypatch.setattr(exact_dups, "HEAVY", heavy)

    @F.pandas_udf("k0 long, k1 long")
    def weak(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"k0": [sum(raw) % 2 for raw in raws], "k1": [0 for _ in raws]})

    @F.pandas_udf("array<long>")
    def weak_parts(pieces: pd.Series, rest: pd.Series) -> pd.Series:
        return pd.Series([[0, sum(raw) % 2, 0, 0] for raw in pieces])

    monkeypatch.setattr(exact_dups, "fingerprint", weak)
    monkeypatch.setattr(exact_dups, "shifted_residues", weak_parts)
    monkeypatch.setattr(exact_dups, "PRIMES", (2, 2, 2, 2))
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randrange(1, 7)))) for i in range(300)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    names = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"select {names} from ({queries.ORACLES['op12_exact_dedup']})").fetchall()
    got = queries.QUERIES["op12_exact_dedup"](spark, sf).select(*names.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
