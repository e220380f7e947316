"""Compression classifier for text quality.

Two Zstandard dictionaries are built, one from good and one from bad labelled texts.  A text is cut
into pieces of ``CHUNK`` bytes (so that long texts do not drown the dictionaries in their own
history), every piece is compressed under both, and the size difference per input byte, together
with the smaller size per byte, becomes a logistic score: 1 is good, 0 is bad.

Bounds: at most ``per_class`` labelled texts per class are looked at for fitting (those with the
smallest hash of their id; every other one builds the dictionary, with at most ``SAMPLE_PIECES`` of its
pieces, chosen by hash from the whole text, the rest calibrate the score on whole texts).  Scoring reads
whole texts.

Edge cases: null and empty texts have the features (0, 0) and so a fixed score; labels that are null
or name no document are ignored; a document labelled twice counts with its smaller label; when a
class has no text to build from, the score is the smoothed share of good labels for all texts; when
the texts left for calibration are of one class, all looked at serve.  Rows are never dropped or merged
and extra columns travel unchanged; an input column of the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

CHUNK = 1024
DICT_BYTES = 112_640
LEVEL = 3
SAMPLE_PIECES = 4
PER_CLASS = 3000


@dataclass(frozen=True)
class QualityModel:
    """Both dictionaries and the calibration; small and fixed in size, so it travels in closures."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the other fifth is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _compressor(dictionary: bytes):
    import zstandard
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def size_features(text: Column, good: bytes, bad: bytes) -> Column:
    """Two doubles per text: size difference and smaller size, both per byte of the whole text."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        under_good, under_bad = _compressor(good), _compressor(bad)
        for batch in batches:
            out = []
            for value in batch:
                raw = value.encode("utf-8", "surrogatepass") if value else b""
                if not raw:
                    out.append([0.0, 0.0])
                    continue
                pieces = [raw[i:i + CHUNK] for i in range(0, len(raw), CHUNK)]
                g = sum(len(under_good.compress(p)) for p in pieces)
                b = sum(len(under_bad.compress(p)) for p in pieces)
                out.append([(g - b) / len(raw), min(g, b) / len(raw)])
            yield pd.Series(out)

    return features(text)


def sampled_pieces(text: Column) -> Column:
    """At most ``SAMPLE_PIECES`` pieces of each text, those of the smallest hash, in order of the text."""
    chunk, most = CHUNK, SAMPLE_PIECES

    @F.pandas_udf(ArrayType(BinaryType()))
    def pieces(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            raw = (value or "").encode("utf-8", "surrogatepass")
            cut = [raw[i:i + chunk] for i in range(0, len(raw), chunk)]
            picked = sorted(sorted(range(len(cut)), key=lambda i: (crc32(cut[i]), i))[:most])
            out.append([cut[i] for i in picked])
        return pd.Series(out, dtype=object)

    return pieces(text)


def _train_dictionary(pieces: list[bytes]) -> bytes:
    import zstandard
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the texts themselves serve as history
        return b"".join(pieces)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curvature = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge
        w = w + np.linalg.solve(curvature, a.T @ (y - p) - ridge @ w)
    return mean, spread, w


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Learn from ``labels(doc_id, quality)`` over ``documents(doc_id, text)``, held-out rows excluded."""
    known = (labels.where(F.col("quality").isin(0, 1) & learnable(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    order = F.xxhash64("doc_id")
    # two top-k picks of at most per_class ids each: the broadcast side never exceeds 2 * per_class rows
    picks = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    sample = (documents.select("doc_id", "text").where(F.length("text") > 0)
              .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality"))
    builds = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    texts = sample.where(builds).select("quality", sampled_pieces(F.col("text")).alias("pieces")).collect()
    classes = {q: [p for pieces in sorted([bytes(p) for p in r["pieces"]] for r in texts if r["quality"] == q) for p in pieces] for q in (0, 1)}
    prior = (sum(r["quality"] for r in texts) + 1) / (len(texts) + 2)
    if not all(classes.values()):
        return QualityModel(b"", b"", (), (), (), prior)
    good, bad = _train_dictionary(classes[1]), _train_dictionary(classes[0])
    sized = sample.select("quality", builds.alias("builds"), size_features(F.col("text"), good, bad).alias("f"))
    rows = sized.where("not builds").collect()
    if len({r["quality"] for r in rows}) < 2:
        rows = sized.collect()
    y = np.array([r["quality"] for r in rows], dtype=float)
    mean, spread, weights = _logistic(np.array([r["f"] for r in rows]), y)
    return QualityModel(good, bad, *(tuple(map(float, v)) for v in (mean, spread, weights)), prior)


def with_quality_score(df: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` plus ``score`` in 0..1 (higher: likelier good)."""
    if not model.weights:
        return df.withColumn(score, F.lit(model.prior))
    f = size_features(F.col(text), model.good, model.bad)
    z = F.lit(model.weights[-1])
    for i, (m, s, w) in enumerate(zip(model.mean, model.spread, model.weights)):
        z = z + (F.col("__size_features")[i] - m) / s * w
    return (df.withColumn("__size_features", f).withColumn(score, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
            .drop("__size_features"))
