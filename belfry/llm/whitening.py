"""Whitening of embeddings by incremental eigendecomposition.

Entries become the integers ``floor(1024 * c) + 100000``; their number and sums are exact, so every vector is
centred without loss.  Each partition then keeps the eigendecomposition of the scatter it has seen: blocks of
rows are reduced to a triangle with the same scatter, and every row of the triangle is a rank-one update,
which deflates directions without a part in it and equal eigenvalues and solves the secular equation for the
others.  Spectra of partitions are joined in groups of ``FAN``, again by rank-one updates, until one is left.
At last all rows are projected on its vectors, the projected covariances are added up over the partitions, and
the small problem's eigenvectors correct the basis (Rayleigh-Ritz), so the result has double precision.

Only sums, spectra and projected covariances leave a partition; their size depends on the dimension alone.

Edge cases: vectors that are null or hold null or non-finite entries take no part, nor do entries of
``LARGEST`` and more, which have no exact integer here, nor vectors of another length than most (the shorter on
ties); null ids stay null; repeated rows count each; components without variance have ``whitened`` null and
``explained`` 0; a deviation that no long can hold is null; without vectors there are no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belfry.session import written

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0 ** 38
COMPONENTS = 8
BLOCK = 4096       # rows reduced to one triangle
FAN = 16           # spectra, or sums of products, joined in one group
REFINEMENTS = 2
NO_VARIANCE = 1e-13  # eigenvalues up to this share of the trace are rounding, not variance
EPS = np.finfo(float).eps
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def updated(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of ``vectors diag(values) vectors' + z z'``."""
    vectors = vectors.copy()
    p = vectors.T @ z
    size = max(abs(values[-1]), float(p @ p))
    if size == 0:
        return values, vectors
    tiny = 8 * EPS * size
    # deflation: equal eigenvalues share one vector with a part in z, the other one is turned out of it
    for i in np.flatnonzero(np.diff(values) <= tiny):
        r = np.hypot(p[i], p[i + 1])
        if r > 0:
            c, s = p[i + 1] / r, p[i] / r
            vectors[:, [i, i + 1]] = vectors[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
            p[i], p[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(p) * np.sqrt(size) > tiny)
    if not len(live):
        return values, vectors
    poles, part = values[live], p[live]
    roots, gaps = _secular_roots(poles, part)
    # weights for which the roots are exact: the vectors are then orthogonal whatever the roots' error
    k = len(live)
    ratio = np.ones((k, k))
    off = ~np.eye(k, dtype=bool)
    between = poles[None, :] - poles[:, None]
    ratio[off] = (gaps.T[off]) / between[off]
    weight = np.sign(part) * np.sqrt(np.abs(np.prod(ratio, axis=1) * np.diag(gaps)))
    inner = weight[:, None] / np.where(gaps.T == 0, EPS * tiny, -gaps.T)
    inner /= np.linalg.norm(inner, axis=0)
    out = values.copy()
    out[live] = roots
    vectors[:, live] = vectors[:, live] @ inner
    order = np.argsort(out, kind="stable")
    return out[order], vectors[:, order]


def _secular_roots(poles: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum part**2 / (pole - root)``, one right of every pole, and gaps[j, i] = root j - pole i.

    Every root is searched by its distance from the nearer pole, so gaps keep their relative precision.
    """
    square, k = part * part, len(poles)
    width = np.r_[np.diff(poles), square.sum()]

    def value(origin: np.ndarray, distance: np.ndarray) -> np.ndarray:
        away = poles[None, :] - poles[origin][:, None] - distance[:, None]
        return 1 + (square / np.where(away == 0, np.finfo(float).tiny, away)).sum(axis=1)

    here = np.arange(k)
    right = (value(here, width / 2) < 0) & (here < k - 1)  # the function rises from pole to pole
    origin = here + right
    low, high = np.where(right, -width / 2, 0.0), np.where(right, 0.0, width)
    for _ in range(64):
        middle = (low + high) / 2
        below = value(origin, middle) < 0
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    distance = (low + high) / 2
    return poles[origin] + distance, poles[origin][:, None] - poles[None, :] + distance[:, None]


@dataclass
class Spectrum:
    """Eigendecomposition of a scatter matrix, grown by rank-one updates."""

    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(np.zeros(dim), np.eye(dim))

    def add(self, row: np.ndarray) -> None:
        self.values, self.vectors = updated(self.values, self.vectors, row)

    def add_rows(self, rows: np.ndarray) -> None:
        """Rank-one updates by the rows of a triangle whose scatter is that of ``rows``."""
        for row in (np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows):
            self.add(row)

    def join(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.add(np.sqrt(value) * vector)

    def to_bytes(self) -> bytes:
        return np.vstack([self.values, self.vectors]).tobytes()

    @staticmethod
    def from_bytes(raw: bytes, dim: int) -> Spectrum:
        held = np.frombuffer(raw).reshape(dim + 1, dim)
        return Spectrum(held[0], held[1:])


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a batch, the place of each row's first entry, and its length (-1: takes no part)."""
    lists = batch.column("embedding")
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    bad = np.r_[0, np.cumsum(~(np.abs(values) < LARGEST))]
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
    return values, ends[:-1], np.where(whole, np.diff(ends), -1)


def integers(values: np.ndarray, firsts: np.ndarray, dim: int) -> np.ndarray:
    return np.floor(SCALE * values[firsts[:, None] + np.arange(dim)]).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Fit:
    """Number of vectors and exact sums per dimension."""

    n: int
    sums: tuple[int, ...]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact (integers of any size where 64 bits do not do)."""
        if self.n * int(np.abs(x).max(initial=0)) >= 2 ** 62:
            return self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return self.n * x - np.array(self.sums, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        t = self.offsets(x)
        top = max((abs(int(v)) for v in (t.max(initial=0), t.min(initial=0))))
        if top * top * t.shape[1] < 2 ** 63:
            return (t.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (t.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 2 ** 63 else None for v in exact]


def _fit(vectors: DataFrame) -> Fit | None:
    """Counts and sums of the most common length."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            values, firsts, lengths = usable(batch)
            for dim in set(lengths[lengths > 0].tolist()):
                rows = integers(values, firsts[lengths == dim], dim)
                for at in range(0, len(rows), BLOCK):
                    sums[dim] = sums.get(dim, 0) + rows[at:at + BLOCK].sum(axis=0).astype(object)
                counts[dim] = counts.get(dim, 0) + len(rows)
        for dim, n in counts.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, pa.int32()), "place": pa.array(range(dim), pa.int32()),
                                              "n": pa.array([n] * dim, pa.int64()), "total": [str(s) for s in sums[dim]]})

    parts = vectors.select("embedding").mapInArrow(summed, "dim int, place int, n long, total string")
    sums = written(parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "vector-sums")
    common = sums.where("place = 0").orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    rows = sums.where(F.col("dim") == common["dim"]).orderBy("place").collect()  # one row per dimension
    return Fit(int(common["n"]), tuple(int(r["total"]) for r in rows))


def _per_partition(vectors: DataFrame, fit: Fit, start: Callable, add: Callable, packed: Callable) -> DataFrame:
    """(part, held): what every partition gathers from its centred rows, block by block."""
    dim = len(fit.sums)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held, seen = start(), False
        for batch in batches:
            values, firsts, lengths = usable(batch)
            firsts = firsts[lengths == dim]
            for at in range(0, len(firsts), BLOCK):
                held, seen = add(held, fit.centred(integers(values, firsts[at:at + BLOCK], dim))), True
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "held": [packed(held)]})

    return vectors.select("embedding").mapInArrow(gathered, "part long, held binary")


def _joined(parts: DataFrame, join: Callable[[list[bytes]], bytes], name: str) -> bytes:
    """All parts as one, in groups of ``FAN``: one value returns to the driver."""
    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "held": [join([bytes(h) for h in group.sort_values("part")["held"]])]})

    parts = written(parts, name)
    left = parts.count()
    while left > 1:
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("at")).applyInPandas(one, "part long, held binary"), name)
        left = parts.count()
    return bytes(parts.first()["held"])


def _products(vectors: DataFrame, fit: Fit, basis: np.ndarray, name: str) -> np.ndarray:
    """Sums and products of all rows on ``basis``: row 0 the sums, below them the products, all over n."""
    k = basis.shape[1]

    def add(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        y = rows @ basis
        return held + np.vstack([y.sum(axis=0), y.T @ y])

    parts = _per_partition(vectors, fit, lambda: np.zeros((k + 1, k)), add, lambda held: held.tobytes())
    raw = _joined(parts, lambda raws: sum(np.frombuffer(r) for r in raws).tobytes(), name)
    return np.frombuffer(raw).reshape(k + 1, k) / fit.n


def principal_axes(vectors: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of the covariance, falling, and the unit eigenvectors (columns)."""
    dim = len(fit.sums)

    def add(held: Spectrum, rows: np.ndarray) -> Spectrum:
        held.add_rows(rows)
        return held

    def join(raws: list[bytes]) -> bytes:
        first, *others = (Spectrum.from_bytes(r, dim) for r in raws)
        for other in others:
            first.join(other)
        return first.to_bytes()

    parts = _per_partition(vectors, fit, lambda: Spectrum.empty(dim), add, lambda held: held.to_bytes())
    spectrum = Spectrum.from_bytes(_joined(parts, join, "spectra"), dim)
    basis, values = spectrum.vectors, spectrum.values / fit.n
    for _ in range(REFINEMENTS):
        basis = np.linalg.qr(basis)[0]
        held = _products(vectors, fit, basis, "projected")
        values, turn = np.linalg.eigh((held[1:] + held[1:].T) / 2)
        basis = basis @ turn
    order = np.argsort(-values, kind="stable")
    basis = basis[:, order]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    return np.maximum(values[order], 0.0), basis


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = _fit(vectors)
    if fit is None:
        return df.sparkSession.createDataFrame([], OUT)
    dim = len(fit.sums)
    values, basis = principal_axes(vectors, fit)
    k = min(components, dim)
    trace = float(values.sum())
    live = np.flatnonzero(values[:k] > NO_VARIANCE * trace)
    scaled = basis[:, live] / np.sqrt(values[live])
    explained = values[:k] / trace if trace else np.zeros(k)
    error = 0.0
    if len(live):
        held = _products(vectors, fit, scaled, "whitened")
        error = float(np.abs(held[1:] - np.outer(held[0], held[0]) - np.eye(len(live))).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, firsts, lengths = usable(batch)
            rows = np.flatnonzero(lengths == dim)
            for at in range(0, len(rows), BLOCK):
                some = rows[at:at + BLOCK]
                x = integers(values, firsts[some], dim)
                score = np.full((len(some), k), np.nan)
                score[:, live] = fit.centred(x) @ scaled
                size = len(some) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(some, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                    pa.array(np.full(size, fit.n, dtype=np.int64)),
                    pa.array([d for d in fit.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(score.ravel(), mask=np.isnan(score).ravel()),
                    pa.array(np.tile(explained, len(some))),
                    pa.array(np.full(size, error))], names=[c.split(" ")[0] for c in OUT.split(", ")])

    return vectors.mapInArrow(out, OUT)
