"""Whitening of embeddings: principal components by a randomised range finder, and every row's coordinates along them.

Entries are quantised to whole numbers, so counts, sums and deviations are exact; the fit list holds each distinct vector
once. A pass multiplies the covariance with a basis of ``k`` and some more columns: each task adds up what its centred rows
give, and no covariance is built. The first basis is random; each pass gives both the Rayleigh-Ritz components of the basis
that it was made with, their residuals, and the next basis. Where the residuals fall too slowly to ever be small enough (a
flat spectrum), one last pass takes all dimensions, which is exact. Only what depends on the dimension alone reaches the
driver: sums, products with a basis, components.

Vectors of different lengths are fitted apart, in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A component's coordinate is this times the entry, rounded down, and the shift.
SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond are taken as this large: more than a long holds.
LARGEST = 2.0**62
#: Columns of the first basis beyond those asked for, and the most passes before all dimensions are taken.
OVERSAMPLE, PASSES = 8, 8
#: Residuals, as parts of the gap to the next eigenvalue (a vector's error is about that), that count as none; eigenvalues
#: below this part of the largest are taken as zero.
RESIDUAL, NOTHING = 1e-11, 1e-11
#: Bytes of numbers that are worked on at once.
SLICE_BYTES = 8 << 20
#: Bytes of the fit list that a task reads: of a list of up to 64 tasks, and of a longer one.
SMALL_PART, PART = 2 << 20, 64 << 20
SEED = 20250317


@dataclass
class Sums:
    """n distinct vectors, and the sum of each entry without the shift."""

    n: int
    totals: list[int]

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * y - totals, exactly: whole numbers of 64 bits where these suffice, else of any size."""
        most = max(int(np.abs(y).max(initial=0)), 1) * self.n + max(map(abs, self.totals), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.totals, dtype=kind)

    def centred(self, y: np.ndarray) -> np.ndarray:
        return self.deviations(y).astype(np.float64) / self.n


@dataclass
class Whitener:
    """components has a unit column for each eigenvalue; identity_error is that of the whitened fit list."""

    sums: Sums
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def scales(self) -> np.ndarray:
        """One over the deviation along each component; 0 where there is none."""
        there = self.eigenvalues > NOTHING * max(self.eigenvalues[0], 0.0) if len(self.eigenvalues) else np.zeros(0, bool)
        return np.where(there, 1 / np.sqrt(np.where(there, self.eigenvalues, 1.0)), 0.0)

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.eigenvalues, 0.0) / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (self.sums.centred(y) @ self.components) * self.scales


def quantised(vectors: np.ndarray) -> np.ndarray:
    """Entries without the shift, as whole numbers."""
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors, quantised) for each length, in slices."""
    lengths = np.asarray(pc.list_value_length(batch.column("_v")), dtype=np.int64)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        step = max(1, SLICE_BYTES // (8 * d))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            yield own, quantised(np.asarray(batch.column("_v").take(pa.array(own)).flatten()).reshape(-1, d))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> _d, _x: their entries in 32 bits each if all fit, else in 64."""
    for batch in batches:
        for _, y in _lists(batch):
            small = np.abs(y).max(axis=1) < 1 << 31
            rows = [row.astype("<i4").tobytes() if fits else row.tobytes() for row, fits in zip(y, small, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), y.shape[1], np.int32)), pa.array(rows, pa.binary())], names=["_d", "_x"])


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, vectors) of rows of the fit list, in slices."""
    lengths, sizes = np.asarray(batch.column("_d")), np.asarray(pc.binary_length(batch.column("_x")))
    for d in np.unique(lengths).tolist():
        for width in (4, 8):
            at = np.flatnonzero((lengths == d) & (sizes == width * d))
            step = max(1, SLICE_BYTES // (8 * d))
            for k in range(0, len(at), step):
                rows = batch.column("_x").take(pa.array(at[k : k + step])).to_pylist()
                yield d, np.frombuffer(b"".join(rows), f"<i{width}").reshape(-1, d).astype(np.int64)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """_id, _v: rows whose vector is neither null nor empty nor holds nulls or non-finite numbers."""
    kind = "array<double>" if "float" not in vectors.schema[vector_column].dataType.simpleString() else "array<float>"
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(vector_column).cast(kind).alias("_v"))
    return rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _sums(fit_list: DataFrame) -> dict[int, Sums]:
    """What each length's vectors add up to; as many rows as there are entries reach the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for d, y in _stored(batch):
                exact = y.sum(axis=0) if np.abs(y).max(initial=0) < 1 << 40 else y.astype(object).sum(axis=0)
                totals[d] = totals.get(d, 0) + exact.astype(object)
                counts[d] = counts.get(d, 0) + len(y)
        for d, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, counts[d])), pa.array([str(x) for x in total])], names=["d", "at", "n", "total"])

    rows = fit_list.mapInArrow(added, "d int, at int, n long, total string").groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found: dict[int, Sums] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["at"])):
        found.setdefault(r["d"], Sums(r["n"], [])).totals.append(int(r["total"]))
    return found


def _products(fit_list: DataFrame, sums: dict[int, Sums], of: Callable[[int, np.ndarray], np.ndarray], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length in ``sizes``, the flat array of so many numbers that ``of`` (length, centred rows) gives, summed over all rows.

    Each task adds up its own slices; the sums of tasks are added by place.
    """
    sent = fit_list.sparkSession.sparkContext.broadcast((sums, sizes))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = sent.value
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, y in _stored(batch):
                if d in wanted:
                    totals[d] = totals.get(d, 0) + of(d, known[d].centred(y)).ravel()
        for d, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), d, np.int32)), pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], names=["d", "at", "value"])

    table = fit_list.mapInArrow(added, "d int, at long, value double").groupBy("d", "at").agg(F.sum("value").alias("value")).toArrow()
    d, at, value = (table.column(x).to_numpy() for x in ("d", "at", "value"))
    found = {}
    for own, size in sizes.items():
        found[own] = np.zeros(size)
        found[own][at[d == own]] = value[d == own]
    sent.unpersist()
    return found


def ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the k largest eigenvalues within the basis, their unit vectors, their residuals' lengths as parts of the gap to the
    nearest other eigenvalue); ``product``: covariance times basis."""
    small = basis.T @ product
    every, turn = np.linalg.eigh((small + small.T) / 2)
    every, turn = every[::-1], turn[:, ::-1][:, :k]
    steps = -np.diff(every, prepend=np.inf, append=-np.inf)
    gaps, values, vectors = np.minimum(steps[:-1], steps[1:])[:k], every[:k], basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0) / np.maximum(gaps, 1e-300)


def fit(vectors: DataFrame, k: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> dict[int, Whitener]:
    """A whitener for each length of vectors, from each distinct quantised vector once; {} without any."""
    fit_list = cut(usable(vectors, id_column, vector_column).mapInArrow(_distinct, "_d int, _x binary").dropDuplicates(["_d", "_x"]))
    # A task's sums are as many rows whatever it has read, so tasks are few where the list is short.
    size = fit_list.agg(F.sum(F.octet_length("_x"))).first()[0] or 0
    fit_list = fit_list.coalesce(max(1, min(-(-size // SMALL_PART), max(64, -(-size // PART)))))
    sums = _sums(fit_list)
    spread = _products(fit_list, sums, lambda _, rows: np.array([(rows**2).sum()]), dict.fromkeys(sums, 1))
    trace = {d: float(spread[d][0]) / sums[d].n for d in sums}
    full = {d for d in sums if d <= k + OVERSAMPLE}
    basis = {d: np.eye(d) if d in full else np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, k + OVERSAMPLE)))[0] for d in sums}
    done: dict[int, Whitener] = {}
    last: dict[int, float] = {}
    for step in range(PASSES + 2):
        todo = {d: b for d, b in basis.items() if d not in done}
        if not todo:
            break
        sent = fit_list.sparkSession.sparkContext.broadcast(todo)

        def multiplied(d: int, rows: np.ndarray, sent=sent) -> np.ndarray:
            return rows.T @ (rows @ sent.value[d])

        products = _products(fit_list, sums, multiplied, {d: b.size for d, b in todo.items()})
        for d, own in todo.items():
            product = products[d].reshape(own.shape) / sums[d].n
            values, found, left = ritz(own, product, min(k, d))
            worst = float(left.max())
            if d in full or worst <= RESIDUAL:
                signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
                done[d] = Whitener(sums[d], found * signs, values, trace[d])
                continue
            # What the passes that are left would bring, at the rate of the last one.
            hopeless = d in last and worst * min(worst / last[d], 1.0) ** (PASSES - step) > RESIDUAL
            last[d] = worst
            if hopeless or step >= PASSES:
                full.add(d)
                basis[d] = np.eye(d)
            else:
                basis[d] = np.linalg.qr(product)[0]
    sent = fit_list.sparkSession.sparkContext.broadcast({d: (w.components, w.scales) for d, w in done.items()})

    def whitened(d: int, rows: np.ndarray) -> np.ndarray:
        components, scales = sent.value[d]
        own = (rows @ components) * scales
        return own.T @ own

    for d, product in _products(fit_list, sums, whitened, {d: w.components.shape[1] ** 2 for d, w in done.items()}).items():
        there = done[d].scales > 0
        covariance = product.reshape(len(there), -1)[np.ix_(there, there)] / sums[d].n
        done[d].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return done


def _exact_squares(deviations: np.ndarray) -> pa.Array:
    """Row sums of squares; null where a long can't hold one."""
    most = int(np.abs(deviations).max(initial=0))
    if deviations.dtype != object and most * most * deviations.shape[1] < 1 << 63:
        return pa.array((deviations**2).sum(axis=1), pa.int64())
    whole = (deviations.astype(object) ** 2).sum(axis=1)
    return pa.array([x if x < 1 << 63 else None for x in whole], pa.int64())


def apply(vectors: DataFrame, whiteners: dict[int, Whitener], id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row, a row for each component."""
    sent = vectors.sparkSession.sparkContext.broadcast(whiteners)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in _lists(batch):
                own = sent.value[y.shape[1]]
                k, rows = len(own.eigenvalues), np.repeat(np.arange(len(at)), len(own.eigenvalues))
                spread = lambda x: pa.array(np.tile(x, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(at[rows])),
                        spread(np.arange(1, k + 1, dtype=np.int32)),
                        pa.array(np.full(len(rows), own.sums.n)),
                        _exact_squares(own.sums.deviations(y)).take(pa.array(rows)),
                        pa.array(own.whiten(y).ravel()),
                        spread(own.explained),
                        pa.array(np.full(len(rows), own.identity_error)),
                    ],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return usable(vectors, id_column, vector_column).mapInArrow(placed, schema)


def whiten(vectors: DataFrame, k: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Every usable row's coordinates along the ``k`` leading components, scaled to variance one over the fit list.

    Vectors that are null, empty or hold nulls or non-finite numbers take no part; zero vectors do. Repeated vectors count
    once in the fit and have a row each in the result, as have repeated and null ids. Vectors of each length are fitted
    apart; a length of fewer than ``k`` has as many components. A component without variance (one distinct vector, or fewer
    than components) has whitened and explained 0. A deviation beyond a long is null. Entries beyond 2 ** 62 / 64 count as
    that. Components of equal eigenvalues are any basis of theirs. No rows give none. Other columns are not read.
    """
    return apply(vectors, fit(vectors, k, id_column, vector_column), id_column, vector_column)
