"""Whitening of embeddings by shifted CholeskyQR: Gram passes over the rows, triangular solves, composed R factors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + OFFSET (fixed values).
SCALE, OFFSET = 1024, 100_000
#: Entries are held within these bounds before they are made long: beyond them no long can hold them.
MOST = 2.0**61
LOW = 1 << 31


def whole_numbers(c: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(c * SCALE), -MOST, MOST).astype(np.int64) + OFFSET


def usable(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length; those that are null or hold null or non-finite entries are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    given = np.flatnonzero(np.array(column.is_valid()))
    column = column.take(pa.array(given))
    lengths = np.diff(np.array(column.offsets))
    values = column.flatten().cast(pa.float64())
    entries = np.array(values.fill_null(np.nan))
    begin = np.r_[0, np.cumsum(lengths)]
    out = {}
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        block = entries[begin[rows][:, None] + np.arange(d)]
        fine = np.isfinite(block).all(axis=1)
        if fine.any():
            out[int(d)] = given[rows[fine]], block[fine]
    return out


@dataclass
class Sums:
    """Count and sums of the vectors of one length, and the trace of their covariance once known."""

    n: int
    s: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as long where that holds, else as Python numbers."""
        widest = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.s), default=0)
        if widest < 1 << 62:
            return x * np.int64(self.n) - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R**-1 for an upper triangular R, column by column."""
    out = np.empty_like(a)
    for j in range(r.shape[0]):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def shifted_cholesky(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift: the least shift that rounding could ask for, doubled until it holds."""
    d = len(gram)
    u = np.finfo(float).eps / 2
    shift = 11 * (n * d + d * (d + 1)) * u * np.linalg.norm(gram, 2)
    shift = min(shift, 1e-3 * np.trace(gram) / d)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def _sums(batches, column):
    """For each length and dimension of a task's vectors: their number and the sums of the high and low halves."""
    total: dict[int, list] = {}
    for batch in batches:
        for d, (_, c) in usable(batch.column(column)).items():
            x = whole_numbers(c)
            part = np.stack([np.full(d, len(x)), (x // LOW).sum(axis=0), (x % LOW).sum(axis=0)])
            total[d] = total[d] + part if d in total else part
    rows = [(d, i, *map(int, t[:, i])) for d, t in total.items() for i in range(d)]
    yield _rows(rows, ("dim", "i", "n", "high", "low"), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))


def _rows(rows, names, types):
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


_GRAM = ("dim", "i", "row"), (pa.int32(), pa.int32(), pa.list_(pa.float64()))
_GRAM_SCHEMA = "dim int, i int, row array<double>"


def _grams(batches, column, project):
    """Rows of the Gram matrix of a task's projected vectors, for each length."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, (_, c) in usable(batch.column(column)).items():
            a = project(d, whole_numbers(c))
            if a is not None:
                total[d] = total.get(d, 0) + a.T @ a
    yield _rows([(d, i, g[i].tolist()) for d, g in total.items() for i in range(len(g))], *_GRAM)


def _added(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            total[d, i] = total.get((d, i), 0) + np.array(row)
    yield _rows([(d, i, row.tolist()) for (d, i), row in total.items()], *_GRAM)


def _gram(vectors: DataFrame, column: int, project) -> dict[int, np.ndarray]:
    """Gram matrix of the projected rows for each length: summed in the tasks, then row by row; the driver gets its d x d entries."""
    partial = vectors.mapInArrow(lambda b: _grams(b, column, project), _GRAM_SCHEMA)
    found = partial.repartition("dim", "i").mapInArrow(_added, _GRAM_SCHEMA).collect()
    out: dict[int, dict[int, list[float]]] = {}
    for r in found:
        out.setdefault(r.dim, {})[r.i] = r.row
    return {d: np.array([rows[i] for i in range(len(rows))]) for d, rows in out.items()}


@dataclass
class Whitening:
    """What one pass over the rows needs to whiten vectors of one length."""

    sums: Sums
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; 0 where a component has no variance."""
        spread = np.sqrt(np.where(self.values > 0, self.values, 1.0))
        return np.where(self.values > 0, self.sums.centred(x) @ self.axes / spread, 0.0)


def fit(vectors: DataFrame, column: int = 0, most: int = 8, passes: int = 6) -> dict[int, Whitening]:
    """The leading components of the vectors in ``column``, for each length of vector.

    One pass takes exact sums.  Then A, the rows centred exactly, is made orthogonal: a pass forms the Gram matrix of
    A R**-1, its shifted Cholesky factor is multiplied onto R, and so on until the Gram matrix is the identity on every
    direction that has variance.  A = QR then holds to double precision, however badly scaled A is, and the singular
    values and right vectors of the small R are those of A.
    """
    rows = vectors.mapInArrow(lambda b: _sums(b, column), "dim int, i int, n long, high long, low long")
    found: dict[int, dict[int, tuple]] = {}
    for r in rows.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        found.setdefault(r.dim, {})[r.i] = (r.n, r.high * LOW + r.low)
    sums = {d: Sums(by[0][0], [by[i][1] for i in range(d)]) for d, by in found.items()}
    factor = {d: np.eye(d) for d in sums}
    trace = {d: 0.0 for d in sums}
    open_ = set(sums)
    for step in range(passes):
        if not open_:
            break

        def project(d, x, factor={d: factor[d] for d in open_}, first=step == 0):
            if d not in factor:
                return None
            a = sums[d].centred(x)
            return a if first else solve_rows(a, factor[d])

        for d, gram in _gram(vectors, column, project).items():
            if step == 0:
                trace[d] = float(np.trace(gram)) / sums[d].n
                if trace[d] == 0:
                    open_.discard(d)
                    continue
            else:
                eigen = np.linalg.eigvalsh(gram)
                if np.minimum(np.abs(eigen), np.abs(eigen - 1)).max() < 1e-12 * d:
                    open_.discard(d)
                    continue
            factor[d] = shifted_cholesky(gram, sums[d].n) @ factor[d]
    out = {}
    for d, total in sums.items():
        if trace[d] == 0:
            axes, values = np.eye(d)[:, :most], np.zeros(min(d, most))
        else:
            _, singular, right = np.linalg.svd(factor[d])
            values = singular[:most] ** 2 / total.n
            axes = right[:most].T
            axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
            values = np.where(values > trace[d] * 1e-20, values, 0.0)
        out[d] = Whitening(total, axes, values, trace[d])
    return out


def _whitened(batches, models, errors):
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    for batch in batches:
        for d, (rows, c) in usable(batch.column(1)).items():
            model, x = models[d], whole_numbers(c)
            apart = model.sums.deviations(x)
            wide = int(np.abs(apart).max(initial=0)) ** 2 * d >= 1 << 62
            squares = (apart.astype(object) ** 2).sum(axis=1) if wide else (apart * apart).sum(axis=1)
            deviation = [int(v) if v < 1 << 63 else None for v in squares.tolist()]
            k = len(model.values)
            flat = model.apply(x).ravel()
            live = np.tile(model.values > 0, len(rows))
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            explained = np.tile(model.values / model.trace if model.trace > 0 else np.zeros(k), len(rows))
            m = len(flat)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(m, model.sums.n), pa.int64()),
                pa.array(np.repeat(np.array(deviation, object), k).tolist(), pa.int64()), pa.array(flat, pa.float64(), mask=~live),
                pa.array(explained, pa.float64()), pa.array(np.full(m, errors.get(d, np.nan)), pa.float64(), mask=np.full(m, d not in errors)),
            ], names=list(names))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """One row for each usable vector and each of its first ``most`` components.

    Vectors that are null or hold null or non-finite entries are left out.  Entries c become x = floor(1024 c) + 100000.
    Returns vec_id, component (from 1, by falling eigenvalue e of x's covariance V), n, deviation (sum of (n x - S)**2,
    exact), whitened (x - S/n on the component, over sqrt(e)), explained (e / trace V) and identity_error (the largest
    entry, without sign, of whitened's covariance less the identity, measured over all rows).

    Nothing is shuffled but partial sums.  The driver sees sums and d x d matrices, never rows.

    Vectors of another length are a list of their own; empty ones have no components.  Null ids and repeated rows are
    rows like others.  A component without variance (copies only, or fewer vectors than dimensions) has null whitened,
    0 explained, and is left out of identity_error, which is null if no component is left.  ``deviation`` is null where
    it exceeds a long.  Of equal eigenvalues any orthogonal components are taken, the same for all rows.  Other columns
    are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    models = fit(rows.select("embedding"), 0, most)
    errors = {}
    for d, gram in _gram(rows.select("embedding"), 0, lambda d, x: models[d].apply(x)).items():
        live = np.flatnonzero(models[d].values > 0)
        if len(live):
            errors[d] = float(np.abs(gram[np.ix_(live, live)] / models[d].sums.n - np.eye(len(live))).max())
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(lambda b: _whitened(b, models, errors), schema)
