"""Whitened vectors: float32 eigenvectors of a distributed covariance, refined in extended precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LARGEST = float(1 << 30)
"""An entry beyond this counts as not finite, so that sums over a batch are exact in 64 bits."""

ROUNDS = 30
NOTHING = 1e-13
"""Eigenvalues below this share of the trace are rounding of zero and give no component."""

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


# eigenvectors ---------------------------------------------------------------------------------


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Groups of two and more neighbours, in falling order, that are not ``apart`` from each other."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > apart) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns made orthonormal in extended precision, twice Gram-Schmidt."""
    x = x.copy()
    for k in range(x.shape[1]):
        for _ in range(2):
            x[:, k] -= x[:, :k] @ (x[:, :k].T @ x[:, k])
        x[:, k] /= np.sqrt((x[:, k] ** 2).sum())
    return x


def refined_eigenvectors(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, and unit eigenvectors as columns, of a symmetric matrix.

    A float32 decomposition is the start. Every round measures, in extended precision, how far the vectors are
    from orthonormal (R) and from making the matrix diagonal (S), and corrects all of them at once with products
    of matrices; the error is squared each time. Eigenvalues closer to each other than what R and S leave
    open are a cluster, for which the correction would divide by noise: there only orthonormality is mended,
    and the cluster's own small matrix, less its mean eigenvalue so that the differences keep their digits, is
    decomposed by itself and turns the cluster's vectors. The largest entry of each vector is positive.
    """
    size = len(matrix)
    a = np.asarray(matrix, dtype=np.longdouble)
    top = np.abs(a).max() if size else 0
    if not top:
        return np.zeros(size), np.eye(size)
    a = (a + a.T) / (2 * top)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    one, norm = np.eye(size, dtype=np.longdouble), np.sqrt((a * a).sum())
    least, settled = np.inf, 0
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(values)
        open_ = 2 * (np.sqrt((rest**2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= open_
        change = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ change
        turned = 0.0
        for group in _clusters(values, open_):
            own = _orthonormal(x[:, group])
            inner = own.T @ a @ own
            inner -= np.trace(inner) / len(group) * np.eye(len(group), dtype=np.longdouble)
            size_of = np.abs(inner).max()
            if size_of > 1e-18:
                inner = (inner + inner.T) / (2 * size_of)
                turn = np.linalg.eigh(inner.astype(np.float64))[1].astype(np.longdouble)
                own = own @ turn
                turned = max(turned, float(np.abs(inner - np.diag(np.diag(inner))).max() * size_of))
            x[:, group] = own
        moved = max(float(np.abs(change).max()), turned)
        settled = settled + 1 if moved >= least / 2 and moved < 1e-12 else 0
        least = min(least, moved)
        if moved < 1e-18 or settled > 2:
            break
    for _ in range(2):  # what a last turn left between clusters
        x = x + x @ ((one - x.T @ x) / 2)
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None], 0) < 0, -1, 1)
    return (values * top).astype(np.float64), x.astype(np.float64)


# sums over the table --------------------------------------------------------------------------


@dataclass(frozen=True)
class Centre:
    """Row count and exact sums; the mean is ``whole + part / n`` in each dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def part(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)**2, exact; None beyond 64 bits."""
        off = x - self.whole
        bound = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if len(self.sums) * bound * bound < 1 << 63:
            return ((off * self.n - self.part) ** 2).sum(axis=1).tolist()
        wide = (off.astype(object) * self.n - self.part.astype(object)) ** 2
        return [v if v < 1 << 63 else None for v in wide.sum(axis=1).tolist()]


def _mapped(df: DataFrame, schema: str, make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Apply (step, end) to the batches of (vec_id, vector): step(ids, x) may return columns, end() must."""
    target = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def built(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in arrow], names=[f.name for f in arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, end = make()
        for batch in batches:
            if batch.num_rows:
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                found = step(batch.column("vec_id"), values.reshape(batch.num_rows, -1))
                if found is not None:
                    yield built(found)
        found = end()
        if found is not None:
            yield built(found)

    return df.mapInArrow(run, target)


def scaled(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector of longs) of the usable rows, all of one length: the most frequent one, of ties the largest."""
    values = F.col(column)
    whole = F.transform(values, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    usable = F.size(values) > 0
    usable &= F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    kept = rows.filter(F.coalesce(usable, F.lit(False)))
    top = kept.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = top.d if top else 0
    return kept.filter(F.size(column) == width).select(F.col("vec_id").cast("long"), whole.alias("vector"))


def centre_of(rows: DataFrame) -> Centre | None:
    """Row count and sums of the vectors; one number per dimension reaches the driver."""

    def make():
        totals: list[int] = []
        seen = [0]

        def step(ids, x):
            seen[0] += len(x)
            added = x.sum(axis=0).tolist()
            totals[:] = [a + b for a, b in zip(totals, added)] if totals else added

        def end():
            if seen[0]:
                return {"place": list(range(-1, len(totals))), "total": [str(v) for v in (seen[0], *totals)]}

        return step, end

    parts = _mapped(rows, "place int, total string", make)
    found = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    return Centre(int(found[0].total), tuple(int(r.total) for r in found[1:])) if found else None


def second_moments(rows: DataFrame, width: int, mapped: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the rows of y y' for y = mapped(x), followed by one row with the sum of y.

    A task adds its rows up and gives width * (width + 1) numbers, which are summed by place in a shuffle: what
    the driver gets depends on the width alone.
    """

    def make():
        total = np.zeros((width + 1, width))

        def step(ids, x):
            y = mapped(x)
            total[:width] += y.T @ y
            total[width] += y.sum(axis=0)

        def end():
            return {"place": np.arange(total.size), "value": total.ravel()} if total.any() else None

        return step, end

    parts = _mapped(rows, "place long, value double", make)
    out = np.zeros((width + 1) * width)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out.reshape(width + 1, width)


def whiten(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: the whitened coordinate and the figures of the fit.

    Entries c become x = floor(1024 c) + 100000. The covariance of all x (divisor n, centred row by row on the exact
    mean before multiplying) is added up by the tasks; the driver holds it, a square of the dimension, and finds
    its eigenvectors with ``refined_eigenvectors``. ``whitened`` is the centred x along the eigenvector over the
    root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``deviation`` the exact sum of
    (n x - S)**2, and ``identity_error`` how far the covariance of the whitened rows, measured in a pass of its
    own, is from the identity.

    Vectors that are null, empty, or hold null or non-finite entries (or entries beyond 2**30) are left
    out, as are those whose length is not the most frequent one. Repeated rows and ids count and come out as
    often as they are there; a null id is kept. Directions without variance give no component, so equal rows
    alone, or one row, give no rows, and neither does an empty table. A deviation beyond 64 bits is null.
    Extra columns are ignored.
    """
    spark = rows.sparkSession
    fit = scaled(rows, column)
    centre = centre_of(fit)
    if centre is None:
        return spark.createDataFrame([], RESULT)
    n, width = centre.n, len(centre.sums)
    values, vectors = refined_eigenvectors(second_moments(fit, width, centre.centred)[:width] / n)
    trace = float(values.sum())
    kept = [k for k in range(min(components, width)) if values[k] > NOTHING * max(trace, 0.0) and values[k] > 0]
    if not kept:
        return spark.createDataFrame([], RESULT)
    turn = vectors[:, kept] / np.sqrt(values[kept])
    count = len(kept)
    explained = (values[kept] / trace).tolist()

    def project(x: np.ndarray) -> np.ndarray:
        return centre.centred(x) @ turn

    moments = second_moments(fit, count, project)
    mean = moments[count] / n
    error = float(np.abs(moments[:count] / n - np.outer(mean, mean) - np.eye(count)).max())

    def make():
        def step(ids, x):
            every = np.repeat(np.arange(len(x)), count)
            return {
                "vec_id": ids.take(pa.array(every)),
                "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                "n": np.full(len(every), n),
                "deviation": pa.array(centre.deviations(x), type=pa.int64()).take(pa.array(every)),
                "whitened": project(x).ravel(),
                "explained": np.tile(explained, len(x)),
                "identity_error": np.full(len(every), error),
            }

        return step, lambda: None

    return _mapped(fit, RESULT, make)
