"""Operator 12: whitening of embeddings by incremental eigendecomposition.

A partition keeps the spectrum of its own centred scatter and takes in each vector as a rank-one update: the new
eigenvalues are roots of a secular equation, and directions that the vector does not touch, or that share an eigenvalue,
are deflated. Spectra of partitions are combined in a tree by the same updates. Passes over the rows then project them on
the combined basis, add up the small matrices and rotate the basis by their eigenvectors (Rayleigh-Ritz), until the
whitened rows are uncorrelated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, field, stored

#: An entry c counts as floor(SCALE * c) + SHIFT. Entries beyond 2^33 in size count as that, so that sums stay exact.
SCALE, SHIFT, MOST = 64, 1_000_000, 2.0**33
#: Relative size under which a coordinate, or a gap between eigenvalues, is deflated; steps to a root at most.
TINY, STEPS = 8 * np.finfo(float).eps, 60
#: Summaries that one task combines; Rayleigh-Ritz passes at most, and the error of whitening at which they end.
FAN, PASSES, ENOUGH = 16, 6, 1e-9
LONG = 1 << 63

SUMMARY = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.StringType())), T.StructField("matrix", T.BinaryType())])


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)) for ascending distinct d, z without zeros and rho > 0: each as the index of
    the nearer pole and the distance from it, which keeps roots close to a pole exact.

    All roots are sought at once. A step takes the root of a fraction with the two poles around it that has the sums'
    values and slopes on either side; a step that leaves its bracket halves the bracket instead.
    """
    k, weights = len(d), rho * z * z
    at = np.arange(k)
    gaps = np.append(d[1:] - d[:-1], weights.sum())
    away = d[None, :] - d[:, None]  # pole j seen from pole i
    middle = 1 + (weights / (away - gaps[:, None] / 2)).sum(axis=1)
    # the function rises from one pole to the next, so its sign at the middle tells which half holds the root
    right = (middle < 0) & (at < k - 1)
    origin = at + right
    low = np.where(right, -gaps / 2, np.where(middle < 0, gaps / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, gaps, gaps / 2))
    away = away[origin]
    left_pole, right_pole = away[at, at], away[at, np.minimum(at + 1, k - 1)]
    before, eps = np.tri(k), np.finfo(float).eps  # poles up to the root's own
    x = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            apart = away - x[:, None]
            part = weights / apart
            slope = part / apart
            psi, psi_slope = np.einsum("ij,ij->i", part, before), np.einsum("ij,ij->i", slope, before)
            phi, phi_slope = part.sum(axis=1) - psi, slope.sum(axis=1) - psi_slope
            f = 1 + psi + phi
            # as near to zero as rounding of the sums lets it come
            done = np.abs(f) <= 2 * eps * (1 + np.abs(psi) + np.abs(phi))
            if done.all():
                break
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            p, q = left_pole - x, right_pole - x
            s, t = psi_slope * p * p, phi_slope * q * q
            c = f - psi_slope * p - phi_slope * q
            a, b = c * (p + q) + s + t, p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = p[-1] + s[-1] / c[-1]  # the last root has poles on one side only
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            done |= np.abs(new - x) <= 2 * eps * np.abs(new)
            x = np.where(done, x, new)
            if done.all():
                break
    return origin, x


@dataclass
class Spectrum:
    """n vectors, their mean, and the eigenvalues (ascending) and eigenvectors (columns) of their centred scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def update(self, vector: np.ndarray, rho: float) -> None:
        """Scatter + rho * vector vector^T."""
        d, z = self.values, self.vectors.T @ vector
        size = float(np.sqrt(z @ z))
        if rho <= 0 or size == 0:
            return
        scale = max(float(d[-1]), rho * size * size)
        # equal eigenvalues: one Givens rotation each moves all of the vector into the last of a run
        for i in np.flatnonzero(d[1:] - d[:-1] <= TINY * scale):
            if z[i] == 0:
                continue
            r = float(np.hypot(z[i], z[i + 1]))
            c, s = z[i + 1] / r, z[i] / r
            a, b = self.vectors[:, i].copy(), self.vectors[:, i + 1]
            self.vectors[:, i], self.vectors[:, i + 1] = c * a - s * b, s * a + c * b
            z[i], z[i + 1] = 0.0, r
        live = np.flatnonzero(rho * np.abs(z) * size > TINY * scale)
        if not len(live):
            return
        poles, weights = d[live], z[live]
        origin, shift = secular_roots(poles, weights, rho)
        # distances of poles (rows) from roots (columns), without cancellation
        apart = (poles[:, None] - poles[origin][None, :]) - shift[None, :]
        # the vector whose update has exactly these roots, so that the eigenvectors come out orthogonal
        between = poles[:, None] - poles[None, :]
        np.fill_diagonal(between, 1.0)
        ratio = -apart / between
        ratio[np.diag_indices_from(ratio)] = -np.diagonal(apart)
        fitted = np.sqrt(np.abs(np.prod(np.abs(ratio), axis=1) / rho)) * np.sign(weights)
        turn = fitted[:, None] / np.where(apart == 0, np.finfo(float).tiny, apart)
        turn /= np.sqrt((turn * turn).sum(axis=0))
        self.vectors[:, live] = self.vectors[:, live] @ turn
        self.values = d.copy()
        self.values[live] = np.maximum(poles[origin] + shift, 0.0)
        order = np.argsort(self.values, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.values, self.vectors = self.values[order], self.vectors[:, order]

    def take(self, x: np.ndarray) -> None:
        """One more vector, centred by the mean before and after it."""
        apart = x - self.mean
        self.n += 1
        self.mean = self.mean + apart / self.n
        self.update(apart, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        """The other spectrum's directions, then the line between both means, each as a rank-one update."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, direction in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(direction, float(value))
        n, apart = self.n + other.n, other.mean - self.mean
        self.update(apart, self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n

    def packed(self) -> bytes:
        return np.concatenate([self.mean, self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, n: int, data: bytes, dims: int) -> Spectrum:
        a = np.frombuffer(data, "<f8")
        return cls(n, a[:dims].copy(), a[dims : 2 * dims].copy(), a[2 * dims :].reshape(dims, dims).copy())


def fit_rows(df: DataFrame, id_col: str, vector_col: str, dims: int | None) -> tuple[DataFrame, int]:
    """id and x (array of long) of the rows that are fitted, written once, and the number of dimensions."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = lambda v: F.greatest(F.least(v, F.lit(MOST)), F.lit(-MOST))
    x = F.transform(c, lambda v: F.floor(bound(v) * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = stored(df.where(whole).select(F.col(id_col).alias("id"), x.alias("x")))
    if dims is None:
        most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dims = most["d"] if most else 0
    return rows.where(F.size("x") == dims), dims


def matrix_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def folded(parts: DataFrame, merge: Callable[[list[tuple]], bytes], fan: int = FAN) -> tuple[int, list[int], bytes] | None:
    """One summary out of one per partition, by a tree of joint steps: `fan` summaries at a time in a task. Each level is
    written, so a lost executor repeats one step. n and the exact sums are added here; merge joins the matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["node"])
        groups: dict[int, list[dict]] = {}
        for r in rows:
            groups.setdefault(r["node"] // fan, []).append(r)
        for group, held in groups.items():
            sums = [str(sum(map(int, column))) for column in zip(*(r["sums"] for r in held), strict=True)]
            joined = merge([(r["n"], r["sums"], r["matrix"]) for r in held]) if len(held) > 1 else held[0]["matrix"]
            yield pa.RecordBatch.from_pylist([{"node": group, "n": sum(r["n"] for r in held), "sums": sums, "matrix": joined}], schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("matrix", pa.binary())]))

    parts = stored(parts)
    top = parts.agg(F.max("node")).first()[0]
    while top:
        groups = top // fan + 1
        joint = stored(parts.repartition(groups, F.expr(f"node div {fan}")).mapInArrow(run, SUMMARY))
        discard(parts)
        parts, top = joint, groups - 1
    found = parts.collect()  # one row
    discard(parts)
    return (found[0]["n"], [int(s) for s in found[0]["sums"]], bytes(found[0]["matrix"])) if found else None


def partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def summary(n: int, sums: list[int], matrix: bytes) -> pa.RecordBatch:
    arrays = [pa.array([partition_number()], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([matrix], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=SUMMARY.names)


def spectrum_of(rows: DataFrame, dims: int) -> tuple[int, list[int], Spectrum] | None:
    """n, exact sums and the combined spectrum of all rows."""

    def run(batches):
        own, sums = Spectrum.empty(dims), [0] * dims
        for batch in batches:
            x = matrix_of(batch, dims)
            sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]
            for row in x.astype(float):
                own.take(row)
        if own.n:
            yield summary(own.n, sums, own.packed())

    def merge(held):
        first = Spectrum.unpacked(held[0][0], held[0][2], dims)
        for n, _, data in held[1:]:
            first.merge(Spectrum.unpacked(n, data, dims))
        return first.packed()

    found = folded(rows.select("x").mapInArrow(run, SUMMARY), merge)
    return found and (found[0], found[1], Spectrum.unpacked(found[0], found[2], dims))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as doubles. The whole part of S/n goes off in whole numbers, so that nothing cancels."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def covariance(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the rows' coordinates in the basis: partial sums per partition, added in a tree."""
    dims, k = basis.shape

    def run(batches):
        total, count = np.zeros((k + 1, k)), 0
        for batch in batches:
            y = centred(matrix_of(batch, dims), n, sums) @ basis
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
            count += len(y)
        if count:
            yield summary(count, [], total.tobytes())

    merge = lambda held: np.sum([np.frombuffer(data) for _, _, data in held], axis=0).tobytes()
    _, _, data = folded(rows.select("x").mapInArrow(run, SUMMARY), merge)
    total = np.frombuffer(data).reshape(k + 1, k)
    mean = total[k] / n
    return total[:k] / n - np.outer(mean, mean)


def refined(rows: DataFrame, n: int, sums: list[int], start: Spectrum, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Eigenvalues (falling) and eigenvectors of the covariance, its trace, and the largest entry by which the covariance
    of the whitened first k coordinates misses the identity, as measured over the rows."""
    basis, _ = np.linalg.qr(start.vectors[:, ::-1])
    measured = covariance(rows, n, sums, basis)
    for _ in range(PASSES):
        values, turn = np.linalg.eigh(measured)
        basis, _ = np.linalg.qr(basis @ turn[:, ::-1])
        values = np.maximum(values[::-1], 0.0)
        measured = covariance(rows, n, sums, basis)
        live = values[:k] > values[0] * len(values) * np.finfo(float).eps
        scale = 1 / np.sqrt(values[:k][live])
        error = np.abs(measured[:k, :k][np.ix_(live, live)] * np.outer(scale, scale) - np.eye(live.sum()))
        worst = float(error.max()) if error.size else 0.0
        if worst <= ENOUGH:
            break
    return values, basis, float(np.trace(measured)), worst


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; null where it exceeds a long."""
    far = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True)), default=0)
    if len(sums) * far * far < LONG and all(abs(s) < LONG for s in sums) and n * int(np.abs(x).max()) < LONG:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < LONG else None for v in exact]


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, dims: int | None = None) -> DataFrame:
    """One row per remaining row and component: id, component (from 1), n, deviation, whitened, explained, identity_error,
    eigenvalue.

    Rows whose vector is null, empty, or holds a null, NaN or infinity are left out, as are rows of another length than
    dims (None: the commonest length, the longest of equally common ones). Without rows the result is empty. An entry c
    counts as floor(64 * c) + 1000000; entries beyond 2^33 in size count as that. All covariances have divisor n, the
    number of remaining rows. deviation is the sum over dimensions of (n*x - S)^2, S the sums of x; null where a long does
    not hold it. A component without variance, or with less than a double
    tells from none beside the largest (rank-deficient data, a single row, equal rows), has whitened null and
    explained 0; with no variance at all explained is null. Equal eigenvalues leave their components' directions open
    within the space they span. Repeated rows and ids, and null ids, count and come out as often as they occur; other
    columns of df are not read.

    A partition holds one spectrum (dims x dims doubles) whatever its rows; the driver sees one spectrum and one such
    matrix per pass. Each step's rows come from written tables.
    """
    rows, dims = fit_rows(df, id_col, vector_col, dims)
    k = min(components, dims)
    out = T.StructType([field(df, id_col), *[T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()), ("eigenvalue", T.DoubleType()))]])
    fitted = spectrum_of(rows, dims) if dims else None
    if not fitted:
        return df.sparkSession.createDataFrame([], out)
    n, sums, start = fitted
    values, basis, trace, worst = refined(rows, n, sums, start, k)
    live = values[:k] > values[0] * dims * np.finfo(float).eps
    scale = np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    project = basis[:, :k] * scale

    def run(batches):
        for batch in batches:
            x = matrix_of(batch, dims)
            if not len(x):
                continue
            flat = pa.array((centred(x, n, sums) @ project).ravel())
            if not live.all():
                flat = pa.array(flat.to_numpy(), mask=np.tile(~live, len(x)))
            ends = pa.array(np.arange(0, k * len(x) + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["id", "deviation", "w"])

    made = rows.mapInArrow(run, T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))]))
    each = made.select("id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values[:k]])
    value = F.array(*[F.lit(float(v)) for v in values[:k]])
    return each.select(
        F.col("id").alias(id_col), (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(worst).alias("identity_error"), F.get(value, F.col("_at")).alias("eigenvalue"),
    )
