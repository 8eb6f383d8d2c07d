"""Embedding whitening by incremental eigendecomposition.

Vectors become integers, floor(256 * entry); the fit list holds each distinct integer vector
once. Every partition of the fit list keeps the eigendecomposition of its own scatter matrix
and takes its vectors in as centred rank-one updates: in the basis of the eigenvectors such an
update is diagonal plus rank one, whose eigenvalues are the roots of a secular equation (one
between two neighbouring poles, solved for all at once); directions that the vector does not
touch, and all but one of equal eigenvalues, are deflated, that is left as they are. Spectra of
partitions are combined along a tree of the same updates, one per eigenvector of the smaller
part and one for the distance of the means. The combined basis is refined by Rayleigh-Ritz: the
covariance of the whole fit list inside that basis, summed by tasks from centred vectors, is
solved exactly; the basis has all dimensions, so the result is V's eigenvectors to double precision.

Scale: a partition's state has d^2 numbers whatever its rows; states meet in groups of TREE
(written tables between the rounds), and one state reaches the driver. Sums and deviations are
exact integers. The components, d * 4 numbers, go out with the tasks.

Rows: a null vector and one with null or non-finite entries is dropped; repeated vectors count
once in the fit list, each row keeps its own result. Vectors shorter than the longest are padded
with 0; entries beyond 2**53 in size are held at that bound. Fewer than 4 dimensions give fewer
components; a component without variance has no whitened coordinate and is left out (equal
vectors only: no rows). A deviation beyond 64 bits is null. An empty table gives no rows. Only
vec_id and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrmill.llm.common import Workspace, arrow_stage

COMPONENTS = 4
SCALE = 256
LARGEST = 2**53
#: States that one task combines.
TREE = 32
#: Rank-one updates after which the basis is made orthonormal again.
RENEW = 512
#: An eigenvalue below this share of the trace is no variance.
NOTHING = 1e-13
_EPS = np.finfo(float).eps
#: Relative change of a root's offset at which it counts as found (the vectors that follow from
#: the roots are orthogonal at any precision, and the refinement is exact).
ROOT = 1e-10


# ---- rank-one updates ---------------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z', d strictly ascending, z2 = z * z > 0: root i lies between
    d[i] and d[i + 1] (the last below d[-1] + sum(z2)). Returned as the nearer pole of each root
    and the offset from it, which keeps the digits that a difference of close numbers would lose."""
    k = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = right - d
    index = np.arange(k)
    upper = np.minimum(index + 1, k - 1)
    # the sign of the function in the middle tells which pole is nearer
    middle = 1.0 + (1.0 / (d - (d + 0.5 * gap)[:, None])) @ z2
    near_right = (middle < 0) & (index < k - 1)
    origin = np.where(near_right, upper, index)
    poles = d - d[origin][:, None]
    lo = np.where(near_right, -0.5 * gap, 0.0)
    hi = np.where(near_right, 0.0, 0.5 * gap)
    last_far = middle[-1] < 0  # the last root may lie in the outer half
    if last_far:
        lo[-1], hi[-1] = 0.5 * gap[-1], gap[-1]
    x = 0.5 * (lo + hi)
    left_pole, right_pole = poles[index, index], poles[index, upper]
    for _ in range(steps):
        inverse = 1.0 / (poles - x[:, None])
        f = 1.0 + inverse @ z2
        slope = (inverse * inverse) @ z2
        rising = f > 0  # f grows between two poles
        hi = np.where(rising, x, hi)
        lo = np.where(rising, lo, x)
        # two poles, one of its true weight, fitted to f and its slope (the last root has one pole)
        a, b = left_pole - x, right_pole - x
        near = np.where(near_right, b, a)
        far = np.where(near_right, a, b)
        weight = z2[origin]
        rest = (slope - weight / (near * near)) * far * far
        c = f - weight / near - rest / far
        # c + weight / (near - t) + rest / (far - t) = 0, a quadratic in t
        p = c * (near + far) + weight + rest
        q = f * near * far
        root = np.sqrt(np.maximum(p * p - 4.0 * c * q, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = 2.0 * q / (p + np.where(p >= 0, root, -root))
            other = (p + np.where(p >= 0, root, -root)) / (2.0 * c)
            y = x + t
            y = np.where((y >= lo) & (y <= hi), y, x + other)
            inside = (y >= lo) & (y <= hi) & (y != 0)  # 0 is the pole itself
        y = np.where(inside, y, 0.5 * (lo + hi))
        done = np.abs(y - x) <= ROOT * np.abs(y)
        x = y
        if done.all():
            break
    return origin, x


def _exact_weights(d: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """The |z| whose secular equation has exactly the computed roots (Loewner's formula): with
    it, eigenvectors are orthogonal however close two roots are."""
    k = len(d)
    below = np.tril(np.ones((k, k), bool), -1)  # pole i, root j < i
    gaps = np.where(below, d, np.append(d[1:], 0.0)) - d[:, None]
    gaps[:, -1] = 1.0
    return np.sqrt(np.abs(np.prod(-differences.T / gaps, axis=1)))


def rank_one_update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of vectors diag(values) vectors' + v v', values ascending."""
    z = v @ vectors
    scale = max(float(values[-1]), float(z @ z))
    if scale == 0.0:
        return values, vectors
    # deflation: directions that v does not touch stay
    live = np.abs(z) * np.sqrt(scale) > 8 * _EPS * scale
    close = np.diff(values) <= 8 * _EPS * scale
    if close.any():  # of equal eigenvalues, rotate the part of v into the last one
        vectors, z = vectors.copy(), z.copy()
        for i in np.flatnonzero(close):
            r = np.hypot(z[i], z[i + 1])
            if live[i] and r > 0:
                c, s = z[i + 1] / r, z[i] / r
                vectors[:, [i, i + 1]] = np.stack([c * vectors[:, i] - s * vectors[:, i + 1], s * vectors[:, i] + c * vectors[:, i + 1]], 1)
                z[i], z[i + 1] = 0.0, r
                live[i], live[i + 1] = False, True
    at = np.flatnonzero(live)
    if not len(at):
        return values, vectors
    d = values[at]
    origin, offset = secular_roots(d, z[at] ** 2)
    differences = (d - d[origin][:, None]) - offset[:, None]  # [root, pole]: pole - root
    w = np.copysign(_exact_weights(d, differences), z[at])
    basis = w / differences
    basis /= np.sqrt(np.einsum("ij,ij->i", basis, basis))[:, None]
    values = values.copy()
    values[at] = d[origin] + offset
    if len(at) == len(values):
        vectors = vectors @ basis.T
    else:
        vectors = vectors.copy() if not close.any() else vectors
        vectors[:, at] = vectors[:, at] @ basis.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums and the eigendecomposition of the scatter matrix of some vectors."""

    def __init__(self, dims: int) -> None:
        self.n, self.sums = 0, [0] * dims
        self.mean = np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)
        self.updates = 0

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one_update(self.values, self.vectors, v)
        self.updates += 1
        if self.updates % RENEW == 0:
            self.vectors = np.linalg.qr(self.vectors)[0]

    def add(self, rows: np.ndarray) -> None:
        """Takes in integer vectors, each as one centred rank-one update."""
        for x in rows.astype(float):
            delta = x - self.mean
            if self.n:
                self._update(np.sqrt(self.n / (self.n + 1)) * delta)
            self.n += 1
            self.mean = self.mean + delta / self.n
        high, low = (rows >> 26).sum(0), (rows & (2**26 - 1)).sum(0)
        self.sums = [s + (int(h) << 26) + int(lo) for s, h, lo in zip(self.sums, high, low)]

    def merge(self, other: Spectrum) -> None:
        """Takes in another part: its mean's distance and each of its eigenvectors, rank one each."""
        both = self.n + other.n
        self._update(np.sqrt(self.n * other.n / both) * (other.mean - self.mean))
        for value, q in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * q)
        self.n, self.sums = both, [a + b for a, b in zip(self.sums, other.sums)]
        self.mean = np.array([s / both for s in self.sums])

    SCHEMA = "part long, n long, sums array<string>, values array<double>, vectors array<double>"

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": [str(s) for s in self.sums], "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(len(row["sums"]))
        out.n, out.sums = int(row["n"]), [int(s) for s in row["sums"]]
        out.mean = np.array([s / out.n for s in out.sums])
        out.values, out.vectors = np.array(row["values"], float), np.array(row["vectors"], float).reshape(len(out.sums), -1)
        return out


# ---- stages -------------------------------------------------------------------------------


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector has only finite entries."""
    entry = lambda c: c.cast("double")
    bounded = lambda c: F.least(F.greatest(entry(c) * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(entry(c)) < float("inf"), F.lit(False)))
    rows = table.filter(F.col("embedding").isNotNull()).filter(finite)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(bounded(c)).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _combine(work: Workspace, states: DataFrame, merge, schema: str):
    """One row out of a table of states (with column part): groups of TREE states are merged by a
    task each, round by round. None for an empty table."""
    states = work.save(states, "states")
    while (left := states.count()) > 1:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([merge(pdf.sort_values("part").to_dict("records"))])

        # parts are renumbered by a window over the few states of a round, bounded by the tasks
        up = states.groupBy(F.expr(f"part div {TREE}").alias("up")).applyInPandas(run, schema)
        states = work.save(up.withColumn("part", F.expr(f"part div {TREE}")), "states")
        if states.count() == left:  # sparse part numbers: the next round's groups are wider
            continue
    return states.first()


def spectrum(work: Workspace, fit: DataFrame, dims: int) -> Spectrum | None:
    """The eigendecomposition of the scatter matrix of the whole fit list."""

    def one(batches: Iterator[pa.RecordBatch]):
        own = Spectrum(dims)
        for b in batches:
            own.add(_matrix(b, dims))
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row(_task())], schema=_STATE)

    def merge(rows: list[dict]) -> dict:
        parts = sorted((Spectrum.of(r) for r in rows), key=lambda s: -s.n)
        for other in parts[1:]:
            parts[0].merge(other)
        return parts[0].row(rows[0]["part"])

    found = _combine(work, arrow_stage(fit, one, Spectrum.SCHEMA), merge, Spectrum.SCHEMA)
    return Spectrum.of(found) if found else None


_STATE = pa.schema(
    [("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]
)


class Centre:
    """x - S / n without rounding S / n: whole part and rest of the mean are taken off apart."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest * largest * max(1, len(self.sums)) < 2**63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        exact = [sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums)) for row in x]
        return [e if e < 2**63 else None for e in exact]


def _moments(work: Workspace, fit: DataFrame, dims: int, centre: Centre, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance (divisor n, centred before multiplying) of the fit list in a basis."""
    schema = "part long, total array<double>, cross array<double>"
    arrow = pa.schema([("part", pa.int64()), ("total", pa.list_(pa.float64())), ("cross", pa.list_(pa.float64()))])
    k = basis.shape[1]

    def one(batches: Iterator[pa.RecordBatch]):
        total, cross = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = centre(_matrix(b, dims)) @ basis
            total += y.sum(0)
            cross += y.T @ y
        yield pa.RecordBatch.from_pylist([{"part": _task(), "total": total.tolist(), "cross": cross.ravel().tolist()}], schema=arrow)

    def merge(rows: list[dict]) -> dict:
        add = lambda name: np.sum([np.asarray(r[name], float) for r in rows], axis=0).tolist()
        return {"part": rows[0]["part"], "total": add("total"), "cross": add("cross")}

    found = _combine(work, arrow_stage(fit, one, schema), merge, schema)
    mean = np.array(found["total"]) / centre.n
    return mean, np.array(found["cross"]).reshape(k, k) / centre.n


class Whitening:
    """What the transform needs: the centre, components (unit columns), their variances, shares."""

    def __init__(self, centre: Centre, components: np.ndarray, variances: np.ndarray, trace: float) -> None:
        self.centre, self.components, self.variances, self.trace = centre, components, variances, trace
        self.identity_error = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)


def fit_whitening(work: Workspace, vectors: DataFrame, dims: int, components: int = COMPONENTS, rows_a_task: int = 20_000) -> Whitening | None:
    """Components of the distinct vectors; None without vectors or without variance."""
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    distinct = work.save(vectors.select(padded.alias("x")).distinct(), "distinct")
    tasks = min(-(-distinct.count() // rows_a_task), 50_000)
    if not tasks or not dims:
        return None
    fit = work.save(distinct.repartition(tasks, "x"), "fit") if tasks > 1 else distinct
    whole = spectrum(work, fit, dims)
    centre = Centre(whole.n, whole.sums)
    basis = np.linalg.qr(whole.vectors)[0]
    _, inside = _moments(work, fit, dims, centre, basis)
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    values, found = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    keep = [i for i in range(min(components, dims)) if trace > 0 and values[i] > NOTHING * trace]
    if not keep:
        return None
    found = found[:, keep]
    found = found * np.sign(found[np.abs(found).argmax(0), range(len(keep))])
    out = Whitening(centre, found, values[keep], trace)
    mean, cross = _moments(work, fit, dims, centre, out.matrix)
    out.identity_error = float(np.abs(cross - np.outer(mean, mean) - np.eye(len(keep))).max())
    return out


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS, rows_a_task: int = 20_000) -> DataFrame:
    """One row per remaining vector and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error."""
    spark = table.sparkSession
    work = Workspace(spark)
    vectors = work.save(integer_vectors(table), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    model = fit_whitening(work, vectors, dims, components, rows_a_task)
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, {OUT}")
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    matrix, centre, error = model.matrix, model.centre, model.identity_error
    k = matrix.shape[1]
    explained = model.variances / model.trace

    def project(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = _matrix(b, dims)
            y = centre(x) @ matrix
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, centre.n, np.int64)),
                    pa.array([v for v in centre.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow_stage(vectors.select("vec_id", padded.alias("x")), project, f"vec_id {kind}, {OUT}")
