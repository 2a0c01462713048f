"""PCA whitening of vectors by a distributed covariance and a tridiagonal eigensolver.

Entries go to a whole-number grid, ``floor(64 * c) + 1000000``. The fit list
holds each distinct grid vector once (equal vectors meet before the shuffle).
One pass sums its dimensions exactly, one its products about the mean: every
task keeps a single matrix per vector length and sends its upper triangle once.
The driver holds that matrix (length squared numbers, whatever the row count)
and solves it: Householder reflections to tridiagonal form, bisection on Sturm
counts for the leading eigenvalues, inverse iteration for their vectors, with
reorthogonalisation where eigenvalues lie close. Mean and components are
broadcast; a last pass projects every row. A pass over the fit list measures
how far its whitened covariance is from the identity.

Rows whose vector is null or holds null or non-finite entries are dropped; an
empty vector has no component and so no row. Vectors of several lengths are
fitted apart, each length by its own list. Repeated rows each get their rows,
a null vec_id stays null. Directions without variance have ``whitened`` null and
``explained`` 0. ``deviation`` is null where a long cannot hold it; entries are
held within 2**61 on the grid. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.functions.checkpoints import checkpointed
from eqpanel.llm.common import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a batch handled at once.
ROWS = 4096
EPS = np.finfo(np.float64).eps
#: Eigenvalues closer than this share of the matrix norm are one cluster.
CLUSTER = 1e-3


def grid(rows: DataFrame) -> DataFrame:
    """vec_id and grid vector x of every usable row."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    edge = float(2**61)
    place = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-edge)), F.lit(edge))) + SHIFT
    return rows.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & ~bad).select("vec_id", F.transform("embedding", place).alias("x"))


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, whole-number matrix) of at most ``ROWS`` rows each."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    ends = np.cumsum(lengths)
    for d in np.unique(lengths[lengths > 0]):
        every = np.flatnonzero(lengths == d)
        for at in range(0, len(every), ROWS):
            rows = every[at : at + ROWS]
            yield int(d), rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


@dataclass
class Centre:
    """Exact sums of a fit list: the mean is ``floor + rest / n``."""

    n: int
    floor: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; None beyond a long."""
        off = x - self.floor
        reach = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if reach * reach * x.shape[1] < 2**63:
            return ((self.n * off - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in off.tolist()]
        return [v if v < 2**63 else None for v in exact]


def centres(fit: DataFrame) -> dict[int, Centre]:
    """Count and sums of the fit list, by vector length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                kept = total.setdefault(d, [0, np.zeros(d, object)])
                small = int(np.abs(x).max()) < 2**62 // len(x)
                kept[0] += len(x)
                kept[1] = kept[1] + (x.sum(axis=0) if small else x.astype(object).sum(axis=0))
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * (d + 1), "place": [*range(-1, d)], "s": [str(v) for v in [n, *s]]}, pa.schema([("d", pa.int32()), ("place", pa.int32()), ("s", pa.string())]))

    rows = fit.select("x").mapInArrow(sums, "d int, place int, s string").groupBy("d", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_length: dict[int, dict[int, int]] = {}
    for r in rows:
        by_length.setdefault(r.d, {})[r.place] = int(r.s)
    out = {}
    for d, sums_of in by_length.items():
        n = sums_of[-1]
        parts = [divmod(sums_of[i], n) for i in range(d)]
        out[d] = Centre(n, np.array([p for p, _ in parts], np.int64), np.array([r for _, r in parts], np.int64))
    return out


def second_moments(fit: DataFrame, of: dict[int, tuple[Centre, np.ndarray | None]]) -> dict[int, np.ndarray]:
    """Mean product of centred columns by vector length, after projection where a matrix is given."""
    shared = fit.sparkSession.sparkContext.broadcast(of)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                centre, onto = shared.value[d]
                c = centre.centred(x)
                c = c if onto is None else c @ onto
                total[d] = total.get(d, 0) + c.T @ c
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["d", "i", "j", "v"])

    rows = fit.select("x").mapInArrow(products, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in rows.groupby("d"):
        centre, onto = of[int(d)]
        m = np.zeros([len(centre.floor) if onto is None else onto.shape[1]] * 2)
        m[part["i"], part["j"]] = part["v"] / centre.n
        out[int(d)] = np.triu(m) + np.triu(m, 1).T
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and Householder reflectors of a symmetric matrix."""
    a = matrix.astype(np.float64, copy=True)
    reflectors: list[np.ndarray | None] = []
    for k in range(len(a) - 2):
        below = a[k + 1 :, k]
        size = np.linalg.norm(below)
        if size == 0 or not below[1:].any():
            reflectors.append(None)
            continue
        u = below.copy()
        u[0] += np.copysign(size, u[0])
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, below[0])
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of the shifted matrix."""
    tiny = np.finfo(np.float64).tiny / EPS
    q, count = np.ones(len(at)), np.zeros(len(at), np.int64)
    for d, e in zip(diag, np.r_[0, off], strict=True):
        q = (d - at) - e * e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts (all k at once)."""
    d = len(diag)
    beside = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = np.full(k, (diag - beside).min()), np.full(k, (diag + beside).max())
    slack = max(abs(low[0]), abs(high[0])) * EPS + np.finfo(np.float64).tiny
    low, high = low - slack, high + slack
    rank = d - np.arange(k)
    while True:
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high) | (high - low <= slack / 4)).all():
            return mid
        above = sturm_count(diag, off, mid) >= rank
        high, low = np.where(above, mid, high), np.where(above, low, mid)


def _solver(diag: np.ndarray, off: np.ndarray, at: float, tiny: float):
    """Solves (T - at) z = b by elimination with row exchanges; zero pivots become ``tiny``."""
    n = len(diag)
    d, up, up2, low = (diag - at).tolist(), [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(d[i]) < abs(low[i]):
            d[i], low[i], up[i], d[i + 1], up2[i], up[i + 1] = low[i], d[i], d[i + 1], up[i], up[i + 1], 0.0
            swapped[i] = True
        d[i] = d[i] if abs(d[i]) > tiny else tiny
        factor[i] = low[i] / d[i]
        d[i + 1] -= factor[i] * up[i]
        up[i + 1] -= factor[i] * up2[i]
    d[-1] = d[-1] if abs(d[-1]) > tiny else tiny

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= factor[i] * z[i]
        for i in range(n - 1, -1, -1):
            z[i] = (z[i] - (up[i] * z[i + 1] if i + 1 < n else 0.0) - (up2[i] * z[i + 2] if i + 2 < n else 0.0)) / d[i]
        return np.array(z)

    return solve


def vectors_of(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values`` by inverse iteration."""
    n = len(diag)
    norm = max(float(np.max(np.abs(diag) + np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off]))), np.finfo(np.float64).tiny / EPS)
    draws = np.random.default_rng(1)
    out = np.zeros((n, len(values)))
    start, before = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        # equal values are moved apart a little, or they give one vector again
        shift = min(value, before - 4 * EPS * norm) if k > start else value
        before = shift
        solve = _solver(diag, off, shift, EPS * norm)
        z = draws.standard_normal(n)
        for _ in range(6):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, start:k] @ (out[:, start:k].T @ z)
            if not np.abs(z).max() > n * EPS:
                z = draws.standard_normal(n)
                z -= out[:, start:k] @ (out[:, start:k].T @ z)
            z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns."""
    diag, off, reflectors = tridiagonal(matrix)
    z = vectors_of(diag, off, leading_values(diag, off, k))
    for at in range(len(reflectors) - 1, -1, -1):
        u = reflectors[at]
        if u is not None:
            z[at + 1 :] -= 2 * np.outer(u, u @ z[at + 1 :])
    z /= np.linalg.norm(z, axis=0)
    values = np.einsum("ij,ij->j", z, matrix @ z)
    order = np.argsort(-values, kind="stable")
    return values[order], z[:, order]


@dataclass
class Whitening:
    """Projection of one vector length; columns of ``onto`` without variance are zero."""

    centre: Centre
    values: np.ndarray
    explained: np.ndarray
    onto: np.ndarray
    live: np.ndarray
    identity_error: float = 0.0


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening by vector length from the distinct grid vectors ``fit(x)``, which is read three times."""
    centre = centres(fit)
    out = {}
    for d, v in second_moments(fit, {d: (c, None) for d, c in centre.items()}).items():
        values, vectors = leading_components(v, min(components, d))
        live = values > max(d, 16) * EPS * values[0] if values[0] > 0 else np.zeros(len(values), bool)
        trace = float(np.trace(v))
        onto = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
        out[d] = Whitening(centre[d], values, np.where(live, values / (trace or 1.0), 0.0), onto, live)
    for d, m in second_moments(fit, {d: (w.centre, w.onto) for d, w in out.items()}).items():
        out[d].identity_error = float(np.abs(m - np.diag(out[d].live.astype(float))).max())
    return out


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row."""
    given = grid(rows)
    fits = fit_whitening(checkpointed(given.select("x").distinct()), components)
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _matrices(batch.column(1)):
                w = shared.value[d]
                k = len(w.values)
                values = w.centre.centred(x) @ w.onto
                each = lambda a: np.repeat(a, k)
                every = lambda a: np.tile(a, len(at))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(each(at))), pa.array(every(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(at) * k, w.centre.n)),
                    pa.array(w.centre.deviation(x), pa.int64()).take(pa.array(each(np.arange(len(at))))),
                    pa.array(values.ravel(), mask=every(~w.live)), pa.array(every(w.explained)), pa.array(np.full(len(at) * k, w.identity_error)),
                ], schema=schema)

    return given.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
