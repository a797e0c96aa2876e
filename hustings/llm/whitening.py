"""Embedding whitening: principal components by contour integration (FEAST), and rows projected on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import materialize, private_names

#: Eigenvalues in one interval at most, unless they lie too close to be parted; quadrature nodes on a half circle; rounds of a subspace.
PER_INTERVAL, NODES, ROUNDS = 6, 8, 60
#: Covariance entries that a task sends out are exact sums: integers of less than 2 to this power are exact in doubles.
EXACT = 53


@dataclass
class Fit:
    """What whitening is made of: the number of fitted vectors, the integer sums S, the covariance, its first components and their eigenvalues."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray
    values: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)


def positive_count(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``shift``: the positive pivots of a symmetric elimination of matrix - shift (Sylvester's
    law of inertia). The largest pivot left, or the 2 x 2 block of the largest entry where that is not large, comes next."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(np.argmax(diagonal))
        off = np.abs(a - np.diag(np.diag(a)))
        most = off.max() if len(a) > 1 else 0.0
        if diagonal[p] == 0.0 and most == 0.0:
            break
        if diagonal[p] >= 0.6 * most:
            block = [p]
            above += a[p, p] > 0
        else:
            block = [int(x) for x in np.unravel_index(np.argmax(off), off.shape)]
            above += 1  # such a block has one positive and one negative eigenvalue
        rest = np.setdiff1d(np.arange(len(a)), block)
        left = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - left @ np.linalg.solve(a[np.ix_(block, block)], left.T)
        a = (a + a.T) / 2
    return int(above)


def intervals(matrix: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count), from the top of the spectrum down, that hold at least the ``wanted`` largest eigenvalues, or all positive ones.

    Counts are by inertia. An interval is halved while it holds more than ``most``, or is wide for the eigenvalues in it.
    """
    high = float(np.max(np.sum(np.abs(matrix), axis=1))) * (1 + 1e-6)
    floor = high * len(matrix) * np.finfo(float).eps
    if not high > 0:
        return []
    all_, out, found = positive_count(matrix, floor), [], 0
    stack = [(floor, high, all_, 0)]  # low, high, how many are above low, above high
    while stack and found < min(wanted, all_):
        low, up, above_low, above_up = stack.pop()
        count = above_low - above_up
        if not count:
            continue
        # a cut near an eigenvalue parts badly, so the middle is moved a little where counts on both of its sides differ
        if (count > most or up > 4 * low) and up - low > 1e-9 * high:
            for at in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7):
                middle = low + at * (up - low)
                near = 1e-4 * (up - low)
                n = positive_count(matrix, middle)
                if n == positive_count(matrix, middle - near) == positive_count(matrix, middle + near):
                    break
            stack += [(low, middle, above_low, n), (middle, up, n, above_up)]
            continue
        out.append((low, up, count))
        found += count
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors) of a symmetric matrix between ``low`` and ``high``, which hold ``count``.

    A random block is filtered by the resolvent, integrated along a circle around the interval by Gauss-Legendre quadrature; each node is a solve
    with a complex shift. What is left is made orthonormal and diagonalised in its own small space (Rayleigh-Ritz). Rounds go on until as many
    Ritz pairs as the inertia says lie inside, with residuals of rounding size. A larger block is tried before it is an error.
    """
    d = len(matrix)
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    angle = np.pi / 2 * (1 - x)
    shifts = centre + radius * np.exp(1j * angle)
    inverses = [np.linalg.inv(z * np.eye(d) - matrix) for z in shifts]
    limit = 4 * d * np.finfo(float).eps * float(np.max(np.sum(np.abs(matrix), axis=1)))
    for size in (min(d, 2 * count + 4), min(d, 4 * count + 16), d):
        block = np.random.RandomState(seed).standard_normal((d, size))
        last = np.inf
        for _ in range(ROUNDS):
            filtered = sum(wi * np.real(radius * np.exp(1j * t) * (inv @ block)) for wi, t, inv in zip(w, angle, inverses, strict=True)) / 2
            basis, singular, _ = np.linalg.svd(filtered, full_matrices=False)
            basis = basis[:, singular > singular[0] * d * np.finfo(float).eps]
            values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ inner
            inside = (values > low) & (values < high)
            worst = float(np.max(np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0), initial=0.0))
            if inside.sum() == count and worst <= limit and worst >= last / 2:
                return values[inside], block[:, inside]
            last = worst
    raise ArithmeticError(f"found {int(inside.sum())} of {count} eigenvalues between {low} and {high}, residual {worst}")


def components_of(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as rows): the ``wanted`` largest. Intervals do not depend on each other and are tasks of a Spark job."""
    spans = intervals(matrix, wanted)
    if not spans:
        return np.empty(0), np.empty((0, len(matrix)))
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values, vectors = feast(shared.value, low, high, count)
                yield pa.RecordBatch.from_pydict({"value": values.tolist(), "vector": vectors.T.tolist()}, schema=pa.schema([("value", pa.float64()), ("vector", pa.list_(pa.float64()))]))

    rows = spark.createDataFrame([(float(a), float(b), c) for a, b, c in spans], "low double, high double, count int").repartition(len(spans)).mapInArrow(run, "value double, vector array<double>").collect()
    rows.sort(key=lambda r: -r.value)
    found = np.array([r.vector for r in rows[:wanted]])
    top = np.argmax(np.abs(found), axis=1)
    return np.array([r.value for r in rows[:wanted]]), found * np.sign(found[np.arange(len(found)), top])[:, None]


def as_integers(df: DataFrame, vector: str, name: str = "x") -> DataFrame:
    """``df`` with ``name``: floor(64 c) + 1000000 for each entry c. Rows whose vector is null or empty, or holds null or non-finite entries, go."""
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return df.filter(whole).withColumn(name, F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + 1000000))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sum_products(rows: DataFrame, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of ``x`` - ``middle`` over rows, as exact Python integers. Tasks send the sums of their rows."""
    d = len(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(i, 4096)) - middle
                most = int(np.abs(x).max(initial=0))
                small = most * most * len(x) < 1 << EXACT
                y = x.astype(np.float64) if small else x.astype(object)
                sums += y.sum(axis=0).astype(np.int64) if small else y.sum(axis=0)
                products += (y.T @ y).astype(np.int64) if small else y.T @ y
        i, j = np.triu_indices(d)
        at = [*[(k, -1, str(v)) for k, v in enumerate(sums)], *zip(i.tolist(), j.tolist(), map(str, products[i, j]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*at, strict=True)], names=["i", "j", "v"])

    sent = rows.select("x").mapInArrow(run, "i long, j long, v string")
    sums, products = np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    for i, j, v in sent.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        if j < 0:
            sums[i] = int(v)
        else:
            products[i, j] = products[j, i] = int(v)
    return sums, products


def fit_whitening(fit: DataFrame, wanted: int = 16) -> Fit | None:
    """The fit of distinct integer vectors ``x`` of one length (a written table); None without rows.

    Sums are taken first. Products are of entries less the integer nearest to their mean, exact whatever the order of tasks; the covariance is
    the exact one, rounded once. The driver sees one number for each pair of dimensions, never a row.
    """
    sums = {p: int(s) for p, s in fit.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    if not sums:
        return None
    n, total = fit.count(), [sums[p] for p in range(len(sums))]
    middle = np.array([round(Fraction(s, n)) for s in total], dtype=np.int64)
    shifted, products = _sum_products(fit, middle)
    covariance = np.array([[float(Fraction(int(products[i, j]) * n - int(shifted[i]) * int(shifted[j]), n * n)) for j in range(len(total))] for i in range(len(total))])
    values, components = components_of(fit.sparkSession, covariance, wanted)
    return Fit(n, total, covariance, components, values)


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n x - S, exact, as whole numbers (objects where 64 bits may not do)."""
    middle = np.array([round(Fraction(s, fit.n)) for s in fit.sums], dtype=np.int64)
    rest = np.array([s - fit.n * int(m) for s, m in zip(fit.sums, middle.tolist(), strict=True)], dtype=object)
    away = x - middle
    if (int(np.abs(away).max(initial=0)) + 1) * fit.n < 1 << 62:
        return away * fit.n - rest.astype(np.int64)
    return away.astype(object) * fit.n - rest


def _projected(y: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened values (rows x components) of n x - S."""
    return (y / fit.n).astype(np.float64) @ fit.components.T / np.sqrt(fit.values)


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened rows of the fit list minus the identity, by one more pass over them."""
    k = len(fit.values)
    shared = rows.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                w = _projected(_centred(_matrix(batch.column(0).slice(i, 4096)), shared.value), shared.value)
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        at = [*[(i, -1, v) for i, v in enumerate(sums.tolist())], *[(i, j, float(products[i, j])) for i in range(k) for j in range(i, k)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*at, strict=True)], names=["i", "j", "v"])

    mean, second = np.zeros(k), np.zeros((k, k))
    for i, j, v in rows.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if j < 0:
            mean[i] = v / fit.n
        else:
            second[i, j] = second[j, i] = v / fit.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


@private_names
def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", wanted: int = 16) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each row of ``df`` with a whole vector and each component.

    Entries become integers (:func:`as_integers`); the fit list is each distinct vector once, so copies weigh nothing. Components are numbered by falling
    eigenvalue of the fit list's covariance; of either direction, the one whose largest entry is positive is taken. A component without variance (as
    when there are fewer vectors than components, or all are equal) cannot be scaled and is left out. deviation is the exact sum of (n x - S)
    squared; one beyond 64 bits is an error. Vectors have the length that most distinct ones have (of equals the longest); others are left out. Null and repeated
    ids are kept as they are. An empty table gives an empty one.

    Distinct vectors are dealt by their value, copies being dropped before the shuffle; then all are passes whose tasks send sums of a number by
    dimensions: sums, products, and a check of the result. Nothing but those reaches the driver.
    """
    spark = df.sparkSession
    rows = as_integers(df.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v").select("id", "x")
    distinct = materialize(rows.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit_list = distinct.filter(F.size("x") == lengths[0]) if lengths else distinct
    fit = fit_whitening(fit_list, wanted) if lengths else None
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    error = identity_error(fit_list, fit)
    k, shared = len(fit.values), spark.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                y = _centred(_matrix(part.column(1)), f)
                squares = y.astype(np.float64)
                exact = y if float((squares * squares).sum(axis=1).max(initial=0)) < 1 << 62 else y.astype(object)
                deviation = (exact * exact).sum(axis=1)
                m = len(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, f.n)),
                        pa.array([int(v) for v in np.repeat(deviation, k)], type=pa.int64()),
                        pa.array(_projected(y, f).ravel()),
                        pa.array(np.tile(f.explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.filter(F.size("x") == lengths[0]).mapInArrow(run, schema).withColumnRenamed("id", id)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
