"""Whitening of embeddings by leading principal components, found by Jacobi-Davidson.

Vectors are put on a whole-number grid, so equal ones are recognised, counts and sums are
exact and every row is centred without loss.  The covariance matrix is never formed: a pass
over the blocks of the fit list gives its product with a few vectors, each block centred
before it is multiplied.  The solver on the driver holds a search space of a few dozen
columns: Rayleigh-Ritz gives approximate eigenvectors, projected correction equations are
solved for all that are not yet exact by a few steps of MINRES side by side (one pass a
step), the corrections widen the space, and pairs whose residual is at double precision are
locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Grid: whole number floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries whose grid number would not be safe as a long.
LIMIT = float(1 << 61)
#: Partial sums that the driver takes at once; more are summed in groups first.
FAN = 256
#: Steps of MINRES for each correction, columns of the search space for each component wanted.
INNER, SPACE = 5, 6
#: A residual counts as exact below this many units in the last place of the largest eigenvalue.
ULPS = 64
_GRID = "__grid"
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def _offsets(column: pa.Array, dim: int | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows that have a usable vector, and (rows, grid numbers less SHIFT) for each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # a null entry becomes nan
    scaled = np.floor(values * SCALE)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(scaled) < LIMIT)
    ends = np.cumsum(lengths)
    spoilt = np.r_[0, np.cumsum(bad)]
    fine = (lengths > 0) & (spoilt[ends] == spoilt[ends - lengths])
    found = []
    for length in np.unique(lengths[fine]).tolist():
        if dim in (None, length):
            rows = np.flatnonzero(fine & (lengths == length))
            places = (ends[rows] - length)[:, None] + np.arange(length)
            found.append((rows, scaled[places].astype(np.int64)))
    return fine, found


def pack_rows(grid: np.ndarray) -> list[bytes]:
    """Each row of whole numbers as its least width in bytes and the numbers; equal rows give equal bytes."""
    low, high = grid.min(1), grid.max(1)
    packed: list[bytes] = [b""] * len(grid)
    left = np.ones(len(grid), bool)
    for width in _WIDTHS:
        kind = np.iinfo(width)
        here = np.flatnonzero(left & (low >= kind.min) & (high <= kind.max))
        left[here] = False
        head = bytes([kind.bits // 8])
        size = grid.shape[1] * kind.bits // 8
        data = grid[here].astype(width).tobytes()
        for k, row in enumerate(here.tolist()):
            packed[row] = head + data[k * size : (k + 1) * size]
    return packed


def unpack_rows(packed: list[bytes], dim: int) -> np.ndarray:
    """Whole numbers of packed rows that all have ``dim`` entries."""
    grid = np.empty((len(packed), dim), np.int64)
    heads = np.fromiter((row[0] for row in packed), np.int64, len(packed))
    for width in _WIDTHS:
        here = np.flatnonzero(heads == np.iinfo(width).bits // 8)
        if len(here):
            data = b"".join(packed[row][1:] for row in here.tolist())
            grid[here] = np.frombuffer(data, width).reshape(len(here), dim)
    return grid


def on_grid(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` whose vector is whole and finite, with its packed grid numbers instead of it, and their count."""
    kept = [name for name in rows.columns if name != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _offsets(batch.column(batch.schema.get_field_index(vector)), None)
            for places, grid in found:
                part = batch.select(kept).take(pa.array(places))
                columns = [pa.array(pack_rows(grid), pa.binary()), pa.array(np.full(len(places), grid.shape[1]), pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*kept, _GRID, "__dim"])

    schema = T.StructType(
        [*(field for field in rows.schema.fields if field.name != vector),
         T.StructField(_GRID, T.BinaryType()), T.StructField("__dim", T.IntegerType())]
    )
    return rows.mapInArrow(run, schema)


@dataclass
class Whitening:
    """What the fit list gives: size, sums of the grid numbers less SHIFT, and components by falling eigenvalue."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float
    passes: int

    def centred(self, grid: np.ndarray) -> np.ndarray:
        return centred(grid, self.n, self.sums)

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def deviations(self, grid: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 for each row, exact; null beyond a long."""
        largest = float(np.abs(grid).max(initial=0)) * self.n + max(map(abs, self.sums))
        if largest**2 * self.dim < 2.0**62:
            apart = self.n * grid - np.array(self.sums, np.int64)
            return (apart * apart).sum(1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums)) for row in grid.tolist()]
        return [value if value < 1 << 63 else None for value in exact]


def centred(grid: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean: the whole part is taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (grid - whole).astype(np.float64) - rest


class Products:
    """Products of the fit list's covariance with a few vectors, one pass over its blocks each."""

    def __init__(self, fit: DataFrame, dim: int, n: int, sums: list[int]):
        self.fit, self.dim, self.n, self.sums, self.passes = fit, dim, n, sums, 0
        self.many = fit.rdd.getNumPartitions() > FAN

    def _sum(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of what ``part`` gives for one, added up in a tree."""
        dim, n, sums = self.dim, self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                rows = batch.column(0).to_pylist()
                for first in range(0, len(rows), 4096):
                    total += part(centred(unpack_rows(rows[first : first + 4096], dim), n, sums))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["partial"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(data) for data in table["partial"].to_pylist())
            return pa.table({"partial": pa.array([total.tobytes()], pa.binary())})

        partial = self.fit.select(_GRID).mapInArrow(run, "partial binary")
        if self.many:
            groups = partial.groupBy((F.spark_partition_id() % FAN).alias("branch"))
            partial = groups.applyInArrow(add, "partial binary")
        self.passes += 1
        parts = [np.frombuffer(row[0]).reshape(shape) for row in partial.collect()]
        return np.sum(np.stack(parts), axis=0) if parts else np.zeros(shape)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        found = self._sum(lambda rows: rows.T @ (rows @ vectors), vectors.shape)
        return found / self.n

    def trace(self) -> float:
        return float(self._sum(lambda rows: np.array([(rows * rows).sum()]), (1,))[0]) / self.n

    def identity_error(self, projection: np.ndarray) -> float:
        """Largest entry of the whitened fit list's covariance less the identity."""
        k = projection.shape[1]

        def moments(rows: np.ndarray) -> np.ndarray:
            white = rows @ projection
            return np.vstack([white.T @ white, white.sum(0)])

        found = self._sum(moments, (k + 1, k)) / self.n
        return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max(initial=0.0))


def _against(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``vectors`` without their part in ``basis``, taken off twice."""
    for _ in range(2):
        vectors = vectors - basis @ (basis.T @ vectors)
    return vectors


def _widened(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Orthonormal columns that ``new`` adds to ``basis``; those it adds nothing with are left out."""
    found = basis[:, :0]
    for column in new.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        rest = _against((column / size)[:, None], np.hstack([basis, found]))
        left = np.linalg.norm(rest)
        if left > 1e-8 and basis.shape[1] + found.shape[1] < len(basis):
            found = np.hstack([found, _against(rest / left, np.hstack([basis, found]))])
            found[:, -1] /= np.linalg.norm(found[:, -1])
    return found


def corrections(
    product: Callable[[np.ndarray], np.ndarray], ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int
) -> np.ndarray:
    """MINRES on (I - QQ')(V - theta I)(I - QQ') t = -r for each residual r with its theta, side by side.

    Q are all Ritz vectors wanted.  Each step multiplies all columns in one pass.
    """

    def operator(columns: np.ndarray) -> np.ndarray:
        columns = _against(columns, ritz)
        return _against(product(columns) - columns * values, ritz)

    right = _against(-residuals, ritz)
    beta = np.linalg.norm(right, axis=0)
    alive = beta > 0
    safe = np.where(alive, beta, 1.0)
    shape = right.shape
    v_old, v = np.zeros(shape), right / safe
    w_old, w = np.zeros(shape), np.zeros(shape)
    found, eta = np.zeros(shape), beta.copy()
    c_old = c = np.ones(shape[1])
    s_old = s = np.zeros(shape[1])
    beta_here = np.zeros(shape[1])
    for _ in range(steps):
        if not alive.any():
            break
        image = operator(v)
        alpha = (v * image).sum(0)
        rest = image - alpha * v - beta_here * v_old
        beta_next = np.linalg.norm(rest, axis=0)
        delta = c * alpha - c_old * s * beta_here
        rho1 = np.hypot(delta, beta_next)
        rho2 = s * alpha + c_old * c * beta_here
        rho3 = s_old * beta_here
        alive &= rho1 > 1e-300
        rho = np.where(alive, rho1, 1.0)
        c_old, s_old = c, s
        c, s = delta / rho, beta_next / rho
        w_new = (v - rho3 * w_old - rho2 * w) / rho
        found = found + np.where(alive, c * eta, 0.0) * w_new
        eta = -s * eta
        w_old, w = w, w_new
        alive &= (beta_next > 1e-14 * np.abs(values).max()) & (np.abs(eta) > 1e-15 * beta)
        v_old, v = v, np.where(alive, rest / np.where(beta_next > 0, beta_next, 1.0), 0.0)
        beta_here = np.where(alive, beta_next, 0.0)
    return _against(found, ritz)


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, rounds: int = 200
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their unit vectors, to double precision.

    Fewer if the matrix has a smaller rank: eigenvalues that rounding alone could make are left out.
    """
    wanted = min(wanted, dim)
    start = np.random.default_rng(20240607).standard_normal((dim, min(dim, wanted + 4)))
    basis = _widened(np.zeros((dim, 0)), start)
    images = product(basis)
    limit = min(dim, max(SPACE * wanted, wanted + 8))
    for _ in range(rounds):
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        top = values[0]
        if not top > 0:
            return values[:0], basis[:, :0]
        ritz = basis @ inner[:, :wanted]
        residuals = images @ inner[:, :wanted] - ritz * values[:wanted]
        sizes = np.linalg.norm(residuals, axis=0)
        locked = sizes <= ULPS * np.finfo(float).eps * top
        whole = basis.shape[1] == dim
        if locked.all() or whole:
            # Images carried along have rounding of their own; the final ones are made anew.
            ritz = np.linalg.qr(ritz)[0]
            images_anew = product(ritz)
            final, turn = np.linalg.eigh(ritz.T @ images_anew)
            final, turn = final[::-1], turn[:, ::-1]
            sizes = np.linalg.norm(images_anew @ turn - (ritz @ turn) * final, axis=0)
            if (sizes <= (1e-12 if whole else ULPS * np.finfo(float).eps) * top).all():
                keep = final > dim * np.finfo(float).eps * top
                return final[keep], (ritz @ turn)[:, keep]
            if whole:
                raise ArithmeticError(f"residuals of {sizes.max() / top:.1e} of the largest eigenvalue are left")
            rest = _against(basis @ inner[:, wanted:], ritz)
            basis, images = np.hstack([ritz, np.linalg.qr(rest)[0]]), np.hstack([images_anew, product(np.linalg.qr(rest)[0])])
            continue
        active = np.flatnonzero(~locked)
        if basis.shape[1] + len(active) > limit and limit < dim:
            basis, images = basis @ inner[:, : wanted + 4], images @ inner[:, : wanted + 4]
        new = _widened(basis, corrections(product, ritz, values[active], residuals[:, active], INNER))
        if not new.shape[1]:
            new = _widened(basis, np.random.default_rng(basis.shape[1]).standard_normal((dim, len(active))))
        basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
    raise ArithmeticError(f"{int((~locked).sum())} of {wanted} eigenvectors not exact after {rounds} rounds")


def fit(grid: DataFrame, components: int) -> Whitening | None:
    """The whitening of the distinct vectors of ``grid``, a stored table made by ``on_grid``; none without vectors.

    Vectors whose length is not the commonest one (of equally common ones the larger) take no part.
    """
    common = grid.groupBy("__dim").count().orderBy(F.desc("count"), F.desc("__dim")).first()
    if common is None:
        return None
    dim = common[0]
    scratch = Scratch()
    distinct = scratch.table(grid.where(F.col("__dim") == dim).select(_GRID).distinct(), "fit-list")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = [0] * dim, 0
        for batch in batches:
            whole = unpack_rows(batch.column(0).to_pylist(), dim)
            rows += len(whole)
            if len(whole) and float(np.abs(whole).max()) * len(whole) < 2.0**62:
                found = whole.sum(0).tolist()
            else:
                found = [sum(column) for column in zip(*whole.tolist())] or [0] * dim
            total = [a + b for a, b in zip(total, found)]
        texts = pa.array([str(value) for value in total], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), texts, pa.array([rows] * dim)], ["i", "s", "n"])

    parts = distinct.mapInArrow(sums, "i int, s string, n long")
    added = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")), F.sum("n")).orderBy("i").collect()
    total, n = [int(row[1]) for row in added], added[0][2]
    product = Products(distinct, dim, n, total)
    trace = product.trace()
    values, vectors = np.empty(0), np.empty((dim, 0))
    if trace > 0:
        values, vectors = leading_pairs(product, dim, components)
        # Either sign is right; the largest entry is made positive.
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    model = Whitening(dim, n, total, trace, values, vectors, 0.0, 0)
    if len(values):
        model.identity_error = product.identity_error(model.projection())
    model.passes = product.passes
    scratch.drop(distinct)
    return model


def whiten(grid: DataFrame, model: Whitening) -> DataFrame:
    """``grid``'s rows of the model's length with ``deviation`` and ``whitened``, an array by component."""
    rows = grid.where(F.col("__dim") == model.dim).drop("__dim")
    kept = [name for name in rows.columns if name != _GRID]
    width = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(_GRID)).to_pylist()
            for first in range(0, len(packed), 4096):
                whole = unpack_rows(packed[first : first + 4096], model.dim)
                white = model.centred(whole) @ model.projection()
                ends = pa.array(np.arange(len(whole) + 1) * width, pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1)))
                part = batch.select(kept).slice(first, 4096)
                columns = [pa.array(model.deviations(whole), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*kept, "deviation", "whitened"])

    fields = [field for field in rows.schema.fields if field.name != _GRID]
    added = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType([*fields, *added]))


def op12(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """A row for each usable vector and component.

    Left out: null and empty vectors, those with null or non-finite entries or entries beyond
    2**55 (no safe long), and those whose length is not the commonest.  Ids may be null or
    repeated.  Vectors without any spread give no components, so no rows; fewer dimensions
    than 16, or a smaller rank, give fewer components.  A deviation beyond a long is null.
    """
    grid = Scratch().table(on_grid(embeddings.select("vec_id", "embedding"), "embedding"), "grid")
    model = fit(grid, components)
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(value / model.trace)) for value in model.values])
    return whiten(grid, model).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("__at", "whitened")
    ).select(
        "vec_id",
        (F.col("__at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("__at")].alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
