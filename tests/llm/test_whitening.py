import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from paddock.llm import whitening
from paddock.session import store


def vectors_frame(spark, rows, kind="float", extra=False):
    schema = f"vec_id long, embedding array<{kind}>"
    if extra:
        schema += ", label int, n long, component string, whitened string"
        rows = [(*row, 1, 2, "c", "w") for row in rows]
    return spark.createDataFrame(rows, schema)


def usable(rows):
    """Rows kept, with their grid vectors."""
    found = []
    for vec_id, vector in rows:
        if vector and all(v is not None and math.isfinite(v) and abs(64 * v) < 2**61 for v in vector):
            found.append((vec_id, [math.floor(64 * float(v)) + 1_000_000 for v in vector]))
    lengths = Counter(len(x) for _, x in found)
    common = max(lengths, key=lambda length: (lengths[length], length)) if lengths else 0
    return [(i, x) for i, x in found if len(x) == common]


def check(rows, got, components=16):
    kept = usable(rows)
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    apart = np.array([[x - s // n - s % n / n for x, s in zip(row, sums)] for row in fit])
    covariance = apart.T @ apart / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > len(values) * 2.3e-16 * values[0]).sum()))
    assert Counter(r.vec_id for r in got) == Counter({i: c * count for i, c in Counter(i for i, _ in kept).items()})
    by_component = defaultdict(lambda: defaultdict(list))
    for r in got:
        by_component[r.component][r.vec_id].append(r)
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * r.explained
    assert sorted(by_component) == list(range(1, count + 1))
    expected_deviation = defaultdict(list)
    for i, x in kept:
        expected_deviation[i].append(sum((n * v - s) ** 2 for v, s in zip(x, sums)))
    for k in range(1, count + 1):
        gap = min(abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1) if len(values) > 1 else 1
        for i, found in by_component[k].items():
            assert sorted(r.deviation for r in found) == sorted(expected_deviation[i])
        if gap < 1e-6 * values[0]:
            continue  # any basis of the shared space is right
        sign = 0
        for i, x in kept:
            centre = np.array([v - s // n - s % n / n for v, s in zip(x, sums)])
            want = centre @ vectors[:, k - 1] / math.sqrt(values[k - 1])
            mine = min((r.whitened for r in by_component[k][i]), key=lambda w: abs(abs(w) - abs(want)))
            assert abs(abs(mine) - abs(want)) < 1e-9 * max(1, abs(want)) * values[0] / gap
            if abs(want) > 1e-3:
                assert sign in (0, np.sign(mine * want))
                sign = np.sign(mine * want)


def test_all_embeddings(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in frame.collect()], whitening.op12(frame).collect())


def test_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 1 + i % 3, 5).tolist()) for i in range(60)]
    rows += [(3, rows[3][1])] * 40 + [(None, rows[5][1]), (70, rows[3][1])]
    rows += [(80, None), (81, []), (82, [1.0, None, 2.0, 3.0, 4.0]), (83, [float("nan")] * 5), (84, [math.inf] + [0.0] * 4)]
    rows += [(85, [1.0, 2.0]), (86, [1e30] * 5), (87, [-400.5, 3e5, 0.0, -0.0, 1 / 64])]
    got = whitening.op12(vectors_frame(spark, rows, "double", extra=True)).collect()
    assert len({r.component for r in got}) == 5
    check(rows, got)


@pytest.mark.parametrize(
    "rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)]], ids=["none", "null", "one", "equal"]
)
def test_without_spread(spark, rows):
    frame = whitening.op12(vectors_frame(spark, rows))
    assert frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert frame.collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 2.0**40]), (3, [0.0, 0.0])]
    assert {r.deviation for r in whitening.op12(vectors_frame(spark, rows, "double")).collect()} == {None}


def test_packing_is_canonical_and_whole():
    draw = np.random.default_rng(2)
    grid = draw.integers(-200, 200, (300, 7))
    grid[::5] *= 1000
    grid[::7] *= 1 << 40
    packed = whitening.pack_rows(grid)
    assert (whitening.unpack_rows(packed, 7) == grid).all()
    assert whitening.pack_rows(grid[:, ::-1][:, ::-1].copy()) == packed and {row[0] for row in packed} >= {2, 4, 8}


@pytest.mark.parametrize("dim, shape", [(40, "flat"), (120, "flat"), (120, "falling"), (30, "twice"), (8, "flat"), (40, "low rank")])
def test_solver_against_dense(dim, shape):
    draw = np.random.default_rng(dim)
    values = np.linspace(1, 2, dim) if shape == "flat" else 0.8 ** np.arange(dim)
    if shape == "twice":
        values = np.repeat(np.linspace(1, 2, dim // 2), 2)
    if shape == "low rank":
        values = np.r_[np.linspace(1, 2, 5), np.zeros(dim - 5)]
    basis = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    matrix = basis * values @ basis.T
    widths = []

    def product(columns):
        widths.append(columns.shape[1])
        return matrix @ columns

    found, vectors = whitening.leading_pairs(product, dim, 16)
    want = np.sort(values)[::-1][: min(dim, 16)]
    want = want[want > 1e-12]
    assert len(found) == len(want) and np.abs(found - want).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
    assert max(widths) <= 20  # a product is with a few columns, never with the whole basis
    if shape == "falling":
        assert sum(widths) > dim  # solved by corrections


def test_corrections_solve_the_projected_equation():
    draw = np.random.default_rng(4)
    matrix = np.cov(draw.standard_normal((50, 400)))
    values, vectors = np.linalg.eigh(matrix)
    near = np.linalg.qr(vectors[:, -3:] + 1e-3 * draw.standard_normal((50, 3)))[0]
    theta = (near * (matrix @ near)).sum(0)
    residuals = matrix @ near - near * theta
    found = whitening.corrections(lambda x: matrix @ x, near, theta, residuals, 120)
    apart = np.eye(50) - near @ near.T
    for k in range(3):
        left = apart @ (matrix - theta[k] * np.eye(50)) @ apart @ found[:, k] + apart @ residuals[:, k]
        assert np.linalg.norm(left) < 1e-9 * np.linalg.norm(residuals[:, k])


def test_partial_sums_in_a_tree(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(0, 1, 4).tolist()) for i in range(50)]
    monkeypatch.setattr(whitening, "FAN", 2)
    grid = store(whitening.on_grid(vectors_frame(spark, rows, "double").repartition(7), "embedding"), "grid")
    total = [sum(x - 1_000_000 for x in column) for column in zip(*{tuple(x) for _, x in usable(rows)})]
    product = whitening.Products(grid, 4, 50, total)
    assert product.many
    plain = np.cov(np.array([x for _, x in usable(rows)]).T, bias=True)
    assert np.abs(product(np.eye(4)) - plain).max() < 1e-9
