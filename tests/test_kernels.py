import numpy as np
import pytest

from cootide.core import TensorError, affine_factor
from cootide.operators import cpd, kernels, linalg, stats
from tests.tensors import SMALL, SMALL4, affine, dense, med, mttkrp, tensor


def product(x, factors, mode, rank, **kw):
    out = np.zeros((x.dims[mode], rank))
    for r in kernels.mttkrp(x, factors, mode, rank, **kw).collect():
        out[r["i"]] = r["row"]
    return out


def frames(spark, dims, rank):
    return [affine_factor(spark, d, m, rank) for m, d in enumerate(dims)]


def test_small_products_and_grams(spark):
    x = tensor(spark, SMALL)
    f = frames(spark, x.dims, 2)
    want = [[[25, 73], [-93, 53]], [[53, 80], [-41, -48], [0, 100]], [[-41, 52], [90, 24]]]
    grams = [[[29, -8], [-8, 16]], [[30, -16], [-16, 35]], [[10, -11], [-11, 29]]]
    for m in range(3):
        assert product(x, f, m, 2).tolist() == want[m]
        assert linalg.gram(f[m], 2).tolist() == grams[m]


@pytest.mark.parametrize(("dims", "rank"), [((11, 5, 7), 3), ((4, 6, 3, 5), 1), ((3, 4, 2, 5, 3), 2)])
def test_plans_agree(spark, dims, rank):
    cells = med(dims, 60)
    x = tensor(spark, cells, list(dims))
    f = frames(spark, dims, rank)
    for mode, plan in enumerate(("wide", "long", "fiber", "unfold", "arrow")):
        for m in {mode % len(dims), len(dims) - 1}:
            assert np.array_equal(product(x, f, m, rank, plan=plan), mttkrp(cells, dims, affine(dims, rank), m)), (plan, m)


def test_dense_result_and_errors(spark):
    x = tensor(spark, {(0, 0, 2): 1}, [3, 1, 4])
    f = frames(spark, x.dims, 2)
    assert kernels.mttkrp(x, f, 0, 2, dense=True).count() == 3
    with pytest.raises(TensorError):
        kernels.mttkrp(x, f, 0, 2, plan="other")
    with pytest.raises(TensorError):
        kernels.mttkrp(x, f, 3, 2)
    with pytest.raises(TensorError):
        stats.bench(x, ["other"])


def test_duplicates_count_twice(spark):
    once, twice = tensor(spark, SMALL), tensor(spark, SMALL)
    twice = twice.with_df(twice.df.unionByName(twice.df))
    f = frames(spark, once.dims, 3)
    for plan in ("wide", "fiber"):
        assert np.array_equal(product(twice, f, 1, 3, plan=plan), 2 * product(once, f, 1, 3))


def test_inner_product_is_the_same_for_every_mode(spark):
    x = tensor(spark, SMALL4)
    f = frames(spark, x.dims, 2)
    got = {kernels.inner_product(x, kernels.mttkrp(x, f, m, 2), f[m], [2.0, -1.0]) for m in range(4)}
    assert len(got) == 1


def test_cpd_trace_of_small(spark):
    x = tensor(spark, SMALL)
    on_frames = cpd.cpd_als(x, 2, cpd.CpdOptions(max_iterations=2, init="affine", driver_bytes=0))
    assert np.allclose(on_frames.fits, [0.578561, 0.661909], atol=1e-6)
    out = cpd.cpd_als(x, 2, cpd.CpdOptions(init="affine"))
    assert np.allclose(out.fits[:3], [0.578561, 0.661909, 0.672035], atol=1e-6)
    assert len(out.fits) == 22 and out.fit == pytest.approx(0.725816, abs=1e-6)
    assert np.allclose(sorted(out.weights), [6.414847, 6.971007], atol=1e-5)
    z = dense(out.factors, out.weights)
    cells = np.zeros(x.dims)
    for at, v in SMALL.items():
        cells[at] = v
    assert 1 - np.linalg.norm(cells - z) / np.linalg.norm(cells) == pytest.approx(out.fit, abs=1e-6)
    assert np.all(np.diff(out.fits) > -1e-9)


def test_cpd_recovers_low_rank_and_ignores_partitions(spark):
    rng = np.random.default_rng(2)
    f = [rng.integers(1, 6, (d, 3)).astype(float) for d in (5, 6, 7)]
    z = dense(f, [1, 1, 1])
    x = tensor(spark, {tuple(map(int, at)): float(z[at]) for at in np.ndindex(*z.shape)})
    fits = []
    for n in (1, 4):
        y = x.with_df(x.df.repartition(n))
        fits.append(cpd.cpd_als(y, 3, cpd.CpdOptions(max_iterations=25, tolerance=1e-7, seed=4)).fit)
    assert min(fits) > 0.9 and fits[0] == pytest.approx(fits[1], abs=1e-6)


def test_decomposition_is_alike_wherever_products_are_added(spark, monkeypatch):
    x = tensor(spark, med((9, 8, 7), 200), [9, 8, 7])
    o = cpd.CpdOptions(max_iterations=3, tolerance=0, seed=2)
    here = cpd.cpd_als(x, 3, o)
    assert len(here.seconds) == 3
    monkeypatch.setattr(kernels, "HELD_NONZEROS", 0)
    in_tasks = cpd.cpd_als(x, 3, o)
    monkeypatch.setattr(kernels, "PACKED_NONZEROS", 30)
    monkeypatch.setattr(kernels, "BROADCAST_BYTES", 600)
    by_exchange = cpd.cpd_als(x, 3, o)
    on_frames = cpd.cpd_als(x, 3, cpd.CpdOptions(max_iterations=3, tolerance=0, seed=2, driver_bytes=0))
    for other in (in_tasks, by_exchange, on_frames):
        assert np.allclose(other.fits, here.fits, atol=1e-9)
    wide = cpd.SparseTensor(x.df, [9, 8, 1 << 33])
    parts = kernels.held(kernels.packed(wide), wide.dims)
    assert sum(len(v) for _, v in parts) == 200 and all(i.dtype == np.int64 for at, _ in parts for i in at)


def test_plan_choice():
    assert kernels.choose_plan([10, 10, 10], 0, 8) == "wide" and kernels.choose_plan([10, 10, 10], 0, 8, 100, 30) == "fiber"
    assert kernels.choose_plan([10, 10, 10], 0, 64) == "arrow" and kernels.choose_plan([10, 1 << 40, 10], 0, 64) == "blocked"
    assert kernels.is_private(10, 10_000, 8) and not kernels.is_private(10_000, 10_000, 8) and not kernels.is_private(1, 100, 1)


def test_cpd_degenerate(spark):
    out = cpd.cpd_als(tensor(spark, {(0, 0, 0): 5}), 2, cpd.CpdOptions(max_iterations=5))
    assert np.isfinite(out.fit) and out.fit > 0.99
    with pytest.raises(TensorError):
        cpd.cpd_als(tensor(spark, {(0, 0, 0): 0}), 1)


def test_linear_algebra(spark):
    a = np.array([[4.0, 1], [1, 3]])
    assert np.allclose(linalg.symmetric_inverse(a) @ a, np.eye(2))
    singular = np.ones((2, 2))
    assert np.allclose(linalg.solve_normals(singular, np.array([[2.0, 2.0]])), [[1, 1]])
    assert np.allclose(np.array([[2.0, 2.0]]) @ linalg.normal_inverse(singular), [[1, 1]])
    m = spark.createDataFrame([(0, [3.0, 0.0]), (1, [4.0, 0.0])], "i bigint, row array<double>")
    scaled, norms = linalg.normalize(m, 2)
    assert norms == [5.0, 0.0] and [r["row"] for r in scaled.orderBy("i").collect()] == [[0.6, 0.0], [0.8, 0.0]]
    assert linalg.column_norms(m.selectExpr("i", "transform(row, x -> -x) AS row"), 2, "max") == [1.0, 1.0]
    assert [r["row"] for r in linalg.to_wide(linalg.to_long(m)).orderBy("i").collect()] == [[3.0, 0.0], [4.0, 0.0]]
