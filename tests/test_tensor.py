import numpy as np
import pytest
from pyspark.errors import PySparkException

from cootide.core import SparseTensor, TensorError, density, index_column, rebase
from cootide.functions import radix, ranking
from cootide.operators import structure
from tests.tensors import SMALL, SMALL4, rows, tensor


def test_small_values(spark):
    x = tensor(spark, SMALL)
    assert x.dims == [2, 3, 2] and x.nnz() == 6 and x.normsq() == 91
    assert x.density() == pytest.approx(0.5)
    assert [[n for _, n in rows(x.histogram(m))] for m in range(3)] == [[3, 3], [2, 2, 2], [4, 2]]
    assert rows(x.unfold(0)) == [(0, 1, 3), (0, 2, 1), (0, 4, 2), (1, 0, 4), (1, 3, 6), (1, 4, 5)]
    assert rows(x.unfold(1)) == [(0, 1, 3), (0, 2, 4), (1, 0, 1), (1, 3, 6), (2, 0, 2), (2, 2, 5)]
    assert rows(x.unfold(2)) == [(0, 1, 1), (0, 2, 2), (0, 3, 4), (0, 5, 5), (1, 0, 3), (1, 4, 6)]
    assert rows(x.row_pointers(0)) == [(0, 3, 0), (1, 3, 3)]


def test_small_structure(spark):
    x = tensor(spark, SMALL)
    order = structure.mode_order(x.dims)
    assert order == [0, 2, 1]
    assert [n for _, n in rows(structure.level_counts(x, order))] == [2, 4, 6]
    assert structure.tree_storage(x, order) == 392
    tiles = {t: n for t, n, _ in rows(structure.tile_pointers(x, [2, 2, 2])) if n}
    assert tiles == {1: 1, 2: 2, 4: 1, 6: 1, 7: 1}


def test_small4(spark):
    x = tensor(spark, SMALL4)
    assert x.dims == [2, 2, 3, 3] and x.normsq() == 97
    assert [[n for _, n in rows(x.histogram(m))] for m in range(4)] == [[4, 4], [6, 2], [3, 3, 2], [4, 3, 1]]
    order = structure.mode_order(x.dims)
    assert order == [0, 1, 2, 3] and structure.tree_storage(x, order) == 528
    assert [n for _, n in rows(structure.level_counts(x, order))] == [2, 4, 6, 8]
    tiles = {t: n for t, n, _ in rows(structure.tile_pointers(x, [2, 2, 2, 2])) if n}
    assert tiles == {2: 2, 3: 1, 5: 1, 8: 1, 9: 1, 10: 1, 15: 1}


def test_duplicates_gaps_and_maps(spark):
    subs = [*SMALL, *list(SMALL)[:2]]
    x = SparseTensor.from_arrays(spark, [(a, 3 * b, c + 4) for a, b, c in subs], [*SMALL.values(), 3, 1])
    dups, empty, fixed = x.check()
    assert (dups, empty) == (2, (7 - 3) + (6 - 2))
    assert rows(fixed.df) == sorted((*k, float(2 * v if k in subs[:2] else v)) for k, v in SMALL.items())
    assert rows(fixed.maps[1]) == [(0, 0), (1, 3), (2, 6)] and rows(fixed.maps[2]) == [(0, 4), (1, 5)] and 0 not in fixed.maps


def test_ingest(spark):
    df = spark.createDataFrame([(1, 5, "x", 2.0), (2, 7, "y", 1.0)], "a int, b bigint, other string, v double")
    x = SparseTensor.from_dataframe(df, ["a", "b"], "v")
    assert x.dims == [3, 8]
    assert rows(rebase(df, ["a", "b"]), "a", "b") == [(0, 0), (1, 2)]
    assert rows(index_column(df, "other", "k"), "k") == [(0,), (1,)]
    bad = spark.createDataFrame([(1, None, 1.0)], "a int, b int, v double")
    with pytest.raises(PySparkException, match="null or negative"):
        SparseTensor.from_dataframe(bad, ["a", "b"], "v", [2, 2]).df.collect()
    with pytest.raises(TensorError):
        SparseTensor.from_dataframe(df.limit(0), ["a", "b"], "v")
    empty = SparseTensor.from_dataframe(df.limit(0), ["a", "b"], "v", [2, 2])
    assert empty.nnz() == 0 and empty.normsq() == 0 and empty.density() == 0 and empty.count_duplicates() == 0
    assert rows(empty.histogram(0)) == [(0, 0), (1, 0)]


def test_density_of_huge_dims():
    assert density(8, [1 << 62] * 3) == pytest.approx(8 / 2.0**186)


def test_radix():
    sizes = [3, 5, 7]
    for code in range(105):
        assert radix.encode_value(radix.decode_value(code, sizes), sizes) == code
    assert radix.encode_value([3, 0, 0], sizes) is None and radix.decode_value(105, sizes) is None
    assert radix.codes_with(1, 2, sizes) == [c for c in range(105) if radix.decode_value(c, sizes)[1] == 2]
    with pytest.raises(OverflowError):
        radix.checked_product([1 << 40, 1 << 40])


def test_ranks(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id AS v")
    assert all(k == r for k, r in rows(ranking.global_rank(df, ["k"]), "k", "rank"))
    got = rows(ranking.running_sum(df, ["k"], "v", "before"), "k", "v", "before")
    sums = np.concatenate([[0], np.cumsum([v for _, v, _ in got])])
    assert [b for *_, b in got] == sums[:-1].tolist()
    assert rows(ranking.global_rank(df.limit(0), ["k"])) == []


def test_orders():
    assert structure.mode_order([4, 2, 4]) == [1, 0, 2]
    assert structure.mode_order([4, 2, 4], "big_first") == [0, 2, 1]
    assert structure.mode_order([4, 2, 3], "in_order_minus_one", 2) == [2, 0, 1]
    assert structure.mode_order([4, 2, 3], "sorted_minus_one", 0) == [0, 1, 2]
    assert structure.inverse_order([2, 0, 1]) == [1, 2, 0]
    assert structure.fiber_order([5, 9, 3], 0) == [0, 2, 1]
    assert structure.tree_orders([3, 1, 2], "two") == [[1, 2, 0], [0, 1, 2]] and len(structure.tree_orders([3, 1, 2], "all")) == 3
    with pytest.raises(TensorError):
        structure.mode_order([1, 2], "odd")
