from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cootide.core import TensorError
from cootide.functions import ranking
from cootide.operators import graphs, partition, reorder, structure
from tests.tensors import SMALL, med, rows, tensor


def test_graph_edges_and_lines(spark):
    x = tensor(spark, SMALL)
    at = graphs.offsets(x.dims)
    want = Counter()
    for cell in SMALL:
        for a, b in combinations(range(3), 2):
            want[cell[a] + at[a], cell[b] + at[b]] += 1
    edges = graphs.partite_edges(x)
    assert rows(edges) == sorted([(u, v, w) for (u, v), w in want.items()] + [(v, u, w) for (u, v), w in want.items()])
    words = [w for v, _, w in rows(graphs.graph_words(edges), "v", "at", "word") if v == 0]
    assert "".join(words) == "3 1 4 1 5 1 6 2 7 1 "
    cut = graphs.edge_cut(edges, spark.range(7).selectExpr("id AS v", "id % 2 AS part")).first()[0]
    assert cut == sum(w for (u, v), w in want.items() if u % 2 != v % 2)
    weights = graphs.vertex_weights(x)
    for method in ("hash", "range", "weighted"):
        assert {p for _, p in rows(graphs.partition_vertices(weights, 3, method), "v", "part")} <= {0, 1, 2}


def test_hypergraph(spark):
    x = tensor(spark, {**SMALL, (3, 0, 0): 1})
    pins = graphs.nonzero_pins(x)
    order = {cell: n for n, cell in enumerate(sorted([*SMALL, (3, 0, 0)]))}
    assert rows(pins, "hedge", "vtx") == sorted((c[m] + graphs.offsets(x.dims)[m], n) for c, n in order.items() for m in range(3))
    uncut = {h for (h,) in rows(graphs.uncut_hyperedges(pins, spark.range(7).selectExpr("id AS vtx", "id div 3 AS part"), sum(x.dims)))}
    assert 0 in uncut and 2 in uncut and 3 in uncut and 4 not in uncut  # slice 2 is empty
    f = structure.fibers(x, 1)
    assert sum(n for (n,) in rows(f, "nnz")) == 7
    assert graphs.fiber_pins(x, 1).count() == 2 * f.count() + 7


def test_permutations(spark):
    cells = med((9, 4, 6), 40)
    x = tensor(spark, cells, [9, 4, 6])
    y, perms = reorder.reorder(x, "random", seed=3)
    p = [dict(rows(perms[m], "old", "new")) for m in range(3)]
    assert all(sorted(q) == sorted(q.values()) == list(range(d)) for q, d in zip(p, x.dims))
    assert rows(y.df) == sorted((p[0][a], p[1][b], p[2][c], float(v)) for (a, b, c), v in cells.items())
    back = reorder.apply(y, {m: reorder.inverse(perms[m]) for m in range(3)})
    assert rows(back.df) == rows(x.df)
    for kind in ("graph", "hgraph"):
        with pytest.raises(TensorError):
            reorder.reorder(x, kind)
    with pytest.raises(TensorError):
        reorder.reorder(x, "fib")


def test_partition_tables():
    for (n, p), want in {(4, 4): [0, 1, 2, 3, 4], (5, 4): [0, 1, 2, 3, 5], (8, 4): [0, 2, 4, 6, 8], (7, 3): [0, 2, 4, 7], (2, 3): [0, 1, 2, 2]}.items():
        assert partition.simple_bounds(n, p) == want
    assert partition.primes_of(60) == [2, 2, 3, 5] and partition.primes_of(1) == [] and partition.primes_of(97) == [97]
    assert partition.grid_dims([100, 10, 10], 4) == [4, 1, 1] and partition.grid_dims([5, 5, 5], 1) == [1, 1, 1]


@pytest.mark.parametrize("shape", ["unit", "random", "sorted", "descending", "big_end", "fibonacci", "zeros"])
def test_weighted_partition_is_optimal(shape):
    rng = np.random.default_rng(1)
    fib = [1, 1]
    while len(fib) < 500:
        fib.append((fib[-1] + fib[-2]) % 10_007 + 1)
    r = rng.integers(0, 131, 500)
    w = {"unit": np.ones(500, int), "random": r, "sorted": np.sort(r), "descending": np.sort(r)[::-1], "big_end": np.r_[np.ones(499, int), 9999], "fibonacci": np.array(fib), "zeros": np.zeros(500, int)}[shape]
    bounds, most = partition.weighted_bounds(w, 31)
    assert bounds[0] == 0 and bounds[-1] == 500 and len(bounds) == 32 and all(a <= b for a, b in zip(bounds, bounds[1:]))
    assert max(w[a:b].sum() for a, b in zip(bounds, bounds[1:])) == most
    assert most == 0 or partition.fits(partition.Weights.of(w), 31, most - 1) is None


def test_layers_cover_and_balance(spark):
    w = np.random.default_rng(3).integers(0, 50, 300)
    for layers in (1, 2, 7, 31):
        b = partition.layer_bounds(w, layers)
        assert b[0] == 0 and b[-1] == 300 and len(b) == layers + 1 and all(x <= y for x, y in zip(b, b[1:]))
        assert max(w[x:y].sum() for x, y in zip(b, b[1:])) <= w.sum() / layers + 2 * w.max() + 50
    assert partition.layer_bounds(np.array([5]), 3) == [0, 1, 1, 1]
    x = tensor(spark, med((20, 5, 5), 80), [20, 5, 5])
    parts = partition.grid_parts(x, [3, 2, 1])
    assert sum(n for (n,) in rows(partition.part_stats(parts), "nnz")) == 80
    placed = partition.distribute(parts, 6).selectExpr("part", "spark_partition_id() AS p").distinct().collect()
    assert all(r["part"] == r["p"] for r in placed)
    assert partition.coarse_owners(x, 3).count() >= 80


def test_stored_weights_answer_as_those_in_memory(spark, monkeypatch):
    x = tensor(spark, med((4000, 6, 5), 3000), [4000, 6, 5])
    want = partition.mode_weights(x, 0)
    monkeypatch.setattr(partition, "SMALL_MODE", 10)
    monkeypatch.setattr(partition, "KEPT_BLOCKS", 4)
    monkeypatch.setattr(ranking, "BLOCK_BITS", 8)
    got = partition.mode_weights(x, 0)
    assert isinstance(got, partition.StoredWeights) and len(got.block_ends) > 5 and (got.total, got.most) == (want.total, want.most)
    for v in (-1, 0, 1, 17, 1500, 2999, 3000, 3001):
        assert got.within(v) == want.within(v) and got.reaching(v) == want.reaching(v)
    for n in (0, 1, 77, 3999, 4000):
        assert got.below(n) == want.below(n)
    assert partition.layer_bounds(got, 5) == partition.layer_bounds(want, 5)
    assert partition.weighted_bounds(got, 3) == partition.weighted_bounds(want, 3)


def test_part_of_many_bounds(spark):
    for bounds in ([0, 5, 5, 9, 20], [0, *range(1, 400, 2), 400], [0, 20]):
        got = spark.range(bounds[-1]).select("id", partition.part_of(F.col("id"), bounds).alias("p")).collect()
        assert all(r["p"] == sum(b <= r["id"] for b in bounds[1:-1]) for r in got)


def test_running_sum_over_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BITS", 2)
    df = spark.range(100).selectExpr("id AS k", "id % 7 AS v")
    got = rows(ranking.running_sum(df, ["k"], "v", "s"), "k", "s")
    assert got == [(k, sum(i % 7 for i in range(k))) for k in range(100)]


def test_claimed_rows_lie_with_their_users(spark):
    x = tensor(spark, med((60, 20, 9), 500), [60, 20, 9]).df.withColumn("part", F.pmod(F.xxhash64("i0", "i1"), F.lit(4)))
    own = partition.claim_rows(x, ["i0", "i1", "i2"], 4)
    assert own.count() == sum(x.select(c).distinct().count() for c in ("i0", "i1", "i2"))
    per = partition.owned_rows(own, x, ["i0", "i1", "i2"])
    assert per.agg(F.sum("owned")).first()[0] == own.count()
    loads = {r["part"]: r["owned"] for r in per.where("mode = 0").collect()}
    assert max(loads.values()) <= 2 * 60 / 4


def test_fiber_forms(spark):
    x = tensor(spark, SMALL)
    # Seen from mode 0 the fibers run along mode 1, the longest of the others.
    assert rows(structure.fiber_matrix(x, 0), "row", "col", "val") == [(0, 1, 1.0), (0, 2, 2.0), (1, 0, 3.0), (2, 0, 4.0), (2, 2, 5.0), (3, 1, 6.0)]
    empty = x.with_df(x.df.limit(0))
    assert structure.fiber_matrix(empty, 0).count() == 0 and rows(structure.slice_pointers(empty, 1), "fibers", "start") == [(0, 0)] * 3
    assert rows(structure.level_counts(empty, [0, 1, 2])) == [(0, 0), (1, 0), (2, 0)]
    assert structure.fiber_storage(empty, 0) == 8 + 3 * 8
