"""Frequent items, reservoir sample, nearest vectors and clusters."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from cootide import session
from cootide.llm import clusters, frequent, neighbours, reservoir, vptree


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# -- frequent items ----------------------------------------------------------------------------------------------------


def _skewed(spark, n=20_000, seed=3):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.4, 7, np.where(rng.random(n) < 0.1, -3, rng.integers(0, 1 << 40, n)))
    b = rng.zipf(1.5, n) % (1 << 40)
    data = [(int(x) if x % 11 else None, int(y), "c") for x, y in zip(a, b)]
    return spark.createDataFrame(data, "a bigint, b bigint, mode_no string").repartition(5), data


def test_bounds_hold_and_exact_items_are_found(spark):
    df, data = _skewed(spark)
    counts = [Counter(r[c] for r in data if r[c] is not None) for c in (0, 1)]
    width = 256
    cells = frequent.sketch(df, ["a", "b"], depth=3, width=width)
    assert cells.count() <= 2 * 3 * width
    for c, item, lower, upper, total in frequent.candidates(cells, 2, depth=3, width=width):
        assert total == sum(counts[c].values()) and lower <= counts[c][item] <= upper
    assert rows(frequent.frequent_exact(df, ["a", "b"], 1, 100)) == sorted((c, i, n) for c in (0, 1) for i, n in counts[c].items() if n * 100 >= sum(counts[c].values()))
    approx = {(r["mode_no"], r["idx"]) for r in frequent.frequent_items(df, ["a", "b"], 0.01).collect()}
    assert {(c, i) for c in (0, 1) for i, n in counts[c].items() if n * 100 >= sum(counts[c].values())} <= approx


def test_sketches_merge_in_any_order():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 5000) ** 2
    cells = frequent.Cells(2, 16)
    for part in np.array_split(values, 7):
        cells.add(np.ascontiguousarray(part))
    counts = Counter(values.tolist())
    for row in range(2):
        for item, n in counts.items():
            cell = int(frequent.cell_of(np.array([item]), row, 16)[0])
            t, s, k = cells.total[row, cell], cells.surplus[row, cell], cells.candidate[row, cell]
            assert (s <= n <= (t + s) / 2) if k == item else n <= (t - s) / 2


def test_what_a_narrow_sketch_misses_is_counted(spark):
    # Ten equal items in one cell per row: votes cancel, so no candidate tells of the others.
    values = [i * i for i in range(10)] * 300 + [i * i for i in range(10)][::-1] * 300
    df = spark.createDataFrame([(v, None) for v in values], "a bigint, b bigint").repartition(4)
    merged = frequent.Sketch.of(frequent.sketch(df, ["a", "b"], depth=2, width=1), 2, 2, 1)
    assert merged.open_cells(0.1)[0] is not None and merged.open_cells(0.1)[1] is None
    found = frequent.frequent_bounds(df, ["a", "b"], 0.1, depth=2, width=1)
    assert {x[1] for x in found} == {i * i for i in range(10)} and all(lo <= 600 <= up for _, _, lo, up, _ in found)
    assert frequent.width_for(1e-9) == frequent.MOST_WIDTH


def test_frequent_items_of_nothing(spark):
    df, _ = _skewed(spark, 10)
    assert frequent.frequent_items(df.limit(0), ["a"], 0.01).count() == 0
    assert frequent.frequent_exact(df.selectExpr("cast(null AS bigint) AS a"), ["a"], 1, 100).count() == 0
    with pytest.raises(ValueError):
        frequent.sketch(df, ["a"], width=100)


# -- reservoir ---------------------------------------------------------------------------------------------------------


def test_hypergeometric_matches_numpy():
    rng = np.random.default_rng(0)
    for good, bad, draws in ((5, 7, 6), (300, 20, 100), (1, 1000, 1000), (10, 0, 4), (0, 5, 2), (2_000, 3_000, 2_500)):
        mine = np.array([reservoir.hypergeometric(rng, good, bad, draws) for _ in range(3000)])
        n = good + bad
        assert abs(mine.mean() - draws * good / n) < 5 * max(mine.std(), 0.02) / np.sqrt(3000) + 1e-9
        assert mine.min() >= max(0, draws - bad) and mine.max() <= min(good, draws)
    assert 0 <= reservoir.hypergeometric(rng, 10**15, 10**16, 10**9) <= 10**9


def test_draws_keep_the_sample_full():
    counts = np.array([[3, 0, 1], [0, 0, 0], [50, 20, 30], [5, 5, 500]])
    seen = 0
    r = reservoir.draw_replacements(counts, 20, 1)
    occupancy = np.zeros(3, int)
    for p in range(4):
        seen += counts[p].sum()
        assert (r.insert[p] <= counts[p]).all() and (r.evict[p] <= occupancy).all()
        occupancy += r.insert[p] - r.evict[p]
        assert occupancy.sum() == min(20, seen)


def test_every_record_is_equally_likely(spark):
    data = [(i, i % 4, i * 2, None if i % 7 == 0 else 0.5) for i in range(300)] + [(i, 5, i * 2, None if i % 7 == 0 else 0.5) for i in range(0, 300, 3)] + [(900, None, 1, 1.0), (None, 1, 1, 1.0)]
    df = spark.createDataFrame(data, "k bigint, piece int, i0 bigint, val double").repartition(3).cache()
    hits, runs, k = Counter(), 10, 100
    for seed in range(runs):
        got = reservoir.sample_records(df, "k", "piece", k, columns=["i0", "val"], seed=seed, slots=3).collect()
        assert len(got) == len({r["k"] for r in got}) == k
        assert all(r["i0"] == (r["k"] * 2 if r["k"] != 900 else 1) for r in got)
        assert all(r["first_piece"] == (r["k"] % 4 if r["k"] != 900 else None) for r in got)
        hits.update(r["k"] for r in got)
    p = k / 301
    for part in (range(0, 300, 3), range(1, 300, 3), range(0, 300, 4), range(3, 300, 4)):  # delivered twice, once, early, late
        mean = np.mean([hits[i] for i in part]) / runs
        assert abs(mean - p) < 5 * np.sqrt(p * (1 - p) / runs / len(part))


def test_sample_edges(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, None), (2, 2, None)], "k bigint, piece int, v bigint")
    assert rows(reservoir.sample_records(df, "k", "piece", 10, columns=["v"]), "k", "first_piece") == [(1, 1), (2, 1)]
    assert reservoir.sample_records(df, "k", "piece", 0, columns=["v"]).count() == 0
    assert reservoir.sample_records(df.limit(0), "k", "piece", 5, columns=["v"]).count() == 0
    same = [rows(reservoir.sample_records(df.repartition(n), "k", "piece", 1, columns=["v"], seed=9), "k") for n in (1, 3)]
    assert same[0] == same[1] and len(same[0]) == 1


def test_a_small_late_piece_lets_no_more_rows_through(spark):
    # 10 pieces of 20,000 records, then one of 500.
    n, k = 200_000, 2_000
    df = spark.range(n + 500).select(neighbours.F.col("id").alias("k"), neighbours.F.floor(neighbours.F.col("id") / 20_000).alias("piece"), (neighbours.F.col("id") * 3).alias("v"))
    stats = {}
    got = reservoir.sample_records(df, "k", "piece", k, columns=["v"], stats=stats).collect()
    assert len(got) == len({r["k"] for r in got}) == k and all(r["v"] == 3 * r["k"] and r["first_piece"] == r["k"] // 20_000 for r in got)
    assert stats["passed"] <= 2 * k * (1 + np.log(n / k))


def test_a_missed_margin_takes_the_whole_cell(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id AS k", "id % 5 AS piece", "id AS v").cache()
    want = rows(reservoir.sample_records(df, "k", "piece", 300, columns=["v"], slots=2))
    unit = reservoir._unit
    # Hashes that crowd at one half defeat any margin.
    monkeypatch.setattr(reservoir, "_unit", lambda key, seed: unit(key, seed) * 1e-9 + 0.5)
    got = rows(reservoir.sample_records(df, "k", "piece", 300, columns=["v"], slots=2))
    assert got == want


def test_many_pieces_arrive_in_batches(spark, monkeypatch):
    assert reservoir.batched({5: 10, 1: 10, 9: 10}, 3) == ([1, 5, 9], [0, 1, 2])
    order, batch = reservoir.batched({p: 1 + p % 3 for p in range(100)}, 7)
    assert order == sorted(order) and batch == sorted(batch) and set(batch) == set(range(7))
    monkeypatch.setattr(reservoir, "MOST_BATCHES", 4)
    df = spark.range(3000).selectExpr("id AS k", "id % 50 AS piece", "id AS v")
    got = reservoir.sample_records(df, "k", "piece", 500, columns=["v"]).collect()
    assert len({r["k"] for r in got}) == 500 and all(r["first_piece"] == r["k"] % 50 for r in got)


# -- nearest vectors and clusters ----------------------------------------------------------------------------------------


def _vectors(n=400, d=8, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    x = np.where(rng.random((n, 1)) < 0.7, centers[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, d)), rng.normal(size=(n, d)))
    x[::17] = x[3]  # copies
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("k", [1, 4])
def test_tree_search_is_exact_at_factor_one(k):
    x = _vectors(2500)
    ids = np.random.default_rng(1).permutation(2500)
    for low in (-1.0, 0.8):
        cos, at = vptree.nearest(x[:300], x, ids, k, min_cos=low)
        full = np.round(x[:300] @ x.T, 9)
        order = np.lexsort((np.broadcast_to(ids, full.shape), -full), axis=1)[:, :k]
        want = np.take_along_axis(full, order, 1)
        assert np.array_equal(cos, np.where(want >= low, want, -np.inf)) and np.array_equal(at, np.where(want >= low, order, -1))
    floor = np.full(300, 0.5)
    cos, at = vptree.nearest(x[:300], x, ids, k, floor=floor)
    assert np.array_equal(cos, np.where(np.where(full[np.arange(300)[:, None], order] >= 0.5, want, -np.inf) >= 0.5, want, -np.inf))
    cos, at = vptree.nearest(x[:300], x, ids, k, factor=1.5)
    exact = vptree.nearest(x[:300], x, ids, k)[1]
    assert np.mean([len(set(a) & set(b)) / k for a, b in zip(at, exact)]) >= 0.9


def _frame(spark, x, extra=()):
    data = [(i, i % 2, [float(v) * (1 + i % 5) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "row_id bigint, mode_no int, vals array<double>").selectExpr("*", "1 AS grp", "'u' AS unit").repartition(3)


BAD = [(9001, 0, None), (9002, 0, [1.0] * 7), (9003, 0, [0.0] * 8), (9004, 0, [float("nan")] + [1.0] * 7), (9005, 0, [None] + [1.0] * 7), (9006, None, [1.0] * 8), (None, 0, [1.0] * 8), (9007, 0, [float("inf")] + [1.0] * 7), (9008, 0, [])]


def _brute(x, k, low):
    pairs, near = defaultdict(set), {}
    for m in (0, 1):
        ids = np.arange(m, len(x), 2)
        c = np.round(x[ids] @ x[ids].T, 9)
        np.fill_diagonal(c, -9)
        for a, row in enumerate(c):
            order = np.lexsort((ids, -row))[:k]
            near[int(ids[a])] = [int(ids[b]) for b in order if row[b] >= low]
        for a, b in zip(*np.where(c >= low)):
            pairs[int(ids[a])].add(int(ids[b]))
    groups, left = {}, set(range(len(x)))
    while left:
        todo, seen = [min(left)], set()
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += pairs[v]
        left -= seen
        groups |= {v: (min(seen), len(seen)) for v in seen}
    return near, groups


def test_rows_and_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 60)  # several blocks
    x = _vectors()
    df = _frame(spark, x, BAD)
    near, groups = _brute(x, 3, 0.85)
    got = defaultdict(list)
    for r in neighbours.nearest_rows(df, "row_id", "mode_no", "vals", 3, dimensions=8, min_cos=0.85).orderBy("row", (-1 * neighbours.F.col("cosine")), "near_row").collect():
        got[r["row"]].append(r["near_row"])
    assert {k: v for k, v in near.items() if v} == dict(got)
    linked = clusters.linked_groups(df, "row_id", "mode_no", "vals", 0.85, dimensions=8)
    assert {r["row"]: (r["first"], r["size"]) for r in linked.collect()} == groups
    found = clusters.average_clusters(df, "row_id", "mode_no", "vals", 0.85, dimensions=8).collect()
    assert sum(r["size"] for r in found) == len(x) and all(1 <= len(r["typical_row_ids"]) <= 3 for r in found)
    assert all(groups[r["first_row_id"]][1] >= r["size"] for r in found)


def test_recall_over_several_shards(spark, monkeypatch):
    # 64 dimensions: tight groups of 20 and a fifth of rows that belong to none.
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(90, 64))
    x = np.concatenate([np.repeat(centers, 20, axis=0) + 0.3 * rng.normal(size=(1800, 64)), rng.normal(size=(450, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "row_id bigint, mode_no int, vals array<double>").repartition(3)
    full = np.round(x @ x.T, 9)
    np.fill_diagonal(full, -9)
    want = [set(np.lexsort((np.arange(len(x)), -r))[:5].tolist()) for r in full]
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        found = defaultdict(set)
        for r in neighbours.nearest_rows(df, "row_id", "mode_no", "vals", 5, factor=factor).collect():
            found[r["row"]].add(r["near_row"])
        assert np.mean([len(want[i] & found[i]) / 5 for i in range(len(x))]) >= least
    ix = neighbours.index(df, "row_id", "mode_no", "vals", 64)
    assert ix.shards > 5
    home = neighbours.at_home(ix, 4, lambda s, g: ([neighbours.pa.array(s.cell)], g.visits(s.unit, s.cell, s.shard, np.full(len(s.row), 0.9), 1.0, False)), "at bigint")
    tours = [len(r["visits"]) for r in home.where("row < 1800").collect()]
    assert np.mean(tours) < 0.5 * (ix.shards - 2)  # what is near the centre of a group need not go everywhere


def test_few_pairs_of_loose_vectors_need_double_precision():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(600, 64)), rng.normal(size=(500, 64))
    y[:200] = x[:200] + rng.uniform(0.5, 0.9, (200, 1)) * y[:200]  # cosines about 0.78
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    cos, every = x @ y.T, np.arange(600)
    for least in (0.78, 0.6):  # by half of the dimensions, and by all of them in single precision
        pairs = vptree.Sieve(x, y).pairs(every, np.arange(500), np.full(600, least))
        assert set(np.flatnonzero(cos.ravel() >= least).tolist()) <= set(pairs.tolist()) and len(pairs) < 0.01 * cos.size
        value, at = vptree.nearest(x, y, np.arange(500), 3, min_cos=least)
        want = np.sort(np.where(np.round(cos, 9) >= least, np.round(cos, 9), -np.inf), axis=1)[:, :-4:-1]
        assert np.array_equal(value, want) and np.array_equal(at >= 0, np.isfinite(want))


def test_hot_classes_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 50)
    monkeypatch.setattr(neighbours, "HOT_SHARE", 3)
    x = np.eye(4)
    data = [(i, 0, x[0].tolist()) for i in range(200)] + [(i, 0, (x[1] + 0.001 * i * x[2]).tolist()) for i in range(200, 210)] + [(3, 0, x[0].tolist())] * 3
    df = spark.createDataFrame(data, "row_id bigint, mode_no int, vals array<double>").repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest_rows(df, "row_id", "mode_no", "vals", 3, dimensions=4, min_cos=0.9).collect():
        got[r["row"]].append(r["near_row"])
    assert sorted(got[0]) == [1, 2, 3] and sorted(got[2]) == [0, 1, 3] and sorted(got[150]) == [0, 1, 2] and len(got) == 210
    groups = {r["row"]: (r["first"], r["size"]) for r in clusters.linked_groups(df, "row_id", "mode_no", "vals", 0.9, dimensions=4).collect()}
    assert groups[199] == (0, 200) and groups[3] == (0, 200) and groups[205] == (200, 10) and len(groups) == 210


def test_encoded_vectors_lose_nothing():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(70, 64))
    x[:10], x[10:20], x[20:30], x[30:40] = np.round(x[:10], 4), np.round(x[10:20] * 20, 4), np.round(x[20:30] * 20), x[30:40].astype(np.float32)
    x[40:44] *= np.array([[1e300], [1e-300], [1e12], [1e6]])
    e = neighbours.encoded(x)
    assert np.array_equal(neighbours.decoded(e), x) and np.array_equal(neighbours.decoded(e.slice(5, 30)), x[5:35])
    assert [len(e[i].as_py()) for i in (0, 10, 20, 30, 50)] == [129, 193, 65, 257, 513]
    assert len(neighbours.encoded(np.zeros((0, 64)))) == 0


def _table_and_disk(spark, folder, monkeypatch):
    """Tight groups and rows of none with numbers of four decimals; its bytes; what the most disk is read from, asked after every table."""
    rng = np.random.default_rng(12)
    x = np.concatenate([np.repeat(rng.normal(size=(300, 64)), 12, axis=0) + 0.3 * rng.normal(size=(3600, 64)), rng.normal(size=(1200, 64))])
    path = f"{folder}/rows.parquet"
    spark.createDataFrame([(i, 0, np.round(r, 4).tolist()) for i, r in enumerate(x)], "row_id bigint, mode_no int, vals array<double>").coalesce(1).write.option("compression", "zstd").parquet(path)
    size = lambda f: sum(p.stat().st_size for p in Path(f).rglob("*") if p.is_file())
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    used = lambda: size(session.shared_folder(spark).removeprefix("file:")) + sum(f.length() for f in spark._jvm.java.util.ArrayList(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())))
    before, most = used(), [0]

    def watched(df, **how):
        out = session.materialize(df, **how)
        most[0] = max(most[0], used() - before)
        return out

    monkeypatch.setattr(neighbours, "SHARD_ROWS", 600)
    for module in (neighbours, clusters):
        monkeypatch.setattr(module, "materialize", watched)
    return spark.read.parquet(path), size(path), lambda: max(most[0], used() - before)


def test_nearest_rows_keep_to_the_disk(spark, tmp_path, monkeypatch):
    df, size, most = _table_and_disk(spark, tmp_path, monkeypatch)
    assert neighbours.nearest_rows(df, "row_id", "mode_no", "vals", 5, min_cos=0.78).count() > 3600 * 4
    assert most() <= 4 * size


def test_groups_and_clusters_keep_to_the_disk(spark, tmp_path, monkeypatch):
    df, size, most = _table_and_disk(spark, tmp_path, monkeypatch)
    assert clusters.linked_groups(df, "row_id", "mode_no", "vals", 0.78, least=3).count() > 3600 * 0.9
    assert most() <= 4 * size
    clusters.average_clusters(df, "row_id", "mode_no", "vals", 0.78).count()
    assert most() - 4 * size <= size  # with what is left of the groups


def test_average_linkage_against_rounds_by_hand(spark):
    edges = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.9), (3, 4, 0.95), (1, 3, 0.7), (4, 5, 0.6), (6, 7, 0.5), (1, 2, 0.95), (8, None, 0.9)], "lo bigint, hi bigint, cosine double")
    # 1-2 and 3-4 merge; their mean link is (0.9 + 0.7) / 2.
    assert rows(clusters.merge_reciprocal(edges, 0.85)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7)]
    assert rows(clusters.merge_reciprocal(edges, 0.8)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 7)]
    assert rows(clusters.merge_reciprocal(edges, 0.6, "single")) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 7)]
    assert clusters.merge_reciprocal(edges.limit(0), 0.8).count() == 0


def test_local_rounds_equal_distributed_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = {(int(min(a, b)), int(max(a, b))): float(c) for a, b, c in zip(rng.integers(0, 60, 250), rng.integers(0, 60, 250), rng.random(250)) if a != b}
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "lo bigint, hi bigint, cosine double")
    whole = dict(rows(clusters.merge_reciprocal(edges, 0.6)))
    local = dict(rows(clusters.merge_average(edges, 0.6)))
    assert {k: v for k, v in whole.items() if k in local} == local and all(whole[k] == k for k in whole.keys() - local.keys())
    monkeypatch.setattr(clusters, "MOST_LOCAL_LINKS", 3)
    assert dict(rows(clusters.merge_average(edges, 0.6))) == local


def _average_by_hand(x, threshold):
    """Average linkage over all pairs, best pair first."""
    groups = [[i] for i in range(len(x))]
    while True:
        w = np.array([[-1.0 if a is b else (x[a] @ x[b].T).mean() for b in groups] for a in groups])
        i, j = sorted(divmod(int(w.argmax()), len(groups))) if len(groups) > 1 else (0, 0)
        if i == j or w[i, j] < threshold:
            return sorted(sorted(g) for g in groups)
        groups[i] += groups.pop(j)


def test_clusters_count_all_pairs_not_the_nearest_ones(spark):
    # Tight families of 8 rows within wider ones: the five nearest of every row are of its own family.
    rng = np.random.default_rng(4)
    centers = np.repeat(rng.normal(size=(6, 8)), 3, axis=0) + 0.35 * rng.normal(size=(18, 8))
    x = np.repeat(centers, 8, axis=0) + 0.02 * rng.normal(size=(144, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = _average_by_hand(x, 0.85)
    assert len(want) < 18
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "row_id bigint, mode_no int, vals array<double>")
    found = clusters.average_clusters(df, "row_id", "mode_no", "vals", 0.85, dimensions=8).collect()
    assert sorted((r["first_row_id"], r["size"]) for r in found) == sorted((g[0], len(g)) for g in want)


def test_a_chain_is_one_group_and_two_clusters(spark):
    turn = np.arccos(0.8) * np.arange(3)
    df = spark.createDataFrame([(i, 0, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turn)], "row_id bigint, mode_no int, vals array<double>")
    assert rows(clusters.linked_groups(df, "row_id", "mode_no", "vals", 0.78, dimensions=2), "row", "first") == [(0, 0), (1, 0), (2, 0)]
    assert sorted(r["size"] for r in clusters.average_clusters(df, "row_id", "mode_no", "vals", 0.78, dimensions=2).collect()) == [1, 2]


@pytest.mark.parametrize("equal", [False, True])
def test_rounds_on_means_within_a_task_and_over_the_cluster(spark, monkeypatch, equal):
    rng = np.random.default_rng(6)
    x = np.eye(40) * 0.5 ** 0.5 + 0.5 * np.ones((40, 40)) / 40 ** 0.5 if equal else _vectors(150)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(1000)[: len(x)]
    threshold = float(np.round(x[0] @ x[1], 9)) - 1e-3 if equal else 0.8
    nodes = spark.createDataFrame([(7, int(i), 1, r.tolist()) for i, r in zip(ids, x)], "part bigint, node bigint, n bigint, total array<double>")
    local = rows(clusters.merge_means(nodes, threshold))
    monkeypatch.setattr(clusters, "MOST_LOCAL_VECTORS", 3)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 60)
    assert rows(clusters.merge_means(nodes, threshold)) == local and len(local) == len(x)
    if not equal:
        found = defaultdict(list)
        place = {int(i): n for n, i in enumerate(ids)}
        for node, cluster in local:
            found[cluster].append(place[node])
        assert all(c == min(int(ids[n]) for n in g) for c, g in found.items())
        kept = list(found.values())
        assert all((x[a] @ x[b].T).mean() < 0.8 for a in kept for b in kept if a is not b)


def test_every_row_of_a_class_counts(spark, monkeypatch):
    # cos(x, y) = 0.95, cos(x, z) = 0.8, cos(y, z) = 0.7: the mean is 0.75 over classes, 0.797 over the 31 rows of x and y.
    gram = np.array([[1, 0.95, 0.8], [0.95, 1, 0.7], [0.8, 0.7, 1]])
    x, y, z = np.linalg.cholesky(gram).tolist()
    data = [(i, 0, x) for i in range(30)] + [(30, 0, y), (31, 0, z)]
    df = spark.createDataFrame(data, "row_id bigint, mode_no int, vals array<double>")
    found = clusters.average_clusters(df, "row_id", "mode_no", "vals", 0.78, dimensions=3).collect()
    assert [(r["first_row_id"], r["size"]) for r in found] == [(0, 32)]
    edges = spark.createDataFrame([(0, 30, 0.95, 30), (0, 31, 0.8, 30), (30, 31, 0.7, 1)], "lo bigint, hi bigint, cosine double, n bigint")
    for most in (100, 1):
        monkeypatch.setattr(clusters, "MOST_LOCAL_LINKS", most)
        assert rows(clusters.merge_average(edges, 0.78)) == [(0, 0), (30, 0), (31, 0)]


def test_equal_cosines_merge_alike_within_a_task_and_over_the_cluster(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (240, 2)) * 3 if a != b}
    edges = spark.createDataFrame([(a, b, [0.8, 0.3, 0.2][(a + b) // 3 % 3]) for a, b in sorted(pairs)], "lo bigint, hi bigint, cosine double")
    local = rows(clusters.merge_average(edges, 0.6))
    assert 3 < len({c for _, c in local}) < len(local)
    monkeypatch.setattr(clusters, "MOST_LOCAL_LINKS", 3)
    assert rows(clusters.merge_average(edges, 0.6)) == local
    assert clusters._pair_hash(3, 60) == clusters.pair_hash(np.array([3]), np.array([60]))[0] == edges.limit(1).select(clusters.F.xxhash64(clusters.F.lit(3).cast("long"), clusters.F.lit(60).cast("long"))).first()[0]


def test_vectors_of_nothing(spark):
    df = _frame(spark, _vectors(4), BAD).where("row_id > 9000")
    assert neighbours.nearest_rows(df, "row_id", "mode_no", "vals", 3, dimensions=8).count() == 0
    assert clusters.linked_groups(df, "row_id", "mode_no", "vals", 0.8, dimensions=8).count() == 0
