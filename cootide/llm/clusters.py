"""Clusters of similar records: reciprocal-nearest-neighbour merging, all mutual pairs at once.

Links of a sparse graph are merged by ``merge_reciprocal`` and ``merge_average``; ``merge_means`` needs no links: the
mean cosine of all pairs between two groups of unit vectors is the product of their mean vectors.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cootide.session import materialize, release

from . import neighbours
from .neighbours import spanning_graph

_EDGE = ["lo", "hi"]
MOST_LOCAL_LINKS = 300_000
MOST_LOCAL_VECTORS = 20_000
MOST_COSINES = 2_000_000  # held at once by a task


def _links(edges: DataFrame) -> DataFrame:
    """lo, hi, cosine, n: each link once, with the number of pairs of records it stands for, 1 if edges has no n."""
    n = F.max("n").cast("long") if "n" in edges.columns else F.lit(1).cast("long")
    return edges.where("lo < hi AND cosine IS NOT NULL").groupBy(*_EDGE).agg(F.max("cosine").alias("cosine"), n.alias("n"))


def _units(cosine: Column) -> Column:
    """Whole units of 1e-9: their sums are exact, so equal means tie whatever the order of additions."""
    return F.rint(cosine * 1e9).cast("decimal(18,0)")


def _mean() -> Column:
    return F.col("total").cast("double") / F.col("n").cast("double")


def _best_links(edges: DataFrame) -> DataFrame:
    """For each node its best link by one order of all links: similarity, then a hash of the pair, then the pair."""
    w = _mean()
    e = edges.withColumn("o", F.struct(w.alias("w"), F.xxhash64("lo", "hi").alias("h"), "lo", "hi"))
    both = e.select(F.explode(F.array("lo", "hi")).alias("node"), "o")
    return both.groupBy("node").agg(F.max("o").alias("o")).select("node", "o.w", "o.lo", "o.hi")


def _mutual(best: DataFrame) -> DataFrame:
    """child -> parent for pairs that are each other's best; every node is in at most one pair."""
    return best.groupBy("lo", "hi").count().where("count = 2").select(F.col("hi").alias("child"), F.col("lo").alias("parent"))


def _trees(best: DataFrame) -> DataFrame:
    """child -> root for whole trees of best links, each of which holds exactly one mutual pair, by pointer jumping."""
    mutual = best.groupBy("lo", "hi").count().where("count = 2").select(F.col("lo").alias("node"), F.lit(True).alias("root"))
    up = F.when(F.col("root"), F.col("node")).when(F.col("node") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    pointers = materialize(best.join(mutual, "node", "left").select("node", up.alias("up")))
    while True:
        far = pointers.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jumped = materialize(pointers.join(far, "up").select("node", F.col("up2").alias("new"), (F.col("up") != F.col("up2")).alias("moved")))
        release(pointers)
        pointers = jumped.select("node", F.col("new").alias("up"))
        pointers._cootide_path = jumped._cootide_path
        if not jumped.where("moved").limit(1).count():
            return pointers.where("node <> up").select(F.col("node").alias("child"), F.col("up").alias("parent"))


def merge_reciprocal(edges: DataFrame, threshold: float, linkage: str = "average") -> DataFrame:
    """node, cluster for every node of the graph; a cluster is named by its smallest node.

    edges: lo, hi, cosine with lo < hi, and n if a link stands for n pairs of records, which count in the averages;
    repeated edges count once, null edges not at all. In each round every cluster
    takes its best link of at least ``threshold`` and the mutually best pairs merge in parallel. With ``average`` the
    similarity of two clusters is the mean over the links between them, cosines being rounded to 9 decimals. With ``single`` it is their best link: then all
    best links of a tree around a mutual pair would be followed in later rounds, so they are followed at once and the
    result is what links of at least ``threshold`` connect. Ties follow one order of all links, so rounds halve even
    a graph of equal similarities. Edges and merges live in tables of the shared folder. An empty graph has no clusters.
    """
    e = _links(edges)
    if linkage == "single":  # ties do not matter to what is connected
        start, least = e.select(*_EDGE, F.col("cosine").alias("total"), F.lit(1).cast("long").alias("n")), threshold - 1e-12
    else:
        n = F.col("n").cast("decimal(38,0)")
        start, least = e.select(*_EDGE, (_units(F.col("cosine")) * F.col("n")).cast("decimal(38,0)").alias("total"), n.alias("n")), threshold * 1e9 - 1e-3
    work = materialize(start)
    labels = materialize(work.select(F.explode(F.array(*_EDGE)).alias("node")).distinct().withColumn("cluster", F.col("node")))
    while True:
        live = work.where(_mean() >= least)
        if linkage == "single":
            best = materialize(_best_links(live))
            merges = materialize(_trees(best) if best.limit(1).count() else _mutual(best))
        else:
            best = None
            candidates = _best_links(work)  # a cluster whose best link is too weak waits
            merges = materialize(_mutual(candidates.where(F.col("w") >= least)))
        if best is not None:
            release(best)
        if not merges.limit(1).count():
            break
        a = merges.select(F.col("child").alias("lo"), F.col("parent").alias("lo2"))
        b = merges.select(F.col("child").alias("hi"), F.col("parent").alias("hi2"))
        moved = work.join(a, "lo", "left").join(b, "hi", "left").select(F.coalesce("lo2", "lo").alias("x"), F.coalesce("hi2", "hi").alias("y"), "total", "n").where("x <> y")
        combine = F.max("total") if linkage == "single" else F.sum("total")
        count = F.max("n") if linkage == "single" else F.sum("n")
        new_work = materialize(moved.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(combine.alias("total"), count.alias("n")))
        m = merges.select(F.col("child").alias("cluster"), F.col("parent").alias("to"))
        new_labels = materialize(labels.join(m, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")))
        for old in (work, labels, merges):
            release(old)
        work, labels = new_work, new_labels
    names = labels.groupBy("cluster").agg(F.min("node").alias("name"))
    return labels.join(names, "cluster").select("node", F.col("name").alias("cluster"))


def merge_locally(lo: list[int], hi: list[int], cosine: list[float], threshold: float, pairs_of: list[int] | None = None) -> dict[int, int]:
    """node -> cluster by the same rounds of mutual best pairs with average linkage, for one part of a graph in memory.

    A cluster keeps its links by their current mean in a heap from which outdated ones are dropped when met, and only
    clusters whose links changed are looked at again. Order of ties and names are those of ``merge_reciprocal``.
    """
    links: dict[int, dict[int, tuple[float, int]]] = {}
    for a, b, c, n in zip(lo, hi, cosine, pairs_of or [1] * len(lo)):
        links.setdefault(a, {})[b] = links.setdefault(b, {})[a] = (round(c * 1e9) * n, n)
    members = {x: [x] for x in links}
    least = threshold * 1e9 - 1e-3

    def entry(a: int, b: int) -> tuple:
        total, n = links[a][b]
        x, y = min(a, b), max(a, b)
        return (-(float(total) / float(n)), -_pair_hash(x, y), -x, -y)

    heaps = {a: [entry(a, b) for b in near] for a, near in links.items()}
    for h in heaps.values():
        heapify(h)

    def best(a: int) -> int | None:
        h = heaps[a]
        while h:
            x, y = -h[0][2], -h[0][3]
            b = y if x == a else x
            if b in links[a] and entry(a, b) == h[0]:
                return b if -h[0][0] >= least else None
            heappop(h)
        return None

    active = set(links)
    while active:
        pairs = set()
        for a in active:
            b = best(a)
            if b is not None and best(b) == a:
                pairs.add((min(a, b), max(a, b)))
        active = set()
        for a, b in sorted(pairs):
            members[a] += members.pop(b)  # the smaller node names the cluster
            del links[a][b], links[b][a]
            for c, (total, n) in links.pop(b).items():
                old = links[c].pop(b)
                t2, n2 = links[a].get(c, (0.0, 0))
                links[a][c] = links[c][a] = (t2 + total, n2 + old[1])
                e = entry(a, c)
                heappush(heaps[a], e), heappush(heaps[c], e)
                active.add(c)
            del heaps[b]
            active.add(a)
        active &= links.keys()
    return {x: min(group) for group in members.values() for x in group}


def merge_average(edges: DataFrame, threshold: float) -> DataFrame:
    """node, cluster by average linkage for every node with a link of at least ``threshold``.

    Two clusters whose links are all below the threshold never merge, so the parts that stronger links connect are
    independent. Parts of at most MOST_LOCAL_LINKS links run their rounds within one task each; larger ones run them
    over the cluster, so none is cut. The result names a cluster by its smallest node.
    """
    e = materialize(_links(edges))
    part = materialize(merge_reciprocal(e.where(F.col("cosine") >= threshold), threshold, "single"))
    a, b = (part.select(F.col("node").alias(c), F.col("cluster").alias(f"part_{c}")) for c in _EDGE)
    inside = materialize(e.join(a, "lo").join(b, "hi").where("part_lo = part_hi").select(F.col("part_lo").alias("part"), "lo", "hi", "cosine", "n"))
    sizes = inside.groupBy("part").count()
    large = materialize(sizes.where(F.col("count") > MOST_LOCAL_LINKS).select("part"))

    def run(t: pa.Table) -> pa.Table:
        found = merge_locally(t["lo"].to_pylist(), t["hi"].to_pylist(), t["cosine"].to_pylist(), threshold, t["n"].to_pylist())
        return pa.table({"node": pa.array(found.keys(), pa.int64()), "cluster": pa.array(found.values(), pa.int64())})

    out = inside.join(large, "part", "left_anti").groupBy("part").applyInArrow(run, "node bigint, cluster bigint")
    if large.limit(1).count():
        out = out.unionByName(merge_reciprocal(inside.join(large, "part").select(*_EDGE, "cosine", "n"), threshold, "average"))
    return out


@lru_cache(maxsize=1 << 20)
def _pair_hash(lo: int, hi: int) -> int:
    h = xxhash.xxh64_intdigest(pack("<q", hi), xxhash.xxh64_intdigest(pack("<q", lo), 42))
    return h - (h >> 63 << 64)


def pair_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two bigint columns."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = np.full(len(lo), 42, np.uint64)
    for column in (lo, hi):
        x = turn(np.asarray(column, np.int64).view(np.uint64) * p2, 31) * p1
        h = turn((h + p5 + np.uint64(8)) ^ x, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _best_columns(w: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(row, column, w, hash) of the best link of at least ``threshold`` of each row that has one, in the order of ``_best_links``."""
    top = w.max(axis=1)
    r, c = np.nonzero((w == top[:, None]) & (top >= threshold - 1e-12)[:, None])
    lo, hi = np.minimum(rows[r], columns[c]), np.maximum(rows[r], columns[c])
    h = pair_hash(lo, hi)
    order = np.lexsort((hi, lo, h, r))
    last = order[np.flatnonzero(np.diff(r[order], append=-1))]
    return r[last], c[last], top[r[last]], h[last]


def _best_means(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, threshold: float):
    """Blocks of (node, other, w, hash): best links of the queries among the points and of the points among the queries."""
    step = max(1, MOST_COSINES // max(1, len(p_ids)))
    for a in range(0, len(q_ids), step):
        mine = q_ids[a : a + step]
        w = np.round(q[a : a + step] @ p.T, 9)
        w[mine[:, None] == p_ids[None, :]] = -np.inf
        for ids, others, x in ((mine, p_ids, w), (p_ids, mine, w.T)):
            r, c, top, h = _best_columns(x, ids, others, threshold)
            yield ids[r], others[c], top, h


def merge_vectors(ids: np.ndarray, n: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster of each id by the rounds of ``merge_means``, in memory; ids ascend.

    Only clusters that merged or whose best merged search anew; the others compare their best with what those find. A
    cluster without a link of ``threshold`` will have none later, as a mean is at most the larger of its two parts.
    """
    n, total = n.astype(float), np.array(total)
    cluster, alive, fresh = np.arange(len(ids)), np.ones(len(ids), bool), np.ones(len(ids), bool)
    best = [(-np.inf, 0, 0, 0)] * len(ids)
    while fresh.any():
        for i in np.flatnonzero(fresh):
            best[i] = (-np.inf, 0, 0, 0)
        at = np.flatnonzero(alive)
        mean = total[at] / n[at, None]
        for node, other, w, h in _best_means(ids[fresh], mean[fresh[at]], ids[at], mean, threshold):
            for i, o in zip(np.searchsorted(ids, node).tolist(), zip(w.tolist(), h.tolist(), np.minimum(node, other).tolist(), np.maximum(node, other).tolist())):
                best[i] = max(best[i], o)
        alive &= np.array([o[0] for o in best]) >= threshold - 1e-12
        at = np.flatnonzero(alive)
        low, high = (np.searchsorted(ids, [best[i][k] for i in at]) for k in (2, 3))
        own = at == low
        first = {(a, b) for a, b in zip(low[own].tolist(), high[own].tolist())}
        mutual = sorted(first.intersection(zip(low[~own].tolist(), high[~own].tolist())))
        fresh = np.zeros(len(ids), bool)
        if not mutual:
            break
        parent, child = np.array(mutual).T
        total[parent] += total[child]
        n[parent] += n[child]
        cluster[child] = parent
        alive[child] = False
        gone = np.zeros(len(ids), bool)
        gone[parent] = gone[child] = True
        fresh[at] = gone[low] | gone[high]
        fresh &= alive
    while (cluster[cluster] != cluster).any():
        cluster = cluster[cluster]
    return ids[cluster]


def _vector_table(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "unit" in t.schema.names:
        n = t.column("n").to_numpy()
        return t.column("node").to_numpy(), n, neighbours.matrix_of(t.column("unit"), t.num_rows) * n[:, None]
    total = t.column("total").combine_chunks() if isinstance(t, pa.Table) else t.column("total")
    return t.column("node").to_numpy(), t.column("n").to_numpy(), pc.list_flatten(total).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _merge_parts(threshold: float):
    """Run every part of sorted batches as soon as it is complete, so that a task holds one part and one batch."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            ids, n, total = _vector_table(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(merge_vectors(ids, n, total, threshold))], ["node", "cluster"])

        for b in batches:
            part = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if held and held[-1].column("part")[0].as_py() != part[start]:
                    yield done()
                    held = []
                held.append(b.slice(start, end - start))
        if held:
            yield done()

    return run


def _found_links(work: DataFrame, threshold: float) -> DataFrame:
    """node, o: best links that involve a fresh cluster, every block of fresh clusters against every shard of its part."""
    sizes = work.groupBy("part").count().select("part", F.ceil(F.col("count") / neighbours.SHARD_ROWS).cast("int").alias("shards"))
    x = work.join(sizes, "part").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    q = x.where("fresh").select("part", "node", "n", "total", F.col("mine").alias("block"), every.alias("shard"), F.lit(True).alias("query"))
    p = x.select("part", "node", "n", "total", every.alias("block"), F.col("mine").alias("shard"), F.lit(False).alias("query"))

    def search(t: pa.Table) -> pa.Table:
        (q_ids, q_n, q), (p_ids, p_n, p) = (_vector_table(t.filter(f)) for f in (t["query"], pc.invert(t["query"]))) if pc.any(t["query"]).as_py() and not pc.all(t["query"]).as_py() else ((np.zeros(0, np.int64), np.ones(0), np.zeros((0, 1))),) * 2
        out = list(_best_means(q_ids, q / q_n[:, None].astype(float), p_ids, p / p_n[:, None].astype(float), threshold)) if len(q_ids) else []
        node, other, w, h = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        return pa.table({"node": node, "w": w, "h": h, "lo": np.minimum(node, other), "hi": np.maximum(node, other)})

    pairs = sizes.agg(F.sum(F.col("shards").cast("long") * F.col("shards"))).first()[0] or 1
    found = q.unionByName(p).repartition(int(min(50_000, 3 * pairs)), "part", "block", "shard").groupBy("part", "block", "shard").applyInArrow(search, "node bigint, w double, h bigint, lo bigint, hi bigint")
    return found.select("node", F.struct("w", "h", "lo", "hi").alias("o"))


def _merge_over_cluster(nodes: DataFrame, threshold: float) -> DataFrame:
    """node, cluster by the rounds of ``merge_vectors`` with clusters, best links and names in tables of the shared folder."""
    work = materialize(nodes.withColumn("fresh", F.lit(True)))
    labels = materialize(nodes.select("node", F.col("node").alias("cluster")))
    old = None
    while True:
        found = _found_links(work, threshold)
        found = found if old is None else found.unionByName(old.select("node", "o"))
        best = materialize(found.groupBy("node").agg(F.max("o").alias("o")).select("node", "o.w", "o.h", "o.lo", "o.hi"))
        merges = materialize(_mutual(best))
        if not merges.limit(1).count():
            return labels
        live = work.join(best.select("node", "lo", "hi"), "node")
        children = merges.join(work.select(F.col("node").alias("child"), F.col("n").alias("n2"), F.col("total").alias("total2")), "child").select(F.col("parent").alias("node"), "n2", "total2")
        ends = merges.select(F.explode(F.array("child", "parent")).alias("end"))
        a, b = (ends.select(F.col("end").alias(c), F.lit(True).alias(f"gone_{c}")) for c in _EDGE)
        x = live.join(merges.select(F.col("child").alias("node")), "node", "left_anti").join(children, "node", "left").join(a, "lo", "left").join(b, "hi", "left")
        total = F.when(F.col("n2").isNull(), F.col("total")).otherwise(F.zip_with("total", "total2", lambda s, t: s + t))
        new_work = materialize(x.select("part", "node", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), total.alias("total"), (F.col("gone_lo").isNotNull() | F.col("gone_hi").isNotNull()).alias("fresh")))
        kept = best.join(new_work.where("NOT fresh").select("node"), "node")
        new_old = materialize(kept.select("node", F.struct("w", "h", "lo", "hi").alias("o")))
        m = merges.select(F.col("child").alias("cluster"), F.col("parent").alias("to"))
        new_labels = materialize(labels.join(m, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")))
        for t in (work, labels, merges, best, *([old] if old is not None else [])):
            release(t)
        work, labels, old = new_work, new_labels, new_old


def merge_means(nodes: DataFrame, threshold: float) -> DataFrame:
    """node, cluster by average linkage over all pairs of vectors of a part; a cluster is named by its smallest node.

    nodes: part, node, n, total with n unit vectors behind a node and their sum as array<double>, or part, node, n, unit with
    the one encoded vector that all n share. The similarity of two
    clusters is the mean cosine of all their pairs, which the product of their means gives exactly, rounded to 9
    decimals. In each round all mutually best pairs of at least ``threshold`` merge, until no two clusters reach it.
    Parts of at most MOST_LOCAL_VECTORS nodes run their rounds within one task; larger ones run the same rounds, with
    one order of links, over the cluster.
    """
    nodes = nodes.select("part", "node", F.col("n").cast("long"), "unit" if "unit" in nodes.columns else "total")
    large = materialize(nodes.groupBy("part").count().where(F.col("count") > MOST_LOCAL_VECTORS).select("part"))
    small = nodes.join(large, "part", "left_anti")
    out = small.repartition("part").sortWithinPartitions("part", "node").mapInArrow(_merge_parts(threshold), "node bigint, cluster bigint")
    if large.limit(1).count():
        wide = nodes.join(large, "part")
        wide = wide.select("part", "node", "n", "unit").mapInArrow(_sums, "part bigint, node bigint, n bigint, total array<double>") if "unit" in nodes.columns else wide
        out = out.unionByName(_merge_over_cluster(wide, threshold))
    return out


def _local_average(threshold: float):
    """Rounds of average linkage on the links of one shard: the cluster of each row, by its smallest row."""

    def run(row: np.ndarray, links: list[tuple[int, int, float]]) -> np.ndarray:
        if not links:
            return row
        a, b, c = zip(*links)
        a, b = row[list(a)], row[list(b)]
        found = merge_locally(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), list(c), threshold)
        return np.array([found.get(r, r) for r in row.tolist()], np.int64)

    return run


def _group_labels(ix: neighbours.Index, min_cos: float, keep: int) -> tuple[DataFrame, DataFrame]:
    """Classes (grp, class_key, n, rows, row, unit) with ``first``, the smallest row of what links of ``min_cos`` connect;
    and the table with all vectors that they are read from, to be released.

    Rounds of mutual best links on a spanning forest of such links: as none is below the threshold, no mean over the
    forest's links is, and merging ends when no links are left. The means so decide nothing, the forest does.
    So the clusters of this graph are all rows linked directly or through others. The rounds run within every shard
    first, then on the few links between clusters of different shards.
    """
    classes, links = spanning_graph(ix, min_cos, _local_average(min_cos), keep=keep)
    if links is None:
        return classes.withColumn("first", F.col("label")), classes
    merged = merge_average(links, min_cos)
    return classes.join(merged.select(F.col("node").alias("label"), "cluster"), "label", "left").withColumn("first", F.coalesce("cluster", "label")), classes


def linked_groups(df: DataFrame, key: str, group: str, vector: str, min_cos: float, *, dimensions: int = 64, least: int = 1) -> DataFrame:
    """grp, row, first, size: usable rows whose linked group has at least ``least`` rows, and its smallest row.

    Rows of one group value are linked if their cosine, rounded to 9 decimals, is at least ``min_cos``; a linked group
    holds all rows linked directly or through others. Copies belong together and are searched once. Unusable rows (see
    ``unit_rows``) take no part. An empty table gives an empty result.
    """
    ix = neighbours.index(df, key, group, vector, dimensions)
    found, home = _group_labels(ix, min_cos, 4)
    classes = materialize(found.select("grp", "class_key", "n", "rows", "first"), lean=True)
    release(home)
    sizes = _sizes(classes, ix).where(F.col("size") >= least)
    named = classes.join(sizes, "first").withColumn("own", F.struct("first", "size"))
    return neighbours.members_of(named, ix, "own", classes).select("grp", "row", "own.first", "own.size")


def _sizes(classes: DataFrame, ix: neighbours.Index) -> DataFrame:
    """first, size: rows of every cluster, a repeated row once."""
    exact = classes.withColumn("rows_of", F.when(F.col("n") <= F.size("rows"), F.col("n")))
    large = exact.where("rows_of IS NULL").select("grp", "class_key")
    counted = ix.rows.select("grp", "class_key", "row").join(large, ["grp", "class_key"], "left_semi").distinct().groupBy("grp", "class_key").agg(F.count(F.lit(1)).alias("counted"))
    return exact.join(counted, ["grp", "class_key"], "left").groupBy("first").agg(F.sum(F.coalesce("rows_of", "counted")).alias("size"))


def average_clusters(df: DataFrame, key: str, group: str, vector: str, threshold: float, *, dimensions: int = 64, typical: int = 3) -> DataFrame:
    """grp, first_row_id, size, typical_row_ids of every cluster, single rows included.

    Average linkage over all pairs, not over the links of a sparse graph: in the end no two clusters have a mean cosine of
    ``threshold``. Every row counts, so a vector that many rows share weighs as many times.
    Clusters that reach it have a pair of rows that reaches it too, so the groups that such pairs connect, found as in
    ``linked_groups``, are independent. Typical are the rows with the largest cosine to the cluster's mean vector, ties
    to the smaller row. Unusable rows take no part; an empty table gives no clusters.
    """
    ix = neighbours.index(df, key, group, vector, dimensions)
    found, home = _group_labels(ix, threshold, typical)
    found = found.select("grp", "class_key", "rows", "row", "unit", F.col("first").alias("part"))
    behind = ix.rows.select("grp", "class_key", "row").distinct().groupBy("grp", "class_key").agg(F.count(F.lit(1)).alias("n"))
    classes = materialize(found.join(behind, ["grp", "class_key"]), lean=True)
    release(home)
    # A part of one class is a cluster as it stands.
    alone = classes.groupBy("part").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("part")
    vectors = classes.join(alone, "part").select("part", F.col("row").alias("node"), "n", "unit")
    labels = materialize(merge_means(vectors, threshold), lean=True)
    members = materialize(classes.join(labels.withColumnRenamed("node", "row"), "row", "left").select("grp", F.coalesce("cluster", "row").alias("first"), "row", "rows", "n", "unit"), lean=True)
    release(classes)
    partial = members.select("grp", "first", "n", "unit").mapInArrow(_partial_means, "grp bigint, first bigint, n bigint, total array<double>")
    sums = partial.groupBy("grp", "first").agg(F.sum("n").alias("size"), *[F.sum(F.col("total")[i]).alias(f"m{i}") for i in range(dimensions)])
    means = sums.select("grp", "first", "size", F.array(*[f"m{i}" for i in range(dimensions)]).alias("mean"))
    scored = members.join(means, ["grp", "first"]).select("grp", "first", "size", "rows", "unit", "mean").mapInArrow(_closeness, "grp bigint, first bigint, size bigint, rows array<bigint>, near double")
    each = scored.select("grp", "first", "size", "near", F.explode("rows").alias("row"))
    w = Window.partitionBy("grp", "first").orderBy(F.desc("near"), "row")
    top = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= typical)
    return top.groupBy("grp", "first", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda s: s["row"]).alias("typical_row_ids")).withColumnRenamed("first", "first_row_id")


def _sums(batches):
    """Sum of the n equal unit vectors of each class."""
    for b in batches:
        if not b.num_rows:
            continue
        x = neighbours.matrix_of(b.column("unit"), b.num_rows) * b.column("n").to_numpy()[:, None]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("node"), b.column("n"), pa.array(list(x), pa.list_(pa.float64()))], ["part", "node", "n", "total"])


def _partial_means(batches):
    """Sums of unit vectors per cluster within a batch, so that a hot cluster leaves a task as few rows."""
    for b in batches:
        if not b.num_rows:
            continue
        behind = b.column("n").to_numpy()
        x = neighbours.matrix_of(b.column("unit"), b.num_rows) * behind[:, None]
        key = np.stack([b.column("grp").to_numpy(), b.column("first").to_numpy()], axis=1)
        named, inverse = np.unique(key, axis=0, return_inverse=True)
        total, n = np.zeros((len(named), x.shape[1])), np.zeros(len(named), np.int64)
        np.add.at(total, inverse.ravel(), x)
        np.add.at(n, inverse.ravel(), behind)
        yield pa.RecordBatch.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], ["grp", "first", "n", "total"])


def _closeness(batches):
    for b in batches:
        if not b.num_rows:
            continue
        x = neighbours.matrix_of(b.column("unit"), b.num_rows)
        mean = pc.list_flatten(b.column("mean")).to_numpy(zero_copy_only=False).reshape(x.shape)
        near = np.round((x * mean).sum(axis=1) / np.maximum(np.linalg.norm(mean, axis=1), 1e-300), 9)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("grp", "first", "size", "rows")] + [pa.array(near)], ["grp", "first", "size", "rows", "near"])
