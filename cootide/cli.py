"""Command line: ``python -m cootide.cli check|stats|convert|reorder|cpd|bench FILE ...``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from cootide.core import TensorError
from cootide.operators import cpd, graphs, partition, reorder, stats, structure
from cootide.session import local_session
from cootide.sources import binary, matrices, text


def _check(spark, a) -> None:
    x = text.read(spark, a.file).materialize()
    dups, empty, fixed = x.check()
    if not dups and not empty:
        print("NO ERRORS FOUND.")
    else:
        print(f"DUPLICATES={dups} EMPTY-SLICES={empty}")
    if a.fix:
        text.write(fixed, a.fix, **({} if text.format_of(a.fix) == "binary" else {"single_file": True}))
        for m, ids in fixed.maps.items():
            matrices.write_map(ids, f"{a.map or a.fix + '.'}mode{m + 1}.map")


def _stats(spark, a) -> None:
    x = text.read(spark, a.file).materialize()
    print(stats.stats_text(x, a.file))
    if a.tree:
        print(stats.tree_text(x, a.tree))
    if a.parts:
        n = structure.fibers(x, a.mode).count()
        per = partition.fiber_part_stats(x, matrices.read_parts(spark, os.path.abspath(a.parts), n), a.mode)
        for r in per.orderBy("part").collect():
            print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))


def _convert(spark, a) -> None:
    x = text.read(spark, a.file).materialize()
    print(stats.stats_text(x, a.file))
    if a.type == "graph":
        matrices.write_graph(x, a.out)
    elif a.type == "nnz":
        matrices.write_hypergraph(graphs.nonzero_pins(x), sum(x.dims), x.nnz(), a.out)
    elif a.type == "fib":
        f = structure.fibers(x, a.mode)
        matrices.write_hypergraph(graphs.fiber_pins(x, a.mode), sum(x.dims), f.count(), a.out, f.selectExpr("fiber v", "nnz w"))
    elif a.type == "fibmat":
        matrices.write_fiber_matrix(x, a.mode, a.out)
    elif a.type == "bin":
        binary.write_binary(x, a.out)
    else:
        text.write_text(x, a.out, single_file=True)


def _reorder(spark, a) -> None:
    x = text.read(spark, a.file).materialize()
    parts = matrices.read_parts(spark, os.path.abspath(a.parts)) if a.parts else None
    if parts is not None and a.type == "graph":
        parts = parts.withColumnRenamed("vtx", "v")
    y, perms = reorder.reorder(x, a.type, seed=a.seed, parts=parts, mode=a.mode)
    if a.out:
        text.write(y, a.out, **({} if text.format_of(a.out) == "binary" else {"single_file": True}))
    for m, p in perms.items():
        if a.perm:
            matrices.write_permutation(p, f"{a.perm}mode{m}.perm")


def _cpd(spark, a) -> None:
    x = text.read(spark, a.file).materialize()
    print(stats.stats_text(x, a.file))
    o = cpd.CpdOptions(tolerance=a.tol, regularization=a.reg, max_iterations=a.iters, seed=a.seed, init=a.init, compact=a.compact, verbosity=a.verbose + 1)
    out = cpd.cpd_als(x, a.rank, o)
    for it, fit in enumerate(out.fits, 1):
        print(f"  its = {it:3d}  fit = {fit:.5f}")
    print(f"Final fit: {out.fit:.5f}")
    if not a.nowrite:
        out.save(spark, a.stem + "." if a.stem else "")


def _bench(spark, a) -> None:
    x = text.read(spark, a.file)
    for plan, parts, mode, seconds in stats.sweep(x, a.alg or ["wide"], a.parts or [int(spark.conf.get("spark.sql.shuffle.partitions"))], a.rank, a.iters):
        print(f"{plan:<8} parts {parts:3d} mode {mode}: {seconds:.4f}s")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cootide")
    p.add_argument("--cpus", default="*")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, run, **more):
        s = sub.add_parser(name, **more)
        s.add_argument("file")
        s.set_defaults(run=run)
        return s

    s = verb("check", _check, help="find duplicates and empty slices")
    s.add_argument("--fix"), s.add_argument("--map")
    s = verb("stats", _stats, help="size, density, compressed forms, partitions")
    s.add_argument("--tree", choices=["one", "two", "all"]), s.add_argument("-p", "--parts"), s.add_argument("-m", "--mode", type=int, default=0)
    s = verb("convert", _convert, help="to other text forms, graphs, binary")
    s.add_argument("out"), s.add_argument("-t", "--type", choices=["coo", "bin", "graph", "nnz", "fib", "fibmat"], default="coo"), s.add_argument("-m", "--mode", type=int, default=0)
    s = verb("reorder", _reorder, help="relabel modes")
    s.add_argument("out", nargs="?"), s.add_argument("-t", "--type", choices=["random", "graph", "hgraph"], default="random"), s.add_argument("-p", "--parts")
    s.add_argument("--perm"), s.add_argument("-m", "--mode", type=int, default=0), s.add_argument("--seed", type=int, default=0)
    s = verb("cpd", _cpd, help="decompose")
    s.add_argument("-r", "--rank", type=int, default=10), s.add_argument("--tol", type=float, default=1e-5), s.add_argument("--reg", type=float, default=0.0)
    s.add_argument("-i", "--iters", "--its", type=int, default=50), s.add_argument("--seed", type=int, default=0), s.add_argument("--init", choices=["random", "affine"], default="random")
    s.add_argument("--compact", action="store_true"), s.add_argument("-v", "--verbose", action="count", default=0), s.add_argument("--nowrite", action="store_true"), s.add_argument("-s", "--stem", default="")
    s = verb("bench", _bench, help="time product plans")
    s.add_argument("-a", "--alg", action="append"), s.add_argument("-r", "--rank", type=int, default=10), s.add_argument("-i", "--iters", type=int, default=5)
    s.add_argument("-p", "--parts", action="append", type=int, help="number of partitions of the tensor; may be repeated")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if "://" not in a.file:
        a.file = os.path.abspath(a.file)
    logging.basicConfig(level=logging.WARNING)
    try:
        a.run(local_session(a.cpus), a)
    except (TensorError, OverflowError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
