"""Small tensors and NumPy references for the tests."""

from itertools import product

import numpy as np

from cootide.core import SparseTensor

SMALL = {(0, 0, 1): 3, (0, 1, 0): 1, (0, 2, 0): 2, (1, 0, 0): 4, (1, 1, 1): 6, (1, 2, 0): 5}
SMALL4 = {(0, 0, 1, 0): 1, (0, 0, 1, 1): 1, (0, 0, 2, 0): 2, (0, 1, 0, 2): 3, (1, 0, 0, 0): 4, (1, 0, 0, 1): 4, (1, 0, 1, 0): 5, (1, 1, 2, 1): 5}


def tensor(spark, cells, dims=None):
    return SparseTensor.from_arrays(spark, list(cells), list(cells.values()), dims=dims)


def med(dims, nnz, seed=1):
    """Hashed distinct coordinates with whole values 1..9."""
    rng = np.random.default_rng(seed)
    cells = {}
    while len(cells) < nnz:
        cells[tuple(int(rng.integers(d)) for d in dims)] = int(rng.integers(1, 10))
    return cells


def affine(dims, rank):
    return [np.array([[(7 * i + 5 * r + 3 * m) % 11 - 5 for r in range(rank)] for i in range(d)], float) for m, d in enumerate(dims)]


def mttkrp(cells, dims, factors, mode):
    out = np.zeros((dims[mode], factors[0].shape[1]))
    for at, v in cells.items():
        row = float(v)
        for k, i in enumerate(at):
            if k != mode:
                row = row * factors[k][i]
        out[at[mode]] += row
    return out


def dense(factors, weights):
    dims = [len(f) for f in factors]
    out = np.zeros(dims)
    for at in product(*map(range, dims)):
        out[at] = sum(weights[r] * np.prod([f[i, r] for f, i in zip(factors, at)]) for r in range(len(weights)))
    return out


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
