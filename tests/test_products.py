"""Wide searches: a matrix product leaves out most pairs, and what is found is that of all distances summed axis by axis."""

import numpy as np
import pytest

from cloudloom.operators import pivots, pyramid


def clouds():
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(1_500, 24)).astype(np.float32)
    lattice = rng.integers(-1, 2, (1_500, 24)).astype(np.float32)  # many equal distances
    copies = plain[rng.integers(0, 300, 1_500)]
    mixed = plain * np.float32(10.0) ** rng.integers(-30, 18, (1_500, 1)).astype(np.float32)
    return {"plain": plain, "far": plain + np.float32(5_000), "lattice": lattice, "copies": copies, "mixed": mixed, "tiny": plain * np.float32(1e-21), "huge": plain * np.float32(1e19)}


@pytest.mark.parametrize("name", list(clouds()))
def test_same_as_all_distances(name):
    x, k, size = clouds()[name], 7, 150
    p = pivots.choose(x[:400].astype(float))
    ids = np.random.default_rng(1).permutation(len(x))  # ranks that don't follow the rows
    at = pivots.to_pivots(x, p)
    block = pivots.PivotNearest(ids[:size], x[:size], k, p)
    for lo in range(0, len(x), size):
        part = slice(lo, lo + size)
        box = np.stack([at[part].min(axis=0), at[part].max(axis=0)])
        block.offer(ids[part], ids[part], x[part], 0.0, box)
    d = pyramid.distances(x[:size], x, 2)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    want = np.take_along_axis(d, order, axis=1)
    assert np.array_equal(block.d, want)
    assert np.array_equal(block.ref[np.isfinite(want)], ids[order][np.isfinite(want)])


def test_few_pairs_are_summed_axis_by_axis(monkeypatch):
    summed, plain = [], pyramid.distances

    def counted(q, r, norm):
        summed.append(len(q) * len(r))
        return plain(q, r, norm)

    monkeypatch.setattr(pyramid, "distances", counted)
    x = np.random.default_rng(2).normal(size=(4_000, 32)).astype(np.float32)
    p = pivots.choose(x[:400].astype(float))
    block, ids = pivots.PivotNearest(np.arange(200), x[:200], 8, p), np.arange(len(x))
    for lo in range(0, len(x), 200):
        block.offer(ids[lo : lo + 200], ids[lo : lo + 200], x[lo : lo + 200], 0.0, np.stack([np.zeros(len(p)), np.full(len(p), 1e9)]))
    assert block.compared == 200 * 4_000 and sum(summed) < 0.1 * block.compared


def test_pairs_of_blocks_grow_slowly():
    """Blocks grow with the table up to a size, so four times the vectors don't make sixteen times the pairs of blocks."""
    count = [(2 * n // pivots.block_size(n)) ** 2 for n in (40_000, 160_000)]
    assert pivots.block_size(20_000) == pivots.BLOCK and count[1] < 5 * count[0]
    assert pivots.block_size(10**9) == pivots.GROWTH * pivots.BLOCK
