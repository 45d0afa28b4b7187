from math import comb

import numpy as np
import pytest

from quillon.llm import near_dedup as nd


def misses(agree):
    """How often no band agrees whole where ``agree`` registers do, whichever they are."""
    b, r, n = nd.BANDS, nd.BAND_ROWS, nd.BUCKETS
    ways = sum((-1) ** j * comb(b, j) * comb(n - r * j, agree - r * j) for j in range(agree // r + 1) if j <= b)
    return ways / comb(n, agree)


def simulated(union, percent, pairs, seed=11):
    """The miss rate of pairs of sets exactly so similar, by their real registers."""
    rnd = np.random.default_rng(seed)
    both = union * percent // 100
    own = (union - both) // 2
    agree = np.zeros(nd.BUCKETS + 1, int)
    for _ in range(pairs):
        s = rnd.integers(0, 2**64, union, dtype=np.uint64)
        agree[(nd.registers(s[: both + own]) == nd.registers(np.concatenate([s[:both], s[both + own :]]))).sum()] += 1
    return sum(n * misses(k) for k, n in enumerate(agree) if n) / pairs


@pytest.mark.parametrize("union", [100, 400, 2000])
def test_simulated_recall(union):
    assert simulated(union, 85, 2000) < 1e-8
    assert simulated(union, 80, 2000) < 1e-5
