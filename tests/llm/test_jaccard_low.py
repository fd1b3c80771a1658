"""Keys of small sets at low thresholds: all classes, every linked pair shares one."""

import itertools

import numpy as np
import pytest

from dialogweave.llm.ngram_join import COUNTERS_LOG, Signatures

U = np.uint64


def _tokens(kinds, salt):
    """Distinct tokens that fall on a counter of level 0, 100 or 250 as kinds (1, 2, 3) say."""
    counter = {1: 0, 2: 1, 3: 2}
    return np.array([(counter[k] << (64 - COUNTERS_LOG)) + salt * 1000 + i * 128 + 7 for i, k in enumerate(kinds)], U)


@pytest.fixture(scope="module")
def levels():
    table = np.zeros(1 << COUNTERS_LOG, np.uint8)
    table[1], table[2] = 100, 250
    return table.tobytes()


@pytest.mark.parametrize("percent", range(67, 100))
def test_every_mix_of_classes_has_keys(levels, percent):
    make = Signatures(levels, 15, 225, percent)
    for n in range(1, 21):
        for a in range(n + 1):
            for b in range(n - a + 1):
                kinds = [1] * a + [2] * b + [3] * (n - a - b)
                keys = make.of(np.sort(_tokens(kinds, 1)))
                assert len(keys) or make._largest(n) <= n


@pytest.mark.parametrize("percent", [67, 70, 72, 75, 80, 90])
def test_linked_sets_share_a_key(levels, percent):
    make, r, met = Signatures(levels, 15, 225, percent), np.random.default_rng(percent), 0
    for n, lost, added in itertools.product(range(2, 21), range(0, 4), range(0, 4)):
        if 100 * (n - lost) < percent * (n + added) or not lost + added:
            continue
        for _ in range(30):
            kinds = r.integers(1, 4, n + added)
            every = r.permutation(_tokens(kinds, 1))
            x, y = np.sort(every[:n]), np.sort(every[lost:])
            assert np.intersect1d(make.of(x), make.of(y)).size, (n, lost, added, kinds)
            met += 1
    assert met > 100
