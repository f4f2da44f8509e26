"""Approximate sets: sizes, no wrong no, few wrong yes."""

import numpy as np
import pytest
from strandmill.operators.bloom import BloomFilter, ScalableBloomFilter, optimal_bits, optimal_hashes


def test_sizes():
    assert optimal_bits(0.01, 128) == 1227 and optimal_hashes(1227, 128) == 7
    assert optimal_bits(0.0001, 10_000_000) == 191_701_168 and optimal_hashes(191_701_168, 10_000_000) == 14
    for rate, n in ((0.0, 1), (1.0, 1), (0.5, 0)):
        with pytest.raises(ValueError):
            BloomFilter(rate, n)


def test_layers():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**62, 5000).astype(np.uint64)
    made = ScalableBloomFilter(0.001, 500)
    assert not made.contains(keys).any()
    before = made.insert(keys)
    assert made.contains(keys).all() and before.mean() < 0.01
    assert [x.capacity for x in made.layers] == [500, 1000, 3000, 9000] and made.layers[3].rate == pytest.approx(0.001 * 0.85**3)
    assert made.contains(keys + np.uint64(1 << 63)).mean() < 0.01
    assert made.insert(np.repeat(keys[:3] | np.uint64(1 << 63), 2)).tolist()[1::2] == [True] * 3


def test_second_layer_of_names():
    n = 20_000_000
    bits = optimal_bits(0.0001 * 0.85, n)
    assert bits == 390_167_573 and optimal_hashes(bits, n) == 14
