"""The mixed model's probabilities, bit by bit."""

import tracemalloc

import numpy as np

from corpusmill.llm import lm_scoring


def test_segments_in_step_give_what_each_gives_alone():
    r = np.random.default_rng(2)
    count = np.array([5, 60, 0, 17, 60, 1])
    first, n = np.cumsum(count) - count, int(count.sum())
    x = [r.normal(0, 4, n).astype(np.float32) for _ in range(lm_scoring.INPUTS)]
    gates, bits = r.integers(0, lm_scoring.GATES, n).astype(np.uint8), r.integers(0, 2, n).astype(np.uint8)
    weights = r.normal(0.4, 0.2, (lm_scoring.GATES, lm_scoring.INPUTS)).astype(np.float32)
    found, _, used = lm_scoring.mix(x, gates, bits, first, count, weights)
    expected = np.empty(n)
    for a, m in zip(first, count):
        w = weights.astype(float).copy()
        refine = 1 / (1 + np.exp(-(np.arange(lm_scoring.BUCKETS + 1) - lm_scoring.BUCKETS / 2) / 2))
        for i in range(a, a + m):
            v = np.array([column[i] for column in x], float)
            z = np.clip(w[gates[i]] @ v, -7.9, 7.9)
            p, place = 1 / (1 + np.exp(-z)), int(z * 2 + lm_scoring.BUCKETS / 2 + 0.5)
            one = (p + refine[place]) / 2
            expected[i] = one if bits[i] else 1 - one
            w[gates[i]] += lm_scoring.RATE * (bits[i] - p) * v
            refine[place] += lm_scoring.REFINE_RATE * (bits[i] - refine[place])
    assert np.allclose(found, expected, atol=2e-3)
    assert used.tolist() == np.bincount(gates, minlength=lm_scoring.GATES).tolist()


def test_a_batch_takes_little_memory_beside_its_bits():
    """A worker holds a whole batch's bits at once; columns of eight bytes, kept to the end, took the executors over their memory."""
    r = np.random.default_rng(3)
    count = np.full(600, 1000)
    first, n = np.cumsum(count) - count, int(count.sum())
    x = [r.normal(0, 4, n).astype(np.float32) for _ in range(lm_scoring.INPUTS)]
    gates, bits = r.integers(0, lm_scoring.GATES, n).astype(np.uint8), r.integers(0, 2, n).astype(np.uint8)
    tracemalloc.start()
    lm_scoring.mix(x, gates, bits, first, count, np.full((lm_scoring.GATES, lm_scoring.INPUTS), 0.4, np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n
