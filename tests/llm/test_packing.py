"""The dominance reduction against optimal packings, and plans against plain best-fit decreasing."""

from functools import lru_cache

import numpy as np
import pytest

from tidemark.llm import packing


def optimum(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        best = len(left)

        def fill(chosen, at, room):
            nonlocal best
            rest = list(left[1:])
            for c in chosen:
                rest.remove(c)
            best = min(best, 1 + least(tuple(rest)))
            for i in range(at, len(left)):
                if left[i] <= room:
                    fill([*chosen, left[i]], i + 1, room - left[i])

        fill([], 1, capacity - left[0])
        return best

    return least(sizes)


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms[rooms.index(min(fits))] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def number(fillings):
    return sum(n for _, n in fillings)


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(6, 30))
    sizes = rng.integers(1 if seed % 2 else max(1, capacity // 5), capacity + 1, int(rng.integers(1, 10))).tolist()
    counts = np.bincount(sizes, minlength=capacity + 1)
    fixed = packing.reduced(counts)
    assert (counts >= 0).all()
    left = np.repeat(np.arange(capacity + 1), counts).tolist()
    used = [x for f, n in fixed for x in f * n]
    assert sorted(used + left) == sorted(sizes) and all(sum(f) <= capacity for f, _ in fixed)
    assert number(fixed) + optimum(left, capacity) == optimum(sizes, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_never_more_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, 200).tolist()
    counts = np.bincount(sizes, minlength=65)
    assert number(packing.best_fit(counts)) == plain_best_fit(sizes, 64)
    assert number(packing.plan({s: sizes.count(s) for s in set(sizes)}, 64)) <= plain_best_fit(sizes, 64)


def test_the_reduction_decides():
    """Instances that best fit alone packs into more sequences than it does after the reduction, and none into fewer."""
    better = 0
    for seed in range(300):
        counts = np.bincount(np.random.default_rng(seed).integers(12, 35, 12), minlength=61)
        whole, rest = number(packing.best_fit(counts)), counts.copy()
        with_reduction = number(packing.reduced(rest)) + number(packing.best_fit(rest))
        assert with_reduction <= whole
        better += with_reduction < whole
    assert better
