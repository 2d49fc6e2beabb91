"""Python's seeded sequence of random numbers from any place on, without making what comes before.

The generator (MT19937) is linear over GF(2): the word that is ``n`` steps further on is the sum of those of the next 19,937 words
that x^n has, reduced by the sequence's characteristic polynomial. Polynomials are integers here, a bit for each power.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

#: Fixed values of the generator: words of its state, the degree of its polynomial.
WORDS, DEGREE = 624, 19_937


def _tempered_back(y: np.ndarray) -> np.ndarray:
    """The words of the recurrence that outputs come from."""
    y = y.astype(np.uint64)
    y ^= y >> np.uint64(18)
    y ^= (y << np.uint64(15)) & np.uint64(0xEFC60000)
    x = y.copy()
    for _ in range(4):
        x = y ^ ((x << np.uint64(7)) & np.uint64(0x9D2C5680))
    y = x.copy()
    for _ in range(2):
        x = y ^ (x >> np.uint64(11))
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _generator(words: np.ndarray) -> np.random.RandomState:
    """A generator that goes on after the given 624 words."""
    g = np.random.RandomState()
    g.set_state(("MT19937", words, WORDS))
    return g


def _raw(words: np.ndarray, n: int) -> np.ndarray:
    """The next ``n`` words of the recurrence."""
    return _tempered_back(_generator(words).randint(0, 2**32, n, dtype=np.uint32))


def _seeded(seed: int) -> np.ndarray:
    return np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)


@lru_cache(maxsize=1)
def characteristic() -> int:
    """The polynomial that every sequence of the recurrence meets, from the bits of one (shortest linear recurrence)."""
    bits = (_raw(_seeded(1), 2 * DEGREE + 64) & 1).tolist()
    now, before, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit  # bit i is that of i steps ago
        if (now & seen).bit_count() & 1:
            if 2 * length <= n:
                now, before, length, gap = now ^ (before << gap), now, n + 1 - length, 1
                continue
            now ^= before << gap
        gap += 1
    assert length == DEGREE
    return int(format(now, f"0{DEGREE + 1}b")[::-1], 2)


@lru_cache(maxsize=1)
def _lower_terms() -> tuple[int, ...]:
    """Powers of the characteristic polynomial but the highest."""
    p = characteristic() ^ (1 << DEGREE)
    return tuple(i for i in range(DEGREE) if p >> i & 1)


def _reduced(p: int) -> int:
    while high := p >> DEGREE:
        p ^= high << DEGREE
        for i in _lower_terms():
            p ^= high << i
    return p


def power(n: int) -> int:
    """x^n, reduced."""
    p = 1
    for bit in format(n, "b"):
        p = _reduced(int(format(p, "b").replace("0", "00").replace("1", "01"), 2))
        if bit == "1":
            p = _reduced(p << 1)
    return p


def after(seed: int, n: int) -> np.random.RandomState:
    """The generator of ``random.Random(seed)`` after ``n`` numbers: random_sample gives the next ones, as random() does."""
    start, ahead = _seeded(seed), 2 * n  # a number takes two words
    if ahead < 4 * WORDS:
        g = _generator(start)
        g.random_sample(n)
        return g
    p = power(ahead - WORDS)
    raw = _raw(start, DEGREE + WORDS)
    total = np.zeros(WORDS, np.uint32)
    for i, bit in enumerate(format(p, "b")[::-1]):
        if bit == "1":
            total ^= raw[i : i + WORDS]
    return _generator(total)
