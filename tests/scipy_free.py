"""Exact reference values for the tests."""

from math import comb


def binomial_tail(a: int, na: int, b: int, nb: int) -> float:
    hits = a + b
    return sum(comb(na, i) * comb(nb, hits - i) for i in range(a, min(hits, na) + 1)) / comb(
        na + nb, hits
    )
