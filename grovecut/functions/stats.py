"""Association measures within a corpus and keyness measures between two, as column expressions on raw doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger trees have no association measures.
MOST_NODES = 10
#: What stands for 0 occurrences in the second corpus.
PROXY = 1e-18


def association(number: Column, n: Column, unigram_counts: Column, size: int) -> dict[str, Column]:
    """From a tree's number, its nodes and their counts: null for trees of more than MOST_NODES nodes."""
    product = F.aggregate(unigram_counts, F.lit(1.0), lambda x, c: x * c)
    expected = product / F.pow(F.lit(float(size)), n - 1)
    total = F.aggregate(unigram_counts, F.lit(0.0), lambda x, c: x + c)
    dice = n * number / total
    out = {
        "mi": F.log2(number / expected),
        "mi3": F.log2(F.pow(number, F.lit(3.0)) / expected),
        "dice": dice,
        "log_dice": 14 + F.log2(dice),
        "t_score": (number - expected) / F.sqrt(number),
        "simple_ll": 2 * (number * F.log10(number / expected) - (number - expected)),
    }
    return {k: F.when(n <= MOST_NODES, v) for k, v in out.items()}


def keyness(a: Column, b: Column, c: float, d: float) -> dict[str, Column]:
    """From the numbers in two corpora and the corpora's tokens: ratio and odds ratio are NaN where undefined."""
    nan = F.lit(float("nan"))
    p = F.when(b <= 0, PROXY).otherwise(b)
    first, second = c * (a + p) / (c + d), d * (a + p) / (c + d)
    ll = 2 * (a * F.ln(a / first) + p * F.ln(p / second))
    ra, rb = a / c, p / d
    return {
        "relative_frequency_2": b * 1_000_000.0 / d,
        "ratio": F.when(b == 0, nan).otherwise((a / c) / (b / d)),
        "ll": ll,
        "bic": ll - F.ln(F.lit(c + d)),
        "log_ratio": F.log2(ra / rb),
        "odds_ratio": F.when((a == c) | (p == d), nan).otherwise((a / (c - a)) / (p / (d - p))),
        "diff": (ra * 1e6 - rb * 1e6) * 100 / (rb * 1e6),
    }
