"""Intervals and tests against published figures and independent arithmetic."""

import math
from fractions import Fraction
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pytest

from pairwright.functions import statistics
from pairwright.functions.statistics import (
    bootstrap_by_resampling,
    with_binom_test,
    with_bootstrap_ci,
)

# Published figures: n, k, lower bound, upper bound (and p for the validity runs).
VALIDITY = [
    (99, 89, 0.838384, 0.959596, 2.7606e-17),
    (99, 87, 0.808081, 0.939394, 1.6849e-15),
    (99, 94, 0.898990, 0.989899, 1.1904e-22),
    (88, 81, 0.863636, 0.965909, 2.2398e-17),
    (99, 88, 0.828283, 0.949495, 2.2648e-16),
    (7, 7, 1.0, 1.0, 0.0078125),
]
STABILITY = [
    (45, 35, 0.6444, 0.8889),
    (45, 41, 0.8222, 0.9778),
    (45, 43, 0.8889, 1.0),
    (37, 33, 0.7838, 0.9730),
    (45, 40, 0.7778, 0.9778),
    (45, 44, 0.9333, 1.0),
    (45, 42, 0.8444, 1.0),
    (40, 40, 1.0, 1.0),
]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "n long, k long")


def exact_p(n, k):
    return Fraction(sum(math.comb(n, i) for i in range(k, n + 1)), 2**n)


def test_published_bounds(spark):
    known = [row[:4] for row in VALIDITY] + STABILITY
    for r, (n, k, low, high) in zip(
        with_bootstrap_ci(frame(spark, [row[:2] for row in known])).collect(), known, strict=True
    ):
        # The published bounds come from 2,000 random replicates: off by one step of 1/n at most.
        assert abs(r.ci_lower - low) < 1.01 / n and abs(r.ci_upper - high) < 1.01 / n, (n, k)


def test_published_p_values(spark):
    rows = with_binom_test(frame(spark, [row[:2] for row in VALIDITY])).collect()
    for r, row in zip(rows, VALIDITY, strict=True):
        assert r.binom_pvalue == pytest.approx(row[4], rel=1e-4)


def test_binom_against_exact_fractions(spark):
    cases = [(n, k) for n in (1, 2, 3, 10, 17, 60) for k in range(n + 1)]
    cases += [(1000, 500), (1000, 501), (1000, 400), (1000, 1000), (3000, 1600), (2001, 0)]
    for r in with_binom_test(frame(spark, cases)).collect():
        p = exact_p(r.n, r.k)
        log10 = math.log10(p.numerator) - math.log10(p.denominator)
        assert r.binom_log10_p == pytest.approx(log10, rel=1e-9, abs=1e-9), (r.n, r.k)


def test_binom_for_large_groups(spark):
    """Far beyond one term per count the tail meets the normal tail; no underflow of the logarithm."""
    n = 10**12
    rows = {
        r.k: r.binom_log10_p
        for r in with_binom_test(
            frame(spark, [(n, n // 2 + 500_000 * z) for z in (-1, 0, 1, 3)] + [(n, int(n * 0.9))])
        ).collect()
    }
    for z in (-1, 1, 3):
        tail = math.erfc(z / math.sqrt(2)) / 2
        assert rows[n // 2 + 500_000 * z] == pytest.approx(math.log10(tail), abs=1e-5)
    assert rows[n // 2] == pytest.approx(math.log10(0.5), abs=1e-5)
    f = 0.9
    rate = f * math.log(2 * f) + (1 - f) * math.log(2 * (1 - f))
    assert rows[int(n * 0.9)] == pytest.approx(-n * rate / math.log(10), rel=1e-6)


def binomial_quantile(n, k, share):
    p, total = Fraction(k, n), Fraction(0)
    for i in range(n + 1):
        total += math.comb(n, i) * p**i * (1 - p) ** (n - i)
        if total >= share:
            return i / n
    return 1.0


def test_interval_is_the_binomial_quantile(spark):
    cases = [(n, k) for n in (1, 2, 5, 30) for k in range(n + 1)] + [(200, 1), (200, 199), (300, 150)]
    for r in with_bootstrap_ci(frame(spark, cases)).collect():
        assert r.ci_lower == pytest.approx(binomial_quantile(r.n, r.k, Fraction(25, 1000))), (r.n, r.k)
        assert r.ci_upper == pytest.approx(binomial_quantile(r.n, r.k, Fraction(975, 1000))), (r.n, r.k)


@pytest.mark.parametrize("n", [10**7 - 1, 10**7, 10**7 + 1, 10**9, 10**12])
def test_interval_of_large_groups_meets_the_expansion(spark, n):
    """The same method at every size; the second-order expansion of the quantile is off by a step at most."""
    z = NormalDist().inv_cdf(0.975)
    for r in with_bootstrap_ci(frame(spark, [(n, n // 500), (n, n // 2), (n, n - n // 7)])).collect():
        sd = math.sqrt(r.k * (1 - r.k / n))
        skew = (1 - 2 * r.k / n) * (z * z - 1) / 6 - 0.5
        assert abs(r.ci_lower * n - math.ceil(r.k - z * sd + skew)) <= 1.01, r
        assert abs(r.ci_upper * n - math.ceil(r.k + z * sd + skew)) <= 1.01, r


@pytest.mark.parametrize("n", [10**7 - 1, 10**7 + 1, 10**9, 10**12])
def test_binom_is_continuous_in_size(spark, n):
    for r in with_binom_test(frame(spark, [(n, n // 2 + z * math.isqrt(n) // 2) for z in (-2, 1, 2, 4)])).collect():
        # The normal tail with half a step of correction.
        tail = math.erfc((2 * r.k - 1 - n) / math.sqrt(n) / math.sqrt(2)) / 2
        assert r.binom_log10_p == pytest.approx(math.log10(tail), abs=1e-5), r


def test_interval_against_numpy_resampling(spark):
    rng = np.random.default_rng(42)
    for n, k in [(45, 35), (99, 89)]:
        values = np.repeat([1.0, 0.0], [k, n - k])
        means = [rng.choice(values, size=n).mean() for _ in range(2000)]
        r = with_bootstrap_ci(frame(spark, [(n, k)])).first()
        assert abs(np.quantile(means, 0.025) - r.ci_lower) <= 1.01 / n
        assert abs(np.quantile(means, 0.975) - r.ci_upper) <= 1.01 / n


def test_resampling_mode(spark):
    """Every replicate drawn by hand from its uniform number through the exact quantile function."""
    groups = [("x", 45, 35), ("y", 30, 30), ("z", 60, 0), ("w", 12, 1), ("v", 0, 0)]
    df = spark.createDataFrame(groups, "g string, n long, k long")
    found = {r.g: (r.ci_lower, r.ci_upper) for r in bootstrap_by_resampling(df, ["g"], n_boot=50).collect()}
    drawn = [(int(md5(f"42|{b}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for b in range(50)]
    for g, n, k in groups[:4]:
        means = [binomial_quantile(n, k, Fraction(u)) for u in drawn]
        assert found[g] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975]))), g
    assert found["v"] == (None, None)


def test_interval_shrinks_with_alpha(spark):
    wide = with_bootstrap_ci(frame(spark, [(400, 300)]), alpha=0.01).first()
    narrow = with_bootstrap_ci(frame(spark, [(400, 300)]), alpha=0.2).first()
    assert wide.ci_lower < narrow.ci_lower < 0.75 < narrow.ci_upper < wide.ci_upper


# Recorded runs of 99 items, the places of the wrong verdicts among the parsed ones, and the published bounds.
RECORDED = [
    (88, [0, 15, 19, 36, 39, 47, 54], 0.863636, 0.965909),
    (99, [15, 27, 31, 39, 51, 61, 65, 78, 81, 95], 0.838384, 0.959596),
    (99, [15, 25, 27, 43, 51, 58, 65, 66, 71, 78, 81, 82], 0.808081, 0.939394),
    (99, [19, 25, 27, 43, 51, 58, 67, 78, 82, 86, 95], 0.828283, 0.949495),
    (99, [0, 47, 51, 58, 65], 0.898990, 0.989899),
]


def test_parity_reproduces_recorded_intervals(spark):
    table = [(str(j), i, float(i not in wrong)) for j, (n, wrong, _, _) in enumerate(RECORDED) for i in range(n)]
    table += [("9", 0, None), ("8", 0, 1.0)]
    df = spark.createDataFrame(table, "judge string, row_ordinal long, correct double").repartition(5)
    found = {r.judge: r for r in statistics.bootstrap_parity(df, ["judge"], "correct").collect()}
    assert set(found) == {"0", "1", "2", "3", "4", "8"}
    for j, (n, wrong, low, high) in enumerate(RECORDED):
        r = found[str(j)]
        assert (r.n, round(r.ci_lower, 6), round(r.ci_upper, 6)) == (n, low, high)
        assert r.mean == pytest.approx(1 - len(wrong) / n)


def test_bootstrap_of_a_numeric_column(spark):
    """Replicate by replicate against weights drawn in Python; rows in any order and partition."""
    import hashlib

    import numpy as np

    rng = np.random.default_rng(5)
    table = [(f"i{i}", "ab"[i % 3 == 0], float(rng.gamma(2.0, 50.0))) for i in range(300)] + [("x", "a", None), (None, "c", 4.0)]
    df = spark.createDataFrame(table, "sample_id string, part string, size double")
    found = {r.part: r for r in statistics.bootstrap_mean(df.repartition(4), ["part"], "size").collect()}
    cuts = np.array(statistics._poisson_cuts())
    for part in "abc":
        own = [(i or "", x) for i, p, x in table if p == part and x is not None]
        x = np.array([v for _, v in own])
        means = []
        for b in range(200):
            digits = [hashlib.md5(f"42|{b // 4}|{i}".encode()).hexdigest()[8 * (b % 4) :][:8] for i, _ in own]
            w = np.searchsorted(cuts, [int(d, 16) for d in digits], side="right")
            if w.sum():
                means.append((w * x).sum() / w.sum())
        low, high = np.quantile(means, [0.025, 0.975])
        r = found[part]
        assert (r.n, r.mean, r.ci_lower, r.ci_upper) == (len(own), pytest.approx(x.mean()), pytest.approx(low), pytest.approx(high))
    spread = np.std([x for _, p, x in table if p == "a" and x], ddof=1) / found["a"].n ** 0.5
    assert 0.75 < (found["a"].ci_upper - found["a"].ci_lower) / (2 * 1.96 * spread) < 1.3
    assert statistics.bootstrap_mean(df.limit(0), ["part"], "size").count() == 0
    with pytest.raises(ValueError, match="multiple of 4"):
        statistics.bootstrap_mean(df, ["part"], "size", n_boot=10)
