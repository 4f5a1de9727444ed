"""Confidence intervals and exact tests from (n, k) counts of 0/1 outcomes.

All of it rests on one expression, the logarithm of a binomial tail. The tail is
an incomplete beta integral, taken at the same few nodes for every n, so that the
work per group does not depend on the number of judgements behind it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nodes of the integral over the part of the integrand above exp(-_DEPTH).
_NODES = 96
_DEPTH = 45.0
# Newton steps to the end of that part. Each at least halves the distance: enough for any bigint n.
_NEWTON = 40


def _in_steps(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    """Add the columns of each step; later steps use earlier columns without recomputing them."""
    for step in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return df


def _stirling_error(x: str) -> str:
    """ln x! minus Stirling's formula, for whole x >= 1."""
    table = [
        math.lgamma(i + 1) - ((i + 0.5) * math.log(i) - i + 0.5 * math.log(2 * math.pi))
        for i in range(1, 16)
    ]
    known = ", ".join(f"{v!r}D" for v in table)
    r = f"(1 / ({x} * {x}))"
    series = f"(1D / 12 - {r} * (1D / 360 - {r} * (1D / 1260 - {r} / 1680D))) / {x}"
    return f"IF({x} < 16, try_element_at(array({known}), CAST(greatest({x}, 1D) AS INT)), {series})"


def _log_pmf(n: str, m: str, k: str) -> str:
    """ln P(X = m) of a binomial X with mean k, for 0 < k < n and k <= m <= n, all of them doubles."""
    rest = f"({n} - {m})"
    # (m - k) / k and its counterpart keep their digits where m is close to k.
    divergence = f"({m} * log1p(({m} - {k}) / {k}) + {rest} * log1p(({k} - {m}) / ({n} - {k})))"
    inner = (
        f"ln({n} / ({2 * math.pi!r}D * {m} * {rest})) / 2 + {_stirling_error(n)}"
        f" - {_stirling_error(m)} - {_stirling_error(rest)} - {divergence}"
    )
    return f"IF({m} >= {n}, {n} * ln({k} / {n}), {inner})"


def _log_tail(n: str, m: str, k: str) -> str:
    """ln P(X >= m) of a binomial X with mean k, for 0 < k < n and k < m <= n, all of them doubles.

    P(X >= m) is m P(X = m) times the integral over u >= 0 of
    exp(-m u) (1 + odds (1 - exp(-u)))^(n - m), which falls from 1 and is log-concave.
    Newton's method, started beyond it, finds where it is exp(-45); up to there it
    is integrated by Gauss and Legendre.
    """
    odds = f"({k} / ({n} - {k}))"

    def depth(u: str) -> str:
        return f"({m} * {u} - ({n} - {m}) * log1p(-{odds} * expm1(-{u})))"

    slope = f"({m} - ({n} - {m}) * {odds} * exp(-u) / (1 - {odds} * expm1(-u)))"
    start = f"({_DEPTH!r}D + ({n} - {m}) * log1p({odds})) / {m}"
    end = (
        f"aggregate(sequence(1, {_NEWTON}), {start},"
        f" (u, step) -> u - ({depth('u')} - {_DEPTH!r}D) / {slope})"
    )
    places, weights = np.polynomial.legendre.leggauss(_NODES)
    nodes = ", ".join(
        f"named_struct('x', {float(1 + x) / 2!r}D, 'w', {float(w) / 2!r}D)" for x, w in zip(places, weights)
    )
    summed = f"aggregate(array({nodes}), 0D, (sum, node) -> sum + node.w * exp(-{depth('(reach * node.x)')}))"
    # A one-element array names the end of the integral, which is used at every node.
    area = f"element_at(transform(array({end}), reach -> reach * {summed}), 1)"
    return f"ln({m}) + {_log_pmf(n, m, k)} + ln({area})"


def _first_below(n: str, k: str, share: float) -> str:
    """The smallest m with P(X >= m) <= ``share`` (below 1/2), by bisection between the mean and n + 1."""
    # The floor, which as a bigint would not hold every count.
    middle = "rint((found.low + found.high) / 2 - 0.25D)"
    small = f"mid >= {n} + 1 OR {_log_tail(n, 'mid', k)} <= {math.log(share)!r}D"
    step = f"""element_at(transform(array({middle}), mid -> IF(mid <= found.low, found, IF({small},
        named_struct('low', found.low, 'high', mid), named_struct('low', mid, 'high', found.high)))), 1)"""
    halvings = f"sequence(1, 1 + CAST(ceil(log2({n} - {k} + 2)) AS INT))"
    return f"""aggregate({halvings}, named_struct('low', {k}, 'high', {n} + 1),
        (found, halving) -> {step}, found -> found.high)"""


def _mean_quantile(share: float) -> str:
    """The quantile of a mean of ``_n`` values of which each is a one with probability ``_k / _n``."""
    if share < 0.5:
        inner = f"_n + 1 - {_first_below('_n', '(_n - _k)', share)}"
    else:
        inner = f"{_first_below('_n', '_k', 1 - share)} - 1"
    return f"""CASE WHEN _n <= 0 THEN NULL WHEN _k <= 0 THEN 0D WHEN _k >= _n THEN 1D
        ELSE ({inner}) / _n END"""


def _counts(n: str, k: str) -> dict[str, str]:
    return {"_n": f"CAST({n} AS DOUBLE)", "_k": f"CAST({k} AS DOUBLE)"}


def with_bootstrap_ci(df: DataFrame, n: str = "n", k: str = "k", alpha: float = 0.05) -> DataFrame:
    """Add ``ci_lower`` and ``ci_upper``: percentile bootstrap bounds of a 0/1 mean.

    Resampling n values of which k are ones makes each replicate mean
    Binomial(n, k/n)/n, so the bounds are two quantiles of that distribution and
    nothing has to be resampled. Null for n = 0.
    """
    bounds = {"ci_lower": _mean_quantile(alpha / 2), "ci_upper": _mean_quantile(1 - alpha / 2)}
    return _in_steps(df, [_counts(n, k), bounds]).drop("_n", "_k")


def with_binom_test(df: DataFrame, n: str = "n", k: str = "k") -> DataFrame:
    """Add ``binom_log10_p`` and ``binom_pvalue``: exact one-sided test of k of n against 1/2.

    p = P(X >= k). The logarithm stays usable where p itself underflows to 0. Below
    the mean p follows from the other tail.
    """
    upper = "2 * _k > _n"
    steps = [
        _counts(n, k),
        {
            "_size": "greatest(_n, 1D)",
            "_m": f"least(IF({upper}, _k, _n - _k + 1), greatest(_n, 1D))",
        },
        {"_log": _log_tail("_size", "_m", "(_size / 2)")},
        {
            "binom_log10_p": f"""CASE WHEN _k <= 0 THEN 0D WHEN {upper} THEN _log / {math.log(10)!r}D
                ELSE log1p(-exp(_log)) / {math.log(10)!r}D END"""
        },
        {"binom_pvalue": "pow(10D, binom_log10_p)"},
    ]
    return _in_steps(df, steps).drop("_n", "_k", "_size", "_m", "_log")


def _uniforms(n_boot: int, seed: int) -> list[float]:
    """One number in (0, 1) per replicate, in ascending order: 13 hex digits of the hash of seed and replicate."""
    digits = (hashlib.md5(f"{seed}|{b}".encode()).hexdigest()[:13] for b in range(n_boot))
    return sorted((int(d, 16) + 0.5) / 2**52 for d in digits)


def bootstrap_by_resampling(
    df: DataFrame,
    by: list[str],
    n: str = "n",
    k: str = "k",
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap bounds over ``n_boot`` random replicates, one row per group with ``ci_lower``/``ci_upper``.

    A replicate mean is binomial, so one uniform number draws it through the
    quantile function of (n, k). That function is monotone: the replicate means
    around a percentile come from the uniform numbers around it, and only those
    are turned into means. Work per group depends on neither n nor ``n_boot``.
    """
    drawn = _uniforms(n_boot, seed)

    def percentile(share: float) -> str:
        place = share * (n_boot - 1)
        low, part = int(place), place - int(place)
        high = min(low + 1, n_boot - 1)
        return f"(1 - {part!r}D) * {_mean_quantile(drawn[low])} + {part!r}D * {_mean_quantile(drawn[high])}"

    bounds = {"ci_lower": percentile(alpha / 2), "ci_upper": percentile(1 - alpha / 2)}
    return _in_steps(df, [_counts(n, k), bounds]).select(*by, "ci_lower", "ci_upper")


def _poisson_cuts() -> list[int]:
    """Of 2**32 equally likely numbers, how many stand for 0, for 1 or less, and so on, of a Poisson count of mean 1."""
    cuts, mass, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total += mass
        cuts.append(int(total * 2**32))
        mass /= k
    return cuts


# Replicates that one hash of a row gives weights for.
_PER_HASH = 4


def bootstrap_mean(
    df: DataFrame,
    by: list[str],
    value: str,
    id_col: str = "sample_id",
    n_boot: int = 200,
    alpha: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap bounds of the mean of a numeric column per group: (by, n, mean, ci_lower, ci_upper).

    In each replicate a row counts a Poisson number of times, of mean 1, drawn from a hash of the seed, the replicate
    and the row's id: that is resampling with replacement without a fixed size, and needs no row to know another. Weights
    and weighted values are summed where rows are read, into ``n_boot`` sums a group; work is linear in rows,
    and what is shuffled does not depend on them. Rows without a value drop out; rows that share an id share their weights.
    ``n_boot`` is a multiple of four. Replicates in which no row of a group counts are left out.
    """
    if n_boot % _PER_HASH:
        raise ValueError(f"n_boot must be a multiple of {_PER_HASH}")
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(value).cast("double").alias("_x")
    )
    hashed = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_boot // _PER_HASH - 1)))).withColumn(
        "_md5", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_block").cast("string"), F.col("_id")))
    )
    weights = {}
    for j in range(_PER_HASH):
        number = f"CAST(conv(substr(_md5, {8 * j + 1}, 8), 16, 10) AS BIGINT)"
        steps = " ".join(f"WHEN {number} < {cut} THEN {k}" for k, cut in enumerate(_poisson_cuts()))
        weights[f"_w{j}"] = F.expr(f"CASE {steps} ELSE {len(_poisson_cuts())} END")
    sums = hashed.withColumns(weights).groupBy(*by, "_block").agg(
        F.count("*").alias("n"),
        F.sum("_x").alias("_sum"),
        *[F.sum(f"_w{j}").alias(f"_n{j}") for j in range(_PER_HASH)],
        *[F.sum(F.col(f"_w{j}") * F.col("_x")).alias(f"_s{j}") for j in range(_PER_HASH)],
    )
    means = F.array(*[F.try_divide(F.col(f"_s{j}"), F.col(f"_n{j}").cast("double")) for j in range(_PER_HASH)])
    bounds = F.percentile("_mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (
        sums.select(*by, "n", "_sum", F.explode(means).alias("_mean"))
        .groupBy(*by)
        .agg(F.max("n").alias("n"), (F.max("_sum") / F.max("n")).alias("mean"), bounds.alias("_bounds"))
        .select(*by, "n", "mean", F.col("_bounds")[0].alias("ci_lower"), F.col("_bounds")[1].alias("ci_upper"))
    )


def bootstrap_parity(
    df: DataFrame,
    by: list[str],
    value: str,
    ordinal: str = "row_ordinal",
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 42,
) -> DataFrame:
    """(by, n, mean, ci_lower, ci_upper) as one seeded generator gives them, group by group in file order.

    For comparing with recorded intervals: every group is resampled in one task, so groups must be small. Use
    ``with_bootstrap_ci`` or ``bootstrap_mean`` for anything else. Rows without a value drop out.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(ordinal).alias("_at"), F.col(value).cast("double").alias("_x"))
    out = T.StructType([df.schema[c] for c in by]).add("n", "long")
    for name in ("mean", "ci_lower", "ci_upper"):
        out = out.add(name, "double")

    def resample(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("_at")["_x"].to_numpy()
        draw = np.random.default_rng(seed)
        means = [values[draw.integers(0, len(values), len(values))].mean() for _ in range(n_boot)]
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([(*key, len(values), values.mean(), low, high)], columns=out.names)

    return rows.groupBy(*by).applyInPandas(resample, out)
