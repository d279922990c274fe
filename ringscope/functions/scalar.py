"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Coefficients of a published rational approximation of the normal
#: distribution, highest degree first (Hart 1968, West 2005).
PHI_P = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
PHI_Q = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients, a: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * a + F.lit(c)
    return out


def norm_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    a = F.abs(z)
    inner = F.exp(-a * a / 2) * _horner(PHI_P, a) / _horner(PHI_Q, a)
    outer = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, inner).otherwise(outer)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(z: str) -> str:
    horner = lambda cs, a: "".join(["("] * (len(cs) - 1)) + repr(cs[0]) + "".join(f" * {a} + {c!r})" for c in cs[1:])
    a = f"abs({z})"
    tail = f"(CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2e0) * {horner(PHI_P, a)} / {horner(PHI_Q, a)} ELSE exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65))))) / 2.506628274631 END)"
    return f"(CASE WHEN {z} > 0 THEN 1e0 - {tail} ELSE {tail} END)"


def slog(numer: Column, denom: Column, s: Column) -> Column:
    """s ln(numer / denom), both kept off zero; 0 where s is 0 or an argument negative."""
    off = lambda v: v * (1 - 1e-10) + 1e-10
    return F.when((s == 0) | (numer < 0) | (denom < 0), 0.0).otherwise(s * F.ln(off(numer) / off(denom)))


def safe_div(a: Column, b: Column, least: float = 1e-20) -> Column:
    return a / F.greatest(b, F.lit(least))


def touches_core(xs: Column, xd: Column) -> Column:
    """1 if either end is in the core, for 0/1 coreness."""
    return xs + xd - xs * xd


def rank_coreness(rank: Column, n: Column, alpha: float, beta: float) -> Column:
    """Coreness of the node of 0-based rank, lowest first: rises slowly to (1 - alpha) / 2
    over the first floor(beta n) ranks, then to 1."""
    cut = F.floor(F.lit(beta) * n)
    low = (1 - alpha) / (2 * F.greatest(cut, F.lit(1))) * rank
    high = (rank - cut) * (1 - alpha) / (2 * (n - cut)) + (1 + alpha) / 2
    return F.when(rank <= cut, low).otherwise(high)


def soft_threshold(x: Column, lam: float, positive: bool = False) -> Column:
    out = F.signum(x) * F.greatest(F.abs(x) - lam, F.lit(0.0))
    return F.greatest(out, F.lit(0.0)) if positive else out


def sidak(level: float, tests: Column) -> Column:
    """Level of each of several tests that keeps the joint level."""
    return 1 - F.pow(F.lit(1 - level), 1 / tests)


def coreness_bin(x: Column, bins: int = 11) -> Column:
    """How many of `bins` points spread over 0..1 a coreness reaches."""
    return F.greatest(F.lit(0), F.least(F.lit(bins), F.floor(x * (bins - 1)).cast("int") + 1))


def hover_text(label: Column, c: Column, x: Column) -> Column:
    return F.concat(F.lit("node: "), label, F.lit(", pair: "), F.coalesce(c.cast("string"), F.lit("residual")), F.lit(", coreness: "), F.when(x.isNotNull(), F.format_string("%.3f", x)).otherwise("none"))
