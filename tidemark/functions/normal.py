"""The normal distribution as column expressions and, word for word, as SQL of other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the upper tail (numerator, denominator, from the highest power on) and Acklam's
# approximation of the quantile (centre and tails), published coefficients.
TAIL_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CENTRE_UP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_DOWN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
EDGE_UP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
EDGE_DOWN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
EDGE = 0.02425


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def _tail(x: str) -> str:
    """The probability above x >= 0."""
    near = f"{_poly(TAIL_UP, x)} / {_poly(TAIL_DOWN, x)}"
    far = f"1D / ({x} + 1D / ({x} + 2D / ({x} + 3D / ({x} + 4D / ({x} + 0.65D))))) / 2.506628274631D"
    return f"(case when {x} > 37 then 0D else exp(-{x} * {x} / 2D) * (case when {x} < 7.07106781186547D then {near} else {far} end) end)"


def cdf_sql(x: str, spark: bool = False) -> str:
    """SQL of the probability below x; the error is below 1e-14. x is repeated, so it should be a column's name. Null for null."""
    text = f"(case when {x} is null then null when {x} > 0 then 1D - {_tail(f'abs({x})')} else {_tail(f'abs({x})')} end)"
    return text if spark else text.replace("D", "::double")


def ppf_sql(p: str, spark: bool = False) -> str:
    """SQL of the value below which lies the probability p; the relative error is below 1.2e-9. Null for null and outside (0, 1)."""
    q, r = f"({p} - 0.5D)", f"(({p} - 0.5D) * ({p} - 0.5D))"
    low, high = f"sqrt(-2D * ln({p}))", f"sqrt(-2D * ln(1D - {p}))"
    centre = f"{_poly(CENTRE_UP, r)} * {q} / {_poly(CENTRE_DOWN, r)}"
    edge = lambda t: f"{_poly(EDGE_UP, t)} / {_poly(EDGE_DOWN, t)}"
    text = f"(case when {p} > 0D and {p} < 1D then case when {p} < {EDGE}D then {edge(low)} when {p} > 1D - {EDGE}D then -{edge(high)} else {centre} end end)"
    return text if spark else text.replace("D", "::double")


def cdf(column: str) -> Column:
    return F.expr(cdf_sql(column, spark=True))


def ppf(column: str) -> Column:
    return F.expr(ppf_sql(column, spark=True))
