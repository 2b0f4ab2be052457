"""Twenty candidate densities, the special functions they need, quadrature and derivatives; numpy only.

A density is g((x - loc) / scale) / scale; parameters are the shapes followed by loc and scale. The column form of a
log-density is a plain expression of the column, as all normalising constants are scalars.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> number of shape parameters
SHAPES = {
    "norm": 0, "expon": 0, "uniform": 0, "laplace": 0, "logistic": 0, "cauchy": 0, "gumbel_r": 0, "gumbel_l": 0, "rayleigh": 0, "lognorm": 1,
    "gamma": 1, "chi2": 1, "weibull_min": 1, "weibull_max": 1, "t": 1, "pareto": 1, "invgauss": 1, "genextreme": 1, "f": 2, "beta": 2,
}
LN_2PI = math.log(2 * math.pi)


def lbeta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


class _Np:
    """numpy as the small algebra the densities are written in."""

    log, exp, absolute = staticmethod(np.log), staticmethod(np.exp), staticmethod(np.abs)
    power = staticmethod(np.power)

    @staticmethod
    def where(test, a):
        return np.where(test, a, -np.inf)


class _Col:
    """The same algebra on columns; outside the support NULL."""

    @staticmethod
    def log(c):
        return F.log(c)

    @staticmethod
    def exp(c):
        return F.exp(c)

    @staticmethod
    def absolute(c):
        return F.abs(c)

    @staticmethod
    def power(c, p):
        return F.pow(c, F.lit(p)) if not isinstance(p, Column) else F.pow(c, p)

    @staticmethod
    def where(test, a):
        return F.when(test, a)


def _log_g(m, name: str, s: tuple[float, ...], z):
    """Log of the standard density."""
    if name == "norm":
        return z * z * -0.5 - LN_2PI / 2
    if name == "expon":
        return m.where(z >= 0, z * -1.0)
    if name == "uniform":
        return m.where((z >= 0) & (z <= 1), z * 0.0)
    if name == "laplace":
        return m.absolute(z) * -1.0 - math.log(2)
    if name == "logistic":
        a = m.absolute(z)
        return a * -1.0 - m.log(m.exp(a * -1.0) + 1.0) * 2.0
    if name == "cauchy":
        return m.log(z * z + 1.0) * -1.0 - math.log(math.pi)
    if name == "gumbel_r":
        return z * -1.0 - m.exp(z * -1.0)
    if name == "gumbel_l":
        return z - m.exp(z)
    if name == "rayleigh":
        return m.where(z > 0, m.log(z) - z * z * 0.5)
    if name == "lognorm":
        q = m.log(z)
        return m.where(z > 0, q * q * (-0.5 / s[0] ** 2) - q - (math.log(s[0]) + LN_2PI / 2))
    if name == "gamma":
        return m.where(z > 0, m.log(z) * (s[0] - 1) - z - math.lgamma(s[0]))
    if name == "chi2":
        h = s[0] / 2
        return m.where(z > 0, m.log(z) * (h - 1) - z * 0.5 - (h * math.log(2) + math.lgamma(h)))
    if name == "weibull_min":
        return m.where(z > 0, m.log(z) * (s[0] - 1) - m.power(z, s[0]) + math.log(s[0]))
    if name == "weibull_max":
        return m.where(z < 0, m.log(z * -1.0) * (s[0] - 1) - m.power(z * -1.0, s[0]) + math.log(s[0]))
    if name == "t":
        v = s[0]
        return m.log(z * z / v + 1.0) * (-(v + 1) / 2) + (math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi))
    if name == "pareto":
        return m.where(z >= 1, m.log(z) * (-s[0] - 1) + math.log(s[0]))
    if name == "invgauss":
        mu = s[0]
        return m.where(z > 0, m.log(z) * -1.5 - (z - mu) * (z - mu) / (z * (2 * mu * mu)) - LN_2PI / 2)
    if name == "genextreme":
        c = s[0]
        if abs(c) < 1e-9:
            return z * -1.0 - m.exp(z * -1.0)
        y = z * -c + 1.0
        return m.where(y > 0, m.power(y, 1 / c) * -1.0 + m.log(y) * (1 / c - 1))
    if name == "f":
        a, b = s
        k = a / 2 * math.log(a) + b / 2 * math.log(b) - lbeta(a / 2, b / 2)
        return m.where(z > 0, m.log(z) * (a / 2 - 1) - m.log(z * a + b) * ((a + b) / 2) + k)
    if name == "beta":
        a, b = s
        return m.where((z > 0) & (z < 1), m.log(z) * (a - 1) + m.log(z * -1.0 + 1.0) * (b - 1) - lbeta(a, b))
    raise KeyError(name)


def log_pdf_column(name: str, params: tuple[float, ...], x: Column) -> Column:
    *shapes, loc, scale = params
    return _log_g(_Col, name, tuple(shapes), (x - F.lit(float(loc))) / F.lit(float(scale))) - math.log(scale)


def log_pdf(name: str, params: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    *shapes, loc, scale = params
    with np.errstate(all="ignore"):
        out = _log_g(_Np, name, tuple(shapes), (np.asarray(x, float) - loc) / scale) - math.log(scale)
    return np.where(np.isnan(out), -np.inf, out)


def pdf(name: str, params: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return np.exp(log_pdf(name, params, x))


def legendre(order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(order)


def integral(f: Callable[[np.ndarray], np.ndarray], a: float, b: float, order: int = 48) -> float:
    """Gauss-Legendre integral; swapped bounds give the negative, infinite ones an error."""
    if not (math.isfinite(a) and math.isfinite(b)):
        raise ValueError("bounds must be finite")
    x, w = legendre(order)
    half, mid = (b - a) / 2, (a + b) / 2
    return float(half * (w * f(half * x + mid)).sum())


def integral_column(f: Callable[[Column], Column], a: Column, b: Column, order: int = 24) -> Column:
    """The same per row, as one expression over literal nodes."""
    x, w = legendre(order)
    half, mid = (b - a) / 2, (a + b) / 2
    nodes = F.array(*[F.struct(F.lit(float(xi)).alias("x"), F.lit(float(wi)).alias("w")) for xi, wi in zip(x, w)])
    return half * F.aggregate(nodes, F.lit(0.0), lambda t, n: t + F.coalesce(f(half * n["x"] + mid), F.lit(0.0)) * n["w"])


def support(name: str, params: tuple[float, ...]) -> tuple[float, float]:
    *s, loc, scale = params
    low = {"expon": 0, "uniform": 0, "rayleigh": 0, "lognorm": 0, "gamma": 0, "chi2": 0, "weibull_min": 0, "pareto": 1, "invgauss": 0, "f": 0, "beta": 0}.get(name, -math.inf)
    high = {"uniform": 1, "beta": 1, "weibull_max": 0}.get(name, math.inf)
    if name == "genextreme" and abs(s[0]) >= 1e-9:
        low, high = (-math.inf, 1 / s[0]) if s[0] > 0 else (1 / s[0], math.inf)
    return loc + scale * low, loc + scale * high


class Cdf:
    """Distribution function and quantiles by composite quadrature outward from the support or the centre; exact to about 1e-10 for smooth densities."""

    def __init__(self, name: str, params: tuple[float, ...], panels: int = 400, order: int = 24) -> None:
        self.name, self.params = name, params
        lo, hi = support(name, params)
        scale = params[-1]
        centre = params[-2] if not (math.isfinite(lo) or math.isfinite(hi)) else lo if math.isfinite(lo) else hi
        grid = scale * np.concatenate([[0.0], np.geomspace(1e-6, 1e6, panels)])
        right = centre + grid if not math.isfinite(hi) or centre < hi else np.array([centre])
        left = centre - grid[::-1] if not math.isfinite(lo) else np.array([centre])
        knots = np.unique(np.clip(np.concatenate([left, right]), lo, hi))
        if math.isfinite(lo) and math.isfinite(hi):
            knots = np.linspace(lo, hi, panels)
        x, w = legendre(order)
        half = np.diff(knots) / 2
        at = half[:, None] * x[None, :] + (knots[:-1] + half)[:, None]
        mass = (pdf(name, params, at) * w).sum(axis=1) * half
        total = np.concatenate([[0.0], np.cumsum(mass)])
        self.knots, self.total = knots, total / max(total[-1], 1e-300)

    def __call__(self, v: np.ndarray | float, order: int = 24) -> np.ndarray:
        v = np.atleast_1d(np.asarray(v, float))
        k = np.clip(np.searchsorted(self.knots, v) - 1, 0, len(self.knots) - 2)
        a = self.knots[k]
        x, w = legendre(order)
        half = (np.clip(v, self.knots[0], self.knots[-1]) - a) / 2
        at = half[:, None] * x[None, :] + (a + half)[:, None]
        return np.clip(self.total[k] + (pdf(self.name, self.params, at) * w).sum(axis=1) * half, 0.0, 1.0)

    def quantile(self, q: float) -> float:
        k = int(np.clip(np.searchsorted(self.total, q) - 1, 0, len(self.knots) - 2))
        a, b = self.knots[k], self.knots[k + 1]
        for _ in range(200):
            m = (a + b) / 2
            if m in (a, b):
                break
            a, b = (m, b) if self(m)[0] < q else (a, m)
        return (a + b) / 2


def inflections(name: str, params: tuple[float, ...], grid: int = 2_048) -> dict[str, np.ndarray]:
    """Grid, density, first and second derivative, and the points where the second changes sign (linear root, near repeats dropped)."""
    c = Cdf(name, params)
    x = np.linspace(c.quantile(1e-5), c.quantile(1 - 1e-5), max(256, grid))
    p = np.nan_to_num(pdf(name, params, x), posinf=0.0)
    d1 = np.gradient(p, x, edge_order=2)
    d2 = np.gradient(d1, x, edge_order=2)
    flip = np.flatnonzero(d2[:-1] * d2[1:] < 0)
    roots = x[flip] + np.abs(d2[flip]) / (np.abs(d2[flip]) + np.abs(d2[flip + 1])) * (x[flip + 1] - x[flip])
    kept: list[float] = []
    for v in roots:
        if not kept or v - kept[-1] > 3 * (x[-1] - x[0]) / max(grid, 1):
            kept.append(float(v))
    return {"x": x, "pdf": p, "d1": d1, "d2": d2, "roots": np.array(kept)}


def central_areas(name: str, params: tuple[float, ...], levels: tuple[float, ...] = (0.90, 0.95, 0.99), order: int = 96) -> list[tuple[int, float, float, float, float]]:
    """(percent, lower, upper, area, error) of the central intervals."""
    c, out = Cdf(name, params), []
    for level in levels:
        a, b = c.quantile((1 - level) / 2), c.quantile((1 + level) / 2)
        area = integral(lambda x: pdf(name, params, x), a, b, order)
        out.append((round(level * 100), float(a), float(b), area, abs(area - level)))
    return out
