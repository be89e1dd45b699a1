"""Response curves on NumPy arrays: fits, inverses and smoothers for binned or grouped data."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Curve(NamedTuple):
    """A five-parameter logistic response."""

    p_min: float
    p_max: float
    k: float
    hill: float
    asymmetry: float

    def at(self, x) -> np.ndarray:
        """The response at exposures ``x``; all is done on logarithms, so no power overflows."""
        distance = self.hill * (np.log(self.k) - np.log(np.clip(np.asarray(x, float), 1e-300, None)))
        return self.p_min + (self.p_max - self.p_min) * np.exp(-self.asymmetry * np.logaddexp(0.0, distance))

    def exposure_at(self, p: float) -> float:
        """Exposure at which the response is ``p``; an error outside the asymptotes."""
        if not self.p_min < p < self.p_max:
            raise ValueError(f"{p} is not between {self.p_min} and {self.p_max}")
        ratio = ((self.p_max - self.p_min) / (p - self.p_min)) ** (1 / self.asymmetry) - 1
        return float(self.k / ratio ** (1 / self.hill))

    def midpoint(self, low: float, high: float) -> float:
        """Exposure half-way between the asymptotes; an error outside the bracket."""
        x = self.exposure_at((self.p_min + self.p_max) / 2)
        if not low <= x <= high:
            raise ValueError("midpoint outside the bracket")
        return x

    def scaled_to(self, p: float, exposure: float) -> Curve:
        """The curve with ``k`` scaled so that it reaches ``p`` at ``exposure``."""
        return self._replace(k=self.k * exposure / self.exposure_at(p))


def start_and_bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = x < np.quantile(x, 0.1), x > np.quantile(x, 0.9)
    base, top = (y[low].mean() if low.any() else np.nan), (y[high].mean() if high.any() else np.nan)
    start = np.array([np.clip(np.nan_to_num(base, nan=1e-3), 1e-3, 0.4), np.clip(np.nan_to_num(top, nan=0.99), 0.1, 0.99), np.median(x), 1.0, 1.0])
    return start, np.array([0, 0, 1e-12, 0.1, 0.1]), np.array([0.5, 1.0, x.max() * 5, 20.0, 10.0])


def fit_curve(x, y, weights=None, steps: int = 300) -> Curve:
    """Bounded least squares by damped Gauss-Newton steps; ``k`` is searched on a log scale."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    keep = np.isfinite(x) & np.isfinite(y) & (x > 0)
    x, y = x[keep], y[keep]
    if len(x) < 5:
        raise ValueError("too few points")
    w = np.ones(len(x)) if weights is None else np.sqrt(np.maximum(np.asarray(weights, float)[keep], 1e-9))
    start, low, high = start_and_bounds(x, y)
    to = lambda p: np.r_[p[:2], np.exp(p[2]), p[3:]]
    low, high = np.r_[low[:2], np.log(low[2]), low[3:]], np.r_[high[:2], np.log(high[2]), high[3:]]
    best, logx = None, np.log(x)

    def residual_and_slope(p):
        a, b, lk, h, s = p
        e = np.exp(np.clip(h * (lk - logx), -700, 700))
        g = (1 + e) ** -s
        slope = s * g * e / (1 + e)
        j = np.stack([1 - g, g, -(b - a) * slope * h, -(b - a) * slope * (lk - logx), -(b - a) * g * np.log1p(e)], axis=1)
        return w * (a + (b - a) * g - y), j * w[:, None]

    starts = [start] + [np.r_[start[:2], np.quantile(x, q), h, 1.0] for q, h in ((0.25, 2.0), (0.75, 2.0), (0.5, 4.0))]
    for s0 in starts:
        p = np.clip(np.r_[s0[:2], np.log(s0[2]), s0[3:]], low, high)
        r, j = residual_and_slope(p)
        cost, damp = r @ r, 1e-3
        for _ in range(steps):
            g, h = j.T @ r, j.T @ j
            free = ~(((p <= low) & (g > 0)) | ((p >= high) & (g < 0)))
            if not free.any() or np.abs(g[free]).max() < 1e-10:
                break
            hf = h[np.ix_(free, free)]
            step = np.zeros(5)
            step[free] = -np.linalg.solve(hf + damp * np.diag(np.diag(hf) + 1e-12), g[free])
            q = np.clip(p + step, low, high)
            rq, jq = residual_and_slope(q)
            if rq @ rq < cost:
                done = cost - rq @ rq < 1e-14 * (1 + cost)
                p, r, j, cost, damp = q, rq, jq, rq @ rq, max(damp / 4, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if best is None or cost < best[0] - 1e-12:
            best = (cost, to(p))
    return Curve(*map(float, best[1]))


def peak_difference(upper: Curve, lower: Curve, low: float = 1e-6, high: float = 2.0, n: int = 20_000) -> tuple[float, float]:
    """Largest gap between two curves on a geometric grid, and where it is."""
    grid = np.geomspace(low, high, n)
    gap = upper.at(grid) - lower.at(grid)
    at = int(np.nanargmax(gap))
    return float(gap[at]), float(grid[at])


def scores(curve: Curve, x, y) -> tuple[float, float]:
    """Brier score and mean log loss."""
    p, y = np.clip(curve.at(x), 1e-12, 1 - 1e-12), np.asarray(y, float)
    return float(((p - y) ** 2).mean()), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def lowess(x, y, fraction: float = 0.42, robust: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Locally weighted lines with tricube weights and bisquare robustness steps, sorted by x."""
    order = np.argsort(np.asarray(x, float), kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    if not n:
        return x, y
    k, trust, fit = max(2, min(n, int(fraction * n + 1e-10))), np.ones(n), y.copy()
    for turn in range(robust + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.partition(d, k - 1)[k - 1]
            w = trust * np.where(d <= 0.999 * h, (1 - np.minimum(1, d / h) ** 3) ** 3, 0) if h > 0 else trust * (d == 0)
            w = np.where(d <= 0.001 * h, trust, w)
            if w.sum() <= 0:
                continue
            w = w / w.sum()
            mean = (w * x).sum()
            spread = (w * (x - mean) ** 2).sum()
            slope = (w * (x - mean) * y).sum() / spread if np.sqrt(spread) > 0.001 * (x[-1] - x[0]) else 0.0
            fit[i] = (w * y).sum() + slope * (x[i] - mean)
        if turn < robust:
            r = np.abs(y - fit)
            s = 6 * np.median(r)
            if s <= 0:
                break
            trust = np.where(r <= 0.001 * s, 1.0, np.where(r < 0.999 * s, (1 - np.minimum(1, r / s) ** 2) ** 2, 0.0))
    return x, fit


def pchip(x, y, at) -> np.ndarray:
    """Monotone piecewise cubic through points with increasing x; NaN outside."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = np.sign(d[:-1]) * np.sign(d[1:]) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
        for end, h0, h1, d0, d1 in ((0, h[0], h[1], d[0], d[1]), (-1, h[-1], h[-2], d[-1], d[-2])):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[end] = 0 if np.sign(v) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = (at - x[i]) / h[i]
    out = y[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * m[i] * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + h[i] * m[i + 1] * t * t * (t - 1)
    return np.where((at >= x[0]) & (at <= x[-1]), out, np.nan)


def inverse_of_bins(x, y, at) -> np.ndarray:
    """x at given levels of a binned curve, on its strictly falling part after the maximum."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    top = int(np.nanargmax(y))
    x, y = x[top:], y[top:]
    falls = np.r_[True, np.diff(np.minimum.accumulate(y)) < 0]
    x, y = x[falls], y[falls]
    if len(x) < 2:
        return np.full(np.shape(at), np.nan)
    return pchip(y[::-1], x[::-1], at)
