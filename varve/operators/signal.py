"""Per-series signal operators in NumPy, run by grouped functions: filters, spectra, decompositions, entropies.

A series must fit in one task; longer ones belong in the window operators of varve.operators.series.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.tables import dealt

FILTERS: dict[str, Callable[..., np.ndarray]] = {}


def register_filter(name: str):
    """Adds a smoothing filter (array -> array of equal length) to the registry."""

    def put(f):
        FILTERS[name] = f
        return f

    return put


@register_filter("moving_average")
def moving_average(x: np.ndarray, width: int = 5) -> np.ndarray:
    half = width // 2
    total = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    a, b = np.maximum(at - half, 0), np.minimum(at + half + 1, len(x))
    return (total[b] - total[a]) / (b - a)


@register_filter("gaussian")
def gaussian(x: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    reach = min(int(4 * sigma + 0.5), max(0, len(x) - 1))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="symmetric"), k / k.sum(), mode="valid")


@register_filter("savgol")
def savgol(x: np.ndarray, width: int = 7, order: int = 2) -> np.ndarray:
    """Local polynomial by least squares; the ends use the polynomial of the first and last window."""
    width = min(width, len(x) - (len(x) + 1) % 2)
    if width <= order:
        return x.copy()
    half = width // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    hat = basis @ np.linalg.pinv(basis)
    out = np.convolve(x, hat[half][::-1], mode="same")
    out[:half], out[len(x) - half :] = (hat @ x[:width])[:half], (hat @ x[-width:])[-half:]
    return out


@register_filter("whittaker")
def whittaker(x: np.ndarray, lam: float = 10.0, order: int = 2) -> np.ndarray:
    """Penalised least squares on differences of the given order."""
    if len(x) <= order:
        return x.copy()
    d = np.diff(np.eye(len(x)), order, axis=0)
    return np.linalg.solve(np.eye(len(x)) + lam * d.T @ d, x)


@register_filter("hodrick_prescott")
def hodrick_prescott(x: np.ndarray, lam: float = 1600.0) -> np.ndarray:
    return whittaker(x, lam, 2)


@register_filter("lowess")
def lowess(x: np.ndarray, share: float = 0.3) -> np.ndarray:
    n, at = len(x), np.arange(len(x), dtype=float)
    k = min(n, max(3, math.ceil(share * n)))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(at - i)
        reach = max(np.partition(d, k - 1)[k - 1], 1.0) + 1e-9
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        m = (w * at).sum() / w.sum()
        y = (w * x).sum() / w.sum()
        v = (w * (at - m) ** 2).sum()
        out[i] = y + ((w * (at - m) * (x - y)).sum() / v * (i - m) if v > 1e-12 else 0.0)
    return out


@register_filter("kalman_rts")
def kalman_rts(x: np.ndarray, q: float = 0.05, r: float = 1.0) -> np.ndarray:
    """Local level: forward filter, backward smoother; variances relative to the series' own."""
    n = len(x)
    m, p, pm, pp = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    level, var = (x[0], r) if n else (0.0, r)
    for i in range(n):
        pm[i], pp[i] = level, var + q
        gain = pp[i] / (pp[i] + r)
        level, var = pm[i] + gain * (x[i] - pm[i]), (1 - gain) * pp[i]
        m[i], p[i] = level, var
    for i in range(n - 2, -1, -1):
        m[i] += p[i] / pp[i + 1] * (m[i + 1] - pm[i + 1])
    return m


@register_filter("wiener")
def wiener(x: np.ndarray, width: int = 7) -> np.ndarray:
    mean = moving_average(x, width)
    var = np.maximum(moving_average(x * x, width) - mean**2, 0)
    noise = var.mean()
    return mean + np.maximum(var - noise, 0) / np.maximum(np.maximum(var, noise), 1e-12) * (x - mean)


def _butterworth(cut: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the low-pass filter with unit gain at zero, by the bilinear transform; cut in parts of half the sampling rate."""
    poles = 2 * math.tan(math.pi * cut / 2) * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    a, b = np.poly((2 + poles) / (2 - poles)).real, np.poly(-np.ones(order))
    return b * a.sum() / b.sum(), a


def _recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter over x, begun in the state that a constant series of x's first value leaves."""
    shift = np.eye(len(a) - 1) - np.column_stack([-a[1:], np.eye(len(a) - 1)[:, :-1]])
    state, out = np.linalg.solve(shift, b[1:] - a[1:] * b[0]) * x[0], np.empty(len(x))
    for i, v in enumerate(x):
        out[i] = b[0] * v + state[0]
        state = np.append(state[1:], 0.0) + b[1:] * v - a[1:] * out[i]
    return out


@register_filter("butterworth")
def butterworth(x: np.ndarray, cut: float = 0.2, order: int = 3) -> np.ndarray:
    """Low-pass forwards and backwards, so without delay; the ends are continued by the series turned about its first and last value."""
    reach = min(3 * (order + 1), len(x) - 1)
    b, a = _butterworth(cut, order)
    wide = np.concatenate([2 * x[0] - x[reach:0:-1], x, 2 * x[-1] - x[-2 : -reach - 2 : -1]])
    return _recursive(b, a, _recursive(b, a, wide)[::-1])[::-1][reach : reach + len(x)]


@register_filter("non_local_means")
def non_local_means(x: np.ndarray, half: int = 2, reach: int = 20, strength: float = 1.0) -> np.ndarray:
    """Means of the values within reach, weighted by how alike their patches are beyond what noise explains; noise from the median step."""
    noise = np.median(np.abs(np.diff(x))) / (0.6745 * math.sqrt(2)) if len(x) > 1 else 0.0
    if noise == 0:
        return x.astype(float).copy()
    padded = np.pad(x, half, mode="symmetric") if len(x) >= half else np.pad(x, half, mode="edge")
    patches = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for d in range(-min(reach, len(x) - 1), min(reach, len(x) - 1) + 1):
        here, there = slice(max(0, -d), len(x) - max(0, d)), slice(max(0, d), len(x) - max(0, -d))
        gap = ((patches[here] - patches[there]) ** 2).mean(axis=1)
        w = np.exp(-np.maximum(gap - 2 * noise**2, 0) / (strength * noise) ** 2)
        total[here] += w * x[there]
        weight[here] += w
    return total / weight


@register_filter("haar_shrink")
def haar_shrink(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Soft thresholding of Haar details at the universal threshold."""
    n = len(x)
    size = 1 << max(0, n - 1).bit_length()
    a = np.pad(x, (0, size - n), mode="edge") if n else x
    details = []
    for _ in range(levels):
        if len(a) < 2:
            break
        details.append((a[::2] - a[1::2]) / math.sqrt(2))
        a = (a[::2] + a[1::2]) / math.sqrt(2)
    if details:
        limit = np.median(np.abs(details[0])) / 0.6745 * math.sqrt(2 * math.log(max(2, n)))
        for d in reversed(details):
            d = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
            b = np.empty(2 * len(d))
            b[::2], b[1::2] = (a + d) / math.sqrt(2), (a - d) / math.sqrt(2)
            a = b
    return a[:n]


@register_filter("ssa")
def ssa(x: np.ndarray, window: int = 20, rank: int = 3) -> np.ndarray:
    """Singular spectrum analysis: leading components of the trajectory matrix, averaged over its anti-diagonals."""
    n = len(x)
    window = max(1, min(window, n // 2))
    if n < 4:
        return x.copy()
    t = np.lib.stride_tricks.sliding_window_view(x, window)
    u, s, v = np.linalg.svd(t, full_matrices=False)
    low = (u[:, :rank] * s[:rank]) @ v[:rank]
    out, count = np.zeros(n), np.zeros(n)
    for j in range(window):
        out[j : j + len(low)] += low[:, j]
        count[j : j + len(low)] += 1
    return out / count


def tv_denoise(x: np.ndarray, lam: float = 5.0, rounds: int = 200) -> np.ndarray:
    """Total-variation denoising by projected gradient on the dual."""
    z = np.zeros(max(0, len(x) - 1))
    for _ in range(rounds):
        z = np.clip(z + 0.25 * np.diff(x + np.diff(z, prepend=0, append=0)), -lam, lam)
    return x + np.diff(z, prepend=0, append=0)


FILTERS["total_variation"] = tv_denoise


def bilateral(x: np.ndarray, reach: int = 5, sigma: float = 2.0) -> np.ndarray:
    spread = max(x.std(), 1e-12) if len(x) else 1.0
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for k in range(-reach, reach + 1):
        at = np.clip(np.arange(len(x)) + k, 0, len(x) - 1)
        w = np.exp(-0.5 * (k / sigma) ** 2 - 0.5 * ((x[at] - x) / spread) ** 2)
        total, weight = total + w * x[at], weight + w
    return total / weight


FILTERS["bilateral"] = bilateral


def spectrum(x: np.ndarray) -> dict[str, float]:
    """Dominant frequency, spectral flatness and signal share of the periodogram."""
    p = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2 if len(x) > 1 else np.zeros(0)
    if not p.sum() > 0:
        return {"dominant": 0.0, "flatness": 1.0, "peak_share": 0.0}
    q = p + 1e-12
    return {"dominant": float((p.argmax() + 1) / len(x)), "flatness": float(np.exp(np.log(q).mean()) / q.mean()), "peak_share": float(p.max() / p.sum())}


def stl(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season, remainder: moving-average trend and seasonal means of the detrended phases."""
    trend = moving_average(x, period + 1 - period % 2)
    gap = x - trend
    phase = np.arange(len(x)) % period
    season = np.array([gap[phase == k].mean() if (phase == k).any() else 0.0 for k in range(period)])
    season = (season - season.mean())[phase]
    return trend, season, x - trend - season


def vmd(x: np.ndarray, modes: int = 3, alpha: float = 200.0, rounds: int = 100) -> np.ndarray:
    """Variational mode decomposition: Wiener-filtered modes about centre frequencies, found by alternation."""
    n = len(x)
    mirror = np.concatenate([x[: n // 2][::-1], x, x[n // 2 :][::-1]])
    f = np.fft.rfft(mirror)
    freq = np.fft.rfftfreq(len(mirror))
    centre = 0.5 * (np.arange(modes) + 0.5) / modes
    u = np.zeros((modes, len(f)), complex)
    for _ in range(rounds):
        for k in range(modes):
            u[k] = (f - u.sum(0) + u[k]) / (1 + 2 * alpha * (freq - centre[k]) ** 2 * len(mirror))
            power = np.abs(u[k]) ** 2
            centre[k] = (freq * power).sum() / max(power.sum(), 1e-12)
    return np.array([np.fft.irfft(m, len(mirror))[n // 2 : n // 2 + n] for m in u[np.argsort(centre)]])


def vmd_batch(x: np.ndarray, modes: int = 3, alpha: float = 200.0, rounds: int = 100) -> np.ndarray:
    """vmd of many series of one length, (series, n): (series, modes, n). The same steps, each for all series at once."""
    s, n = x.shape
    mirror = np.concatenate([x[:, : n // 2][:, ::-1], x, x[:, n // 2 :][:, ::-1]], axis=1)
    f = np.fft.rfft(mirror)
    size = mirror.shape[1]
    freq = np.fft.rfftfreq(size)
    centre = np.tile(0.5 * (np.arange(modes) + 0.5) / modes, (s, 1))
    u = np.zeros((modes, *f.shape), complex)
    total = np.zeros(f.shape, complex)
    for _ in range(rounds):
        for k in range(modes):
            rest = f - total + u[k]
            total -= u[k]
            u[k] = rest / (1 + 2 * alpha * (freq - centre[:, k : k + 1]) ** 2 * size)
            total += u[k]
            power = u[k].real ** 2 + u[k].imag ** 2
            centre[:, k] = (power @ freq) / np.maximum(power.sum(1), 1e-12)
    order = np.argsort(centre, axis=1)
    return np.take_along_axis(np.fft.irfft(u, size)[:, :, n // 2 : n // 2 + n].transpose(1, 0, 2), order[:, :, None], axis=1)


def emd(x: np.ndarray, modes: int = 4, rounds: int = 10) -> np.ndarray:
    """Empirical modes by sifting between linear envelopes; the last row is the remainder."""
    out, rest = [], x.astype(float).copy()
    at = np.arange(len(x))
    for _ in range(modes):
        h = rest.copy()
        for _ in range(rounds):
            top = np.flatnonzero((h[1:-1] >= h[:-2]) & (h[1:-1] > h[2:])) + 1
            low = np.flatnonzero((h[1:-1] <= h[:-2]) & (h[1:-1] < h[2:])) + 1
            if len(top) < 2 or len(low) < 2:
                break
            h = h - (np.interp(at, top, h[top]) + np.interp(at, low, h[low])) / 2
        if np.allclose(h, rest):
            break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])


def permutation_entropy(x: np.ndarray, order: int = 3) -> float:
    if len(x) < order:
        return 0.0
    pattern = np.argsort(np.lib.stride_tricks.sliding_window_view(x, order), axis=1, kind="stable") @ (order ** np.arange(order))
    p = np.unique(pattern, return_counts=True)[1] / len(pattern)
    return float(-(p * np.log2(p)).sum() / math.log2(math.factorial(order)))


def _dimension(d: float) -> float:
    return min(2.0, max(1.0, d)) if math.isfinite(d) else 1.0


def katz(x: np.ndarray) -> float:
    """Curve length against reach, both in the plane of position and value; within 1 and 2, and 1 below ten values."""
    n = len(x) - 1
    if n < 9:
        return 1.0
    length = np.hypot(1.0, np.diff(x)).sum()
    reach = np.hypot(np.arange(n + 1), x - x[0]).max()
    return _dimension(math.log10(n) / (math.log10(n) + math.log10(reach / length)))


def petrosian(x: np.ndarray) -> float:
    """By the turns of the series, flat steps not counted; within 1 and 2, and 1 below ten values."""
    n, step = len(x), np.diff(x)
    turns = int((step[:-1] * step[1:] < 0).sum())
    return _dimension(math.log10(n) / (math.log10(n) + math.log10(n / (n + 0.4 * turns)))) if n >= 10 and turns else 1.0


def higuchi(x: np.ndarray, reach: int = 10) -> float:
    """Slope of log length on log step, steps up to reach and a quarter of the series; within 1 and 2, and 1 below twenty values."""
    n = len(x)
    steps = range(1, min(reach, n // 4) + 1)
    if n < 20 or len(steps) < 3:
        return 1.0
    lengths = [np.mean([np.abs(np.diff(x[m::k])).sum() * (n - 1) / ((len(x[m::k]) - 1) * k * k) for m in range(k)]) for k in steps]
    return _dimension(-float(np.polyfit(np.log(list(steps)), np.log(np.array(lengths) + 1e-12), 1)[0]))


def bayesian_blocks(t: np.ndarray, p0: float = 0.05) -> np.ndarray:
    """Edges of the optimal piecewise-constant event rate (quadratic in the number of distinct times)."""
    t, counts = np.unique(t, return_counts=True)
    n = len(t)
    if n < 2:
        return np.concatenate([t, t])
    edges = np.concatenate([t[:1], (t[1:] + t[:-1]) / 2, t[-1:]])
    prior = 4 - math.log(73.53 * p0 * n**-0.478)
    best, last = np.zeros(n), np.zeros(n, int)
    for r in range(n):
        width = edges[r + 1] - edges[: r + 1]
        total = np.cumsum(counts[: r + 1][::-1])[::-1]
        fit = total * (np.log(total) - np.log(np.maximum(width, 1e-300))) - prior
        fit[1:] += best[:r]
        last[r] = fit.argmax()
        best[r] = fit[last[r]]
    cuts, at = [n], n
    while at:
        at = last[at - 1]
        cuts.append(at)
    return edges[cuts[::-1]]


def ksg_mi(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Kraskov mutual information with the maximum norm, not below 0, in nats; quadratic in the rows."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    psi = lambda m: harmonic[m - 1] - 0.5772156649015329
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    nx, ny = (dx < eps).sum(1) - 1, (dy < eps).sum(1) - 1
    return max(0.0, float(psi(k) + psi(n) - np.mean(psi(nx + 1) + psi(ny + 1))))


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    def centred(v):
        d = np.abs(v[:, None] - v)
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    scale = math.sqrt((a * a).mean() * (b * b).mean())
    return math.sqrt(max(0.0, (a * b).mean()) / scale) if scale > 0 else 0.0


def hsic(x: np.ndarray, y: np.ndarray) -> float:
    """Biased HSIC with Gaussian kernels of median width."""

    def kernel(v):
        d = (v[:, None] - v) ** 2
        width = np.median(d[d > 0]) if (d > 0).any() else 1.0
        k = np.exp(-d / width)
        return k - k.mean(0) - k.mean(1)[:, None] + k.mean()

    return float((kernel(x) * kernel(y)).mean()) if len(x) else 0.0


def kpss(x: np.ndarray) -> float:
    e = x - x.mean()
    n, lags = len(e), int(4 * (len(e) / 100) ** 0.25)
    long_run = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    return float((np.cumsum(e) ** 2).sum() / (n * n * long_run)) if long_run > 0 else 0.0


def adf(x: np.ndarray, lags: int = 1) -> float:
    """Dickey-Fuller t statistic with a constant and lagged differences."""
    d = np.diff(x)
    y = d[lags:]
    z = np.column_stack([np.ones(len(y)), x[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
    if len(y) <= z.shape[1]:
        return 0.0
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    s2 = ((y - z @ b) ** 2).sum() / (len(y) - z.shape[1])
    var = s2 * np.linalg.pinv(z.T @ z)[1, 1]
    return float(b[1] / math.sqrt(var)) if var > 0 else 0.0


def _lags(near: np.ndarray, far: np.ndarray, s: int, sign: float) -> np.ndarray:
    """Coefficients of lags 1, 2, ... of (1 + sign near B ...)(1 + sign far B^s ...), signed as near and far are."""
    seasonal = np.zeros(len(far) * s + 1)
    seasonal[0] = 1
    seasonal[s::s] = sign * far
    return sign * np.convolve(np.r_[1, sign * near], seasonal)[1:]


def _outside(lags: np.ndarray, sign: float) -> bool:
    """Whether all roots of 1 + sign lags B ... are outside the unit circle."""
    return not lags.any() or bool(np.abs(np.roots(np.r_[1, sign * lags])).max() < 0.999)


class _Arma:
    """c, AR, MA, seasonal AR and seasonal MA coefficients in one vector, fitted by Hannan-Rissanen, then by conditional sums of squares."""

    def __init__(self, w: np.ndarray, p: int, q: int, P: int = 0, Q: int = 0, s: int = 1):
        self.w, self.cuts, self.s = w, np.cumsum([1, p, q, P]), s
        self.skip, self.size = p + s * P, 1 + p + q + P + Q
        self.ar = [*range(1, p + 1), *range(s, s * P + 1, s)]
        self.ma = [*range(1, q + 1), *range(s, s * Q + 1, s)]
        self.order = (p, q, P, Q)

    def polynomials(self, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        c, ar, ma, far, fma = np.split(b, self.cuts)
        return float(c[0]), _lags(ar, far, self.s, -1), _lags(ma, fma, self.s, 1)

    def residuals(self, b: np.ndarray) -> np.ndarray:
        c, ar, ma = self.polynomials(b)
        u = self.w[self.skip :] - c
        for k in np.flatnonzero(ar):
            u = u - ar[k] * self.w[self.skip - k - 1 : len(self.w) - k - 1]
        if not ma.any():
            return u
        lagged, e = [(int(k) + 1, float(ma[k])) for k in np.flatnonzero(ma)], []
        for t, v in enumerate(u.tolist()):
            for k, m in lagged:
                if k <= t:
                    v -= m * e[t - k]
            e.append(v)
        return np.array(e)

    def start(self, noise: np.ndarray, first: int) -> tuple[np.ndarray, float]:
        """Hannan-Rissanen: coefficients on lagged values and lagged residuals of a long autoregression, and the AICc over the rows from first."""
        n = len(self.w)
        z = np.column_stack([np.ones(n - first), *(self.w[first - k : n - k] for k in self.ar), *(noise[first - k : n - k] for k in self.ma)])
        b, *_ = np.linalg.lstsq(z, self.w[first:], rcond=None)
        sse, m, k = float(((self.w[first:] - z @ b) ** 2).sum()), n - first, self.size + 1
        p, q, P, _ = self.order
        b = np.r_[b[: 1 + p], b[1 + p + P : 1 + p + P + q], b[1 + p : 1 + p + P], b[1 + p + P + q :]]
        return b, m * math.log(max(sse / m, 1e-300)) + 2 * k + 2 * k * (k + 1) / (m - k - 1) if m > k + 1 else math.inf

    def fit(self, b: np.ndarray, rounds: int = 30) -> np.ndarray:
        """Gauss-Newton on the conditional sum of squares, within the stationary and invertible coefficients."""
        p, q, P, Q = self.order
        if not q + P + Q:
            z = np.column_stack([np.ones(len(self.w) - p), *(self.w[p - k : len(self.w) - k] for k in self.ar)])
            return np.linalg.lstsq(z, self.w[p:], rcond=None)[0]

        def allowed(b: np.ndarray) -> bool:
            _, ar, ma = self.polynomials(b)
            return _outside(ar, -1) and _outside(ma, 1)

        for _ in range(60):
            if allowed(b):
                break
            b = np.r_[b[0], 0.8 * b[1:]]
        e = self.residuals(b)
        for _ in range(rounds):
            h = 1e-5 * np.maximum(1, np.abs(b))
            j = np.column_stack([(self.residuals(b + d) - e) / h[i] for i, d in enumerate(np.diag(h))])
            step = np.linalg.lstsq(j, -e, rcond=None)[0]
            for half in 0.5 ** np.arange(12):
                if allowed(b + half * step) and (f := self.residuals(b + half * step)) @ f < e @ e:
                    break
            else:
                break
            done = e @ e - f @ f <= 1e-9 * (e @ e)
            b, e = b + half * step, f
            if done:
                break
        return b

    def forecast(self, b: np.ndarray, horizon: int) -> np.ndarray:
        c, ar, ma = self.polynomials(b)
        w, e = list(self.w), [0.0] * self.skip + list(self.residuals(b))
        for _ in range(horizon):
            w.append(c + sum(a * w[-k - 1] for k, a in enumerate(ar)) + sum(m * e[-k - 1] for k, m in enumerate(ma) if k < len(e)))
            e.append(0.0)
        return np.array(w[len(self.w) :])


def _long_residuals(w: np.ndarray, lags: int) -> np.ndarray:
    z = np.column_stack([np.ones(len(w) - lags), *(w[lags - k : len(w) - k] for k in range(1, lags + 1))])
    b, *_ = np.linalg.lstsq(z, w[lags:], rcond=None)
    return np.r_[np.zeros(lags), w[lags:] - z @ b]


def _differenced(x: np.ndarray, d: int, D: int, s: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Seasonal, then plain differences, and what puts forecasts back: the lag and the last values before each."""
    kept, w = [], x.astype(float)
    for lag in [s] * D + [1] * d:
        kept.append((lag, w[-lag:]))
        w = w[lag:] - w[:-lag]
    return w, kept


def _integrated(out: np.ndarray, kept: list[tuple[int, np.ndarray]]) -> np.ndarray:
    for lag, last in reversed(kept):
        level = list(last)
        for v in out:
            level.append(v + level[-lag])
        out = np.array(level[lag:])
    return out


def arima_css(x: np.ndarray, p: int = 2, d: int = 1, horizon: int = 5, q: int = 0, seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)) -> np.ndarray:
    """Forecasts of a seasonal ARIMA (p, d, q)(P, D, Q, s) with a constant, by Hannan-Rissanen and conditional sums of squares; the last value where the series is too short."""
    P, D, Q, s = seasonal
    if len(x) <= d + D * s:
        return np.full(horizon, float(x[-1]))
    w, kept = _differenced(x, d, D, s)
    m = _Arma(w, p, q, P, Q, s)
    long = max(p + q, min(len(w) // 4, 10)) if m.ma else 0
    first = max(m.skip, long + max(m.ma, default=0))
    if len(w) - first <= m.size or len(w) <= 2 * p + 1:
        return np.full(horizon, float(x[-1]))
    b, _ = m.start(_long_residuals(w, long) if m.ma else w, first)
    return _integrated(m.forecast(m.fit(b), horizon), kept)


def auto_arima(x: np.ndarray, horizon: int = 5, s: int = 1, most: int = 3) -> tuple[np.ndarray, tuple[int, ...]]:
    """Forecasts and (p, d, q, P, Q): d up to 2 while KPSS exceeds 0.463, the other orders stepwise by AICc of the Hannan-Rissanen regressions."""
    d = 0
    while d < 2 and len(x) > d + 12 and kpss(np.diff(x, d)) > 0.463:
        d += 1
    if len(x) <= d + 12:
        return arima_css(x, 0, min(d, max(0, len(x) - 1)), horizon), (0, d, 0, 0, 0)
    w, _ = _differenced(x, d, 0, 1)
    long = min(len(w) // 4, 10)
    season = s if s > 1 and len(w) >= 4 * s + long else 0
    top = (most, most, int(season > 0), int(season > 0))
    first = max(most, long + max(most, season))
    noise, seen = _long_residuals(w, long), {}

    def cost(o: tuple[int, ...]) -> float:
        if o not in seen:
            seen[o] = _Arma(w, *o, max(s, 1)).start(noise, first)[1] if len(w) > first + 1 else math.inf
        return seen[o]

    best = min([(2, 2, 0, 0), (0, 0, 0, 0), (1, 0, top[2], 0), (0, 1, 0, top[3])], key=cost)
    while True:
        near = [tuple(v + (step if i in at else 0) for i, v in enumerate(best)) for at in ((0,), (1,), (2,), (3,), (0, 1), (2, 3)) for step in (-1, 1)]
        found = min([best, *(o for o in near if all(0 <= v <= t for v, t in zip(o, top, strict=True)))], key=cost)
        if cost(found) >= cost(best):
            break
        best = found
    p, q, P, Q = best if math.isfinite(cost(best)) else (0, 0, 0, 0)
    return arima_css(x, p, d, horizon, q, (P, 0, Q, max(s, 1))), (p, d, q, P, Q)


def _isolation_depths(x: np.ndarray, trees: int, size: int, depth: int, expected: Callable[[int], float], rng: np.random.Generator) -> np.ndarray:
    """Summed path lengths of one column: a node is a range of the sorted values, so a tree is bisections instead of a mask a node."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    every = x[order].tolist()
    total = np.zeros(n)
    leaf = [expected(m) for m in range(size + 1)]
    for _ in range(trees):
        part = np.sort(x[rng.choice(n, size, replace=False)]).tolist()
        ends: list[int] = []
        paths: list[float] = []
        todo = [(0, n, 0, size, 0)]  # rows, the sample's rows and the depth of a node; left before right
        while todo:
            a, b, i, j, at = todo.pop()
            if at >= depth or j - i < 2 or part[i] == part[j - 1]:
                ends.append(b - a)
                paths.append(at + leaf[j - i])
                continue
            low, high = part[i], part[j - 1]
            cut = low + (high - low) * rng.random()
            row, mid = bisect_left(every, cut, a, b), bisect_left(part, cut, i, j)
            todo.append((row, b, mid, j, at + 1))
            todo.append((a, row, i, mid, at + 1))
        total += np.repeat(paths, ends)
    out = np.empty(n)
    out[order] = total
    return out


def isolation_scores(x: np.ndarray, trees: int = 50, sample: int = 128, seed: int = 0) -> np.ndarray:
    """Isolation-forest scores of the rows of x (n, d)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    size = min(sample, n)
    depth = max(1, math.ceil(math.log2(max(2, size))))
    expected = lambda m: 0.0 if m < 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    if x.shape[1] == 1 and np.isfinite(x).all():
        return 2 ** (-_isolation_depths(x[:, 0], trees, size, depth, expected, rng) / trees / max(expected(size), 1e-9))
    total = np.zeros(n)

    def walk(rows: np.ndarray, part: np.ndarray, at: int) -> None:
        spread = part.max(0) - part.min(0) if len(part) else np.zeros(x.shape[1])
        if at >= depth or len(part) < 2 or not spread.any():
            total[rows] += at + expected(len(part))
            return
        f = rng.choice(np.flatnonzero(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        left = x[rows, f] < cut
        walk(rows[left], part[part[:, f] < cut], at + 1)
        walk(rows[~left], part[part[:, f] >= cut], at + 1)

    for _ in range(trees):
        walk(np.arange(n), x[rng.choice(n, size, replace=False)], 0)
    return 2 ** (-total / trees / max(expected(size), 1e-9))


AUGMENTATIONS: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {
    "jitter": lambda x, r: x + r.normal(0, 0.03 * max(x.std(), 1e-9), len(x)),
    "scaling": lambda x, r: x * r.normal(1, 0.1),
    "magnitude_warp": lambda x, r: x * np.interp(np.arange(len(x)), np.linspace(0, max(1, len(x) - 1), 5), r.normal(1, 0.2, 5)),
    "time_warp": lambda x, r: np.interp(np.arange(len(x)), np.sort(np.arange(len(x)) + r.normal(0, 0.5, len(x))), x),
    "mask": lambda x, r: np.where(r.random(len(x)) < 0.1, 0.0, x),
    "drift": lambda x, r: x + np.cumsum(r.normal(0, 0.02 * max(x.std(), 1e-9), len(x))),
    "permutation": lambda x, r: np.concatenate([p for _, p in sorted(zip(r.permutation(4), np.array_split(x, 4), strict=True), key=lambda v: v[0])]),
    "slice": lambda x, r: np.interp(np.linspace(0, 1, len(x)), np.linspace(0, 1, max(2, int(0.9 * len(x)))), x[: max(2, int(0.9 * len(x)))]) if len(x) > 2 else x,
    "reverse_sign": lambda x, r: -x,
    "frequency_warp": lambda x, r: np.fft.irfft(np.fft.rfft(x) * (1 + r.normal(0, 0.05)), len(x)),
}


def map_series(df: DataFrame, key: str, order: str, value: str, f: Callable[[np.ndarray], np.ndarray], out: str = "out") -> DataFrame:
    """key, order and out: f over each series in order; f returns an array of equal length."""
    schema = f"{key} {dict(df.dtypes)[key]}, {order} {dict(df.dtypes)[order]}, {out} double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        return pd.DataFrame({key: frame[key], order: frame[order], out: np.asarray(f(frame[value].to_numpy(float)), float)})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, schema)


def summarise_series(df: DataFrame, key: str, order: str, value: str, f: Callable[[np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """key and one double per name, from f over each series in order."""
    schema = f"{key} {dict(df.dtypes)[key]}, " + ", ".join(f"{n} double" for n in names)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = f(frame.sort_values(order, kind="stable")[value].to_numpy(float))
        return pd.DataFrame({key: [frame[key].iloc[0]], **{n: [float(got[n])] for n in names}})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, schema)


def decompose_series(df: DataFrame, key: str, order: str, value: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, mode, order, part: rows of f's (modes, n) result."""
    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, mode int, {order} {types[order]}, part double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        parts = f(frame[value].to_numpy(float))
        return pd.concat([pd.DataFrame({key: frame[key], "mode": k, order: frame[order], "part": p}) for k, p in enumerate(parts)])

    return df.select(key, order, value).groupBy(key).applyInPandas(run, schema)


#: Values of one batch of series at most, so that a batch's spectra stay in a processor's cache.
BATCH = 1 << 13


def decompose_batches(df: DataFrame, key: str, order: str, value: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """As decompose_series, for an f that takes series of one length together, (series, n), to (series, modes, n): a task's series that have equal lengths are
    decomposed in batches of about BATCH values, held until their batch is full or the task ends."""
    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, mode int, {order} {types[order]}, part double"

    def made(series: list[pd.DataFrame]) -> pd.DataFrame:
        parts = f(np.array([s[value].to_numpy(float) for s in series]))
        whole, (_, modes, n) = pd.concat(series, ignore_index=True), parts.shape
        at = (np.arange(len(series))[:, None, None] * n + np.tile(np.arange(n), (modes, 1))).ravel()
        return pd.DataFrame({key: whole[key].to_numpy()[at], "mode": np.tile(np.repeat(np.arange(modes), n), len(series)), order: whole[order].to_numpy()[at], "part": parts.ravel()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[pd.DataFrame]] = {}
        last = None
        for frame in frames:
            frame = frame if last is None else pd.concat([last, frame], ignore_index=True)
            code = pd.factorize(frame[key], use_na_sentinel=False)[0]
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1), len(frame)]
            last = frame.iloc[edges[-2] :]  # may go on in the next frame
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                yield from add(waiting, frame.iloc[a:b])
        if last is not None and len(last):
            yield from add(waiting, last)
        for series in waiting.values():
            if series:
                yield made(series)

    def add(waiting: dict[int, list[pd.DataFrame]], series: pd.DataFrame) -> Iterator[pd.DataFrame]:
        held = waiting.setdefault(len(series), [])
        held.append(series)
        if len(held) * len(series) >= BATCH:
            yield made(held)
            held.clear()

    return dealt(df.select(key, order, value), key).sortWithinPartitions(key, order).mapInPandas(run, schema)
