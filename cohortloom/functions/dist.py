"""Distribution functions on the driver: p-values of statistics that were aggregated by Spark.  Pure Python."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return min(1.0, 2 * normal_sf(abs(z)))


def normal_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_sf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    lo, hi = 0.0, max(10.0, df * 20.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi2_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or 1e-300)
        c = (1 + n / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k means / s > q) by numerical integration."""
    import numpy as np

    if q <= 0:
        return 1.0
    x, wx = np.polynomial.legendre.leggauss(96)
    z, wz = 8 * x, 8 * wx
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 1 - normal_sf(v))

    def inner(w: float) -> float:
        return float(k * np.sum(wz * phi * (cdf(z) - cdf(z - w)) ** (k - 1)))

    if df > 20_000:
        return max(0.0, 1 - inner(q))
    spread = 8 / math.sqrt(2 * df)
    lo, hi = max(1e-6, 1 - spread), 1 + spread
    s, ws = (hi - lo) / 2 * x + (hi + lo) / 2, (hi - lo) / 2 * wx
    log = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2)
    density = np.exp(log + (df - 1) * np.log(s) - df * s * s / 2)
    return min(1.0, max(0.0, 1 - float(np.sum(ws * density * np.array([inner(q * v) for v in s])))))


def fisher_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test: tables no likelier than the one seen."""
    r, s, n = a + b, a + c, a + b + c + d
    logs = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(s - x + 1) - math.lgamma(n - r - s + x + 1)
    top = math.lgamma(n + 1) - math.lgamma(s + 1) - math.lgamma(n - s + 1)
    seen = logs(a)
    return min(1.0, sum(math.exp(v - top) for x in range(max(0, r + s - n), min(r, s) + 1) if (v := logs(x)) <= seen + 1e-7))


def adjusted(p: list[float | None], method: str = "holm") -> list[float | None]:
    """BH, Holm or Bonferroni; missing p-values stay missing."""
    found = sorted((v, i) for i, v in enumerate(p) if v is not None and v == v)
    m, out = len(found), list(p)
    if method == "bonferroni":
        for v, i in found:
            out[i] = min(1.0, v * m)
    elif method == "holm":
        run = 0.0
        for k, (v, i) in enumerate(found):
            run = max(run, min(1.0, v * (m - k)))
            out[i] = run
    elif method == "bh":
        run = 1.0
        for k, (v, i) in reversed(list(enumerate(found))):
            run = min(run, v * m / (k + 1))
            out[i] = run
    else:
        raise ValueError(f"no method {method!r}")
    return out


def shapiro_wilk(x: list[float]) -> tuple[float, float]:
    """W and p by Royston's approximation (AS R94), for 3 to 5000 sorted values."""
    n = len(x)
    m = [normal_ppf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    ss = sum(v * v for v in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
        an = poly([m[-1] / math.sqrt(ss), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
        if n > 5:
            an1 = poly([m[-2] / math.sqrt(ss), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a = [-an, -an1, *[v / math.sqrt(phi) for v in m[2:-2]], an1, an]
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a = [-an, *[v / math.sqrt(phi) for v in m[1:-1]], an]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mu, sigma = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 6.714e-4 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        v = math.log(n)
        mu, sigma = -1.5861 - 0.31082 * v - 0.083751 * v**2 + 0.0038915 * v**3, math.exp(-0.4803 - 0.082676 * v + 0.0030302 * v**2)
    return w, normal_sf((y - mu) / sigma)
