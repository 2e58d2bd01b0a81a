"""Two-body kernels: propagation, ephemerides, preliminary orbits and differential correction.

Grouped fits run as Arrow-backed functions of one linkage; everything around them stays relational.
Positions are heliocentric ecliptic in au and au a day. The force model is the Sun alone, and the Earth
moves on a fixed ellipse, so predictions are good to arc seconds over weeks, not to milliarcseconds.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.functions import sphere

#: Gaussian gravitational constant squared (au^3 / day^2), and the speed of light in au a day.
MU = 0.01720209895**2
LIGHT = 173.14463267424034


def _stumpff(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions C and S of the universal Kepler equation, by series near zero."""
    c, s = np.empty_like(z), np.empty_like(z)
    near, pos = np.abs(z) < 1e-3, z >= 1e-3
    neg = z <= -1e-3
    w = z[near]
    c[near], s[near] = 1 / 2 - w / 24 + w * w / 720, 1 / 6 - w / 120 + w * w / 5040
    q = np.sqrt(z[pos])
    c[pos], s[pos] = (1 - np.cos(q)) / z[pos], (q - np.sin(q)) / q**3
    q = np.sqrt(-z[neg])
    c[neg], s[neg] = (np.cosh(q) - 1) / -z[neg], (np.sinh(q) - q) / q**3
    return c, s


def _universal(state: np.ndarray, dt: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(universal anomaly, alpha, r0, r.v, last step) of Kepler's equation in universal variables."""
    r, v = state[:, :3], state[:, 3:]
    r0, v2, rv = np.linalg.norm(r, axis=1), (v * v).sum(1), (r * v).sum(1)
    alpha, root = 2 / r0 - v2 / mu, math.sqrt(mu)
    chi = root * np.abs(alpha) * dt
    step = np.zeros_like(chi)
    with np.errstate(all="ignore"):
        for _ in range(60):
            z = alpha * chi * chi
            c, s = _stumpff(z)
            f = rv / root * chi**2 * c + (1 - alpha * r0) * chi**3 * s + r0 * chi - root * dt
            slope = rv / root * chi * (1 - z * s) + (1 - alpha * r0) * chi**2 * c + r0
            step = f / slope
            chi = chi - np.clip(step, -2 - np.abs(chi), 2 + np.abs(chi))
            if np.nanmax(np.abs(step), initial=0.0) < 1e-13:
                break
    return chi, alpha, r0, rv, step


def _moved(state: np.ndarray, dt: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(states moved along their conics, universal anomaly, Lagrange coefficients f, g and their rates)."""
    r, v, root = state[:, :3], state[:, 3:], math.sqrt(mu)
    chi, alpha, r0, _, step = _universal(state, dt, mu)
    with np.errstate(all="ignore"):
        z = alpha * chi * chi
        c, s = _stumpff(z)
        fl, g = 1 - chi**2 / r0 * c, dt - chi**3 / root * s
        out_r = fl[:, None] * r + g[:, None] * v
        r1 = np.linalg.norm(out_r, axis=1)
        fd, gd = root / (r1 * r0) * chi * (z * s - 1), 1 - chi**2 / r1 * c
        out = np.hstack([out_r, fd[:, None] * r + gd[:, None] * v])
    out[np.abs(step) > 1e-8] = np.nan
    return out, chi, (fl, g, fd, gd)


def _states(state: np.ndarray, dt) -> tuple[np.ndarray, np.ndarray]:
    state = np.atleast_2d(np.asarray(state, float))
    return state, np.broadcast_to(np.asarray(dt, float), (len(state),))


def propagate(state: np.ndarray, dt: np.ndarray, mu: float = MU) -> np.ndarray:
    """States (n, 6) moved by dt (n) days along their conics; rows that do not converge are NaN."""
    state, dt = _states(state, dt)
    return _moved(state, dt, mu)[0]


def transitions(state: np.ndarray, dt: np.ndarray, mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """States (n, 6) moved by dt days, and the (n, 6, 6) derivatives of the moved states by the initial ones, in closed form.

    The two-body transition matrix in universal functions, with the secular term C = (3 U5 - chi U4) / sqrt(mu) - dt U2.
    """
    state, dt = _states(state, dt)
    moved, chi, (f, g, fd, gd) = _moved(state, dt, mu)
    r0v, v0v, rv, vv = state[:, :3], state[:, 3:], moved[:, :3], moved[:, 3:]
    r0, r = np.linalg.norm(r0v, axis=1), np.linalg.norm(rv, axis=1)
    z = (2 / r0 - (v0v * v0v).sum(1) / mu) * chi * chi
    c2, c3 = _stumpff(z)
    small = np.abs(z) < 1e-2
    with np.errstate(all="ignore"):
        c4 = np.where(small, 1 / 24 - z / 720 + z * z / 40320 - z**3 / 3628800, (1 / 2 - c2) / z)
        c5 = np.where(small, 1 / 120 - z / 5040 + z * z / 362880 - z**3 / 39916800, (1 / 6 - c3) / z)
    secular = (3 * chi**5 * c5 - chi**5 * c4) / math.sqrt(mu) - dt * chi**2 * c2
    dr, dv, eye = rv - r0v, vv - v0v, np.eye(3)[None]
    outer = lambda a, b: np.einsum("ni,nj->nij", a, b)
    k = lambda x: x[:, None, None]
    phi = np.empty((len(state), 6, 6))
    phi[:, :3, :3] = k(r / mu) * outer(dv, dv) + k(1 / r0**3) * (k(r0 * (1 - f)) * outer(rv, r0v) + k(secular) * outer(vv, r0v)) + k(f) * eye
    phi[:, :3, 3:] = k(r0 / mu * (1 - f)) * (outer(dr, v0v) - outer(dv, r0v)) + k(secular / mu) * outer(vv, v0v) + k(g) * eye
    turn = eye - k(1 / r**2) * outer(rv, rv) + k(1 / (mu * r)) * np.einsum("nij,njk->nik", outer(rv, vv) - outer(vv, rv), outer(rv, dv))
    phi[:, 3:, :3] = -k(1 / r0**2) * outer(dv, r0v) - k(1 / r**2) * outer(rv, dv) + k(fd) * turn - k(mu * secular / (r**3 * r0**3)) * outer(rv, r0v)
    phi[:, 3:, 3:] = k(r0 / mu) * outer(dv, dv) + k(1 / r**3) * (k(r0 * (1 - f)) * outer(rv, r0v) - k(secular) * outer(rv, v0v)) + k(gd) * eye
    return moved, phi


def transition(state: np.ndarray, dt: float) -> np.ndarray:
    """The 6 x 6 derivative of one propagated state by the initial one."""
    return transitions(np.asarray(state, float)[None], np.array([dt]))[1][0]


def sigma_points(mean: np.ndarray, covariance: np.ndarray, alpha: float = 1.0, beta: float = 0.0, kappa: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, weights of the mean and weights of the covariance of the scaled unscented transform; a covariance that is not quite positive is mended."""
    n = len(mean)
    lam = alpha**2 * (n + kappa) - n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    root = vectors * np.sqrt(np.maximum(values, 0.0) * (n + lam))
    points = np.vstack([mean, mean + root.T, mean - root.T])
    wm = np.full(2 * n + 1, 1 / (2 * (n + lam)))
    wc = wm.copy()
    wm[0] = lam / (n + lam)
    wc[0] = wm[0] + 1 - alpha**2 + beta
    return points, wm, wc


def carried(state: np.ndarray, covariance: np.ndarray, dt: float, method: str = "linear", samples: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(state, covariance) after dt days: by the transition matrix (``linear``), by ``sigma-points``, or by ``samples`` drawn with a seed (``monte-carlo``)."""
    if method == "linear":
        moved, phi = transitions(state[None], np.array([dt]))
        return moved[0], phi[0] @ covariance @ phi[0].T
    if method == "sigma-points":
        points, wm, wc = sigma_points(state, covariance)
    elif method == "monte-carlo":
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        draws = np.random.Generator(np.random.PCG64(seed)).standard_normal((samples, 6))
        points = state + draws * np.sqrt(np.maximum(values, 0.0)) @ vectors.T
        wm, wc = np.full(samples, 1 / samples), np.full(samples, 1 / (samples - 1))
    else:
        raise ValueError(f"unknown covariance method {method!r}")
    moved = propagate(points, np.full(len(points), dt))
    mean = wm @ moved
    apart = moved - mean
    return mean, (apart * wc[:, None]).T @ apart


def from_elements(a, e, i, raan, ap, m, mu: float = MU) -> np.ndarray:
    """States from Keplerian elements (au, degrees) of ellipses."""
    a, e, i, raan, ap, m = (np.atleast_1d(np.asarray(x, float)) for x in (a, e, i, raan, ap, m))
    i, raan, ap, m = (np.radians(x) for x in (i, raan, ap, m))
    big = m + e * np.sin(m)
    for _ in range(50):
        big = big - (big - e * np.sin(big) - m) / (1 - e * np.cos(big))
    x, y = a * (np.cos(big) - e), a * np.sqrt(1 - e * e) * np.sin(big)
    n = np.sqrt(mu / a**3) / (1 - e * np.cos(big))
    vx, vy = -a * n * np.sin(big), a * n * np.sqrt(1 - e * e) * np.cos(big)
    co, so, ci, si, cw, sw = np.cos(raan), np.sin(raan), np.cos(i), np.sin(i), np.cos(ap), np.sin(ap)
    p = np.stack([co * cw - so * sw * ci, so * cw + co * sw * ci, sw * si], 1)
    q = np.stack([-co * sw - so * cw * ci, -so * sw + co * cw * ci, cw * si], 1)
    return np.hstack([p * x[:, None] + q * y[:, None], p * vx[:, None] + q * vy[:, None]])


def earth(mjd: np.ndarray) -> np.ndarray:
    """The Earth's state at times (MJD, TDB) on its mean ellipse of J2000."""
    t = np.atleast_1d(np.asarray(mjd, float)) - 51544.5
    start = from_elements(1.00000011, 0.01671022, 0.00005, -11.26064, 114.20783, 357.51716)
    return propagate(np.repeat(start, len(t), 0), t)


def directions(states: np.ndarray, observer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longitude, latitude (degrees) and distance, light-time corrected, of objects at their states as seen from positions, and the states seen."""
    lag = np.zeros(len(states))
    for _ in range(3):
        seen = propagate(states, -lag)
        d = seen[:, :3] - observer
        rho = np.linalg.norm(d, axis=1)
        lag = rho / LIGHT
    return np.degrees(np.arctan2(d[:, 1], d[:, 0])) % 360, np.degrees(np.arcsin(d[:, 2] / rho)), rho, seen


def predict(state: np.ndarray, epoch: float, mjd: np.ndarray, observer: np.ndarray) -> np.ndarray:
    """(n, 2) longitudes and latitudes of one orbit at times from positions."""
    lon, lat, _, _ = directions(propagate(np.repeat(state[None], len(mjd), 0), mjd - epoch), observer)
    return np.stack([lon, lat], 1)


def residuals(seen: np.ndarray, predicted: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """(n, 2) residuals in sigmas; longitudes are wrapped and scaled by the cosine of latitude."""
    d = seen - predicted
    d[:, 0] = (d[:, 0] + 180) % 360 - 180
    d[:, 0] *= np.cos(np.radians(seen[:, 1]))
    return d / sigma


def gibbs(r1: np.ndarray, r2: np.ndarray, r3: np.ndarray, mu: float = MU) -> np.ndarray:
    """Velocity at the middle of three positions of one conic."""
    n1, n2, n3 = (np.linalg.norm(x) for x in (r1, r2, r3))
    c12, c23, c31 = np.cross(r1, r2), np.cross(r2, r3), np.cross(r3, r1)
    n = n1 * c23 + n2 * c31 + n3 * c12
    d = c12 + c23 + c31
    s = r1 * (n2 - n3) + r2 * (n3 - n1) + r3 * (n1 - n2)
    return math.sqrt(mu / (np.linalg.norm(n) * np.linalg.norm(d))) * (np.cross(d, r2) / n2 + s)


def herrick_gibbs(r1, r2, r3, t1: float, t2: float, t3: float, mu: float = MU) -> np.ndarray:
    """The same for positions close together, by a Taylor series in time."""
    n1, n2, n3 = (np.linalg.norm(x) for x in (r1, r2, r3))
    t31, t32, t21 = t3 - t1, t3 - t2, t2 - t1
    return (
        -t32 * (1 / (t21 * t31) + mu / (12 * n1**3)) * r1
        + (t32 - t21) * (1 / (t21 * t32) + mu / (12 * n2**3)) * r2
        + t21 * (1 / (t32 * t31) + mu / (12 * n3**3)) * r3
    )


def gauss(lonlat: np.ndarray, mjd: np.ndarray, observer: np.ndarray, velocity: str = "gibbs", mu: float = MU) -> list[tuple[float, np.ndarray]]:
    """(epoch, state) for every plausible root of Gauss' problem for three directions."""
    lon, lat = np.radians(lonlat).T
    los = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    t1, t3 = mjd[0] - mjd[1], mjd[2] - mjd[1]
    t = t3 - t1
    p = [np.cross(los[1], los[2]), np.cross(los[0], los[2]), np.cross(los[0], los[1])]
    d0 = float(los[0] @ p[0])
    if abs(d0) < 1e-14 or t <= 0 or t1 >= 0 or t3 <= 0:
        return []
    d = np.array([[observer[i] @ p[j] for j in range(3)] for i in range(3)])
    a = (-d[0, 1] * t3 / t + d[1, 1] + d[2, 1] * t1 / t) / d0
    b = (d[0, 1] * (t3**2 - t**2) * t3 / t + d[2, 1] * (t**2 - t1**2) * t1 / t) / (6 * d0)
    e, r2 = float(observer[1] @ los[1]), float(observer[1] @ observer[1])
    roots = np.roots([1, 0, -(a * a + 2 * a * e + r2), 0, 0, -2 * mu * b * (a + e), 0, 0, -(mu * b) ** 2])
    out = []
    for root in sorted(x.real for x in roots if abs(x.imag) < 1e-8 and x.real > 0):
        u = mu / root**3
        rho = np.array([
            ((6 * (d[2, 0] * t1 / t3 + d[1, 0] * t / t3) * root**3 + mu * d[2, 0] * (t**2 - t1**2) * t1 / t3) / (6 * root**3 + mu * (t**2 - t3**2)) - d[0, 0]) / d0,
            a + mu * b / root**3,
            ((6 * (d[0, 2] * t3 / t1 - d[1, 2] * t / t1) * root**3 + mu * d[0, 2] * (t**2 - t3**2) * t3 / t1) / (6 * root**3 + mu * (t**2 - t1**2)) - d[2, 2]) / d0,
        ])
        r = observer + rho[:, None] * los
        if velocity == "gibbs":
            v = gibbs(*r)
        elif velocity == "herrick+gibbs":
            v = herrick_gibbs(*r, *mjd)
        elif velocity == "gauss":
            f1, f3, g1, g3 = 1 - u * t1**2 / 2, 1 - u * t3**2 / 2, t1 - u * t1**3 / 6, t3 - u * t3**3 / 6
            v = (f1 * r[2] - f3 * r[0]) / (f1 * g3 - f3 * g1)
        else:
            raise ValueError(f"unknown velocity method {velocity!r}")
        state = np.concatenate([r[1], v])
        if np.all(np.isfinite(state)) and rho[1] > 0 and np.linalg.norm(r[1]) <= 300 and np.linalg.norm(v) <= 1:
            out.append((float(mjd[1] - rho[1] / LIGHT), state))
    return out


def iterate(epoch: float, state: np.ndarray, lonlat: np.ndarray, mjd: np.ndarray, observer: np.ndarray, tolerance: float = 1e-13, rounds: int = 20) -> tuple[float, np.ndarray] | None:
    """A preliminary orbit improved until it passes through its three lines of sight, light time included.

    Newton's method on nine equations, the state and the three distances, with the analytic transition matrix.
    The epoch moves with the light time of the middle observation. None where it does not converge.
    """
    lon, lat = np.radians(lonlat).T
    sight = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    now = np.asarray(state, float).copy()
    rho = np.linalg.norm(propagate(np.repeat(now[None], 3, 0), mjd - epoch)[:, :3] - observer, axis=1)
    jac = np.zeros((9, 9))
    for _ in range(rounds):
        moved, phi = transitions(np.repeat(now[None], 3, 0), mjd - rho / LIGHT - epoch)
        miss = (moved[:, :3] - observer - rho[:, None] * sight).ravel()
        for i in range(3):
            jac[3 * i : 3 * i + 3, :6] = phi[i, :3]
            jac[3 * i : 3 * i + 3, 6 + i] = -sight[i] - moved[i, 3:] / LIGHT
        if not np.all(np.isfinite(jac)) or not np.all(np.isfinite(miss)):
            return None
        try:
            step = np.linalg.solve(jac, -miss)
        except np.linalg.LinAlgError:
            return None
        now, rho = now + step[:6], rho + step[6:]
        if np.abs(step).max() < tolerance * max(1.0, np.abs(now).max()):
            break
    else:
        if np.abs(miss).max() > 1e-9:
            return None
    if np.any(rho <= 0):
        return None
    at = float(mjd[1] - rho[1] / LIGHT)
    return at, propagate(now[None], np.array([at - epoch]))[0]


@dataclass(frozen=True)
class FitRules:
    min_obs: int = 6
    min_arc_length: float = 1.0
    contamination: float = 20.0
    rchi2: float = 1e3
    max_iter: int = 20
    selection: str = "combinations"
    velocity: str = "gibbs"
    #: Step of the numerical derivatives, relative to each component.
    delta: float = 1e-6
    #: Whether preliminary orbits are improved on their three observations before they are judged.
    iterate: bool = False


def triplets(mjd: np.ndarray, method: str, most: int) -> list[tuple[int, int, int]]:
    """Which three observations of the sorted ``mjd`` to try, in order: longest arc first, then the most central middle."""
    n = len(mjd)
    if n < 3:
        return []
    if method == "first+middle+last":
        return [(0, n // 2, n - 1)]
    if method == "thirds":
        return [(n // 6, n // 2, n - 1 - n // 6)]
    if method != "combinations":
        raise ValueError(f"unknown selection method {method!r}")
    return list(itertools.islice(_ranked(mjd, most), most))


def _ranked(mjd: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """All triplets of three different times of the sorted ``mjd``, best first, as far as the first ``most`` of them need.

    Pairs of ends come from a heap by arc, from the outside in; those of one arc are ranked together by
    their middles, of which a pair gives its ``most`` best.
    """
    n = len(mjd)
    heap, seen, level, arc = [(mjd[0] - mjd[n - 1], 0, n - 1)], {(0, n - 1)}, [], None

    def ranked() -> list[tuple[int, int, int]]:
        return [c for _, c in heapq.nsmallest(most, level)]

    while heap:
        minus, i, k = heapq.heappop(heap)
        if minus >= 0:
            break
        if minus != arc:
            yield from ranked()
            level, arc = [], minus
        between = np.flatnonzero((mjd[i + 1 : k] > mjd[i]) & (mjd[i + 1 : k] < mjd[k])) + i + 1
        far = np.abs(mjd[between] - (mjd[i] + mjd[k]) / 2)
        best = np.argsort(far, kind="stable")[:most]
        level += [(f, (i, j, k)) for f, j in zip(far[best].tolist(), between[best].tolist(), strict=True)]
        for a, b in ((i + 1, k), (i, k - 1)):
            if a < b and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (mjd[a] - mjd[b], a, b))
    yield from ranked()


def initial_orbit(seen, mjd, sigma, observer, rules: FitRules) -> tuple[float, np.ndarray, np.ndarray, float] | None:
    """(epoch, state, outlier mask, reduced chi2) of the first preliminary orbit that fits, dropping the worst observations as far as allowed."""
    n = len(mjd)
    if n < rules.min_obs or mjd.max() - mjd.min() < rules.min_arc_length:
        return None
    allowed = int(min(n * rules.contamination / 100, n - rules.min_obs))
    for three in triplets(mjd, rules.selection, 3 * (allowed + 1)):
        pick = list(three)
        for epoch, state in gauss(seen[pick], mjd[pick], observer[pick], rules.velocity):
            if rules.iterate:
                epoch, state = iterate(epoch, state, seen[pick], mjd[pick], observer[pick]) or (epoch, state)
            res = residuals(seen, predict(state, epoch, mjd, observer), sigma)
            chi2 = (res * res).sum(1)
            if not np.all(np.isfinite(chi2)):
                continue
            order = np.argsort(chi2)
            for dropped in range(allowed + 1):
                kept = np.sort(order[: n - dropped])
                arc = mjd[kept].max() - mjd[kept].min()
                rchi2 = chi2[kept].sum() / max(2 * len(kept) - 6, 1)
                if arc >= rules.min_arc_length and rchi2 <= rules.rchi2:
                    out = np.ones(n, bool)
                    out[kept] = False
                    return epoch, state, out, float(rchi2)
    return None


def correct(epoch: float, state: np.ndarray, seen, mjd, sigma, observer, rules: FitRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int] | None:
    """(state, covariance, outlier mask, reduced chi2, iterations) of a least-squares orbit, by Levenberg-damped Gauss-Newton steps.

    When it does not reach the threshold, the worst observation is dropped, as far as allowed.
    """
    n = len(mjd)
    if n < rules.min_obs:
        return None
    used, allowed, iterations = np.ones(n, bool), int(min(n * rules.contamination / 100, n - rules.min_obs)), 0
    while True:
        now, damp, delta = state.copy(), 1e-12, rules.delta
        res = residuals(seen[used], predict(now, epoch, mjd[used], observer[used]), sigma[used]).ravel()
        cost, covariance = float(res @ res), None
        for _ in range(rules.max_iter):
            iterations += 1
            h = np.maximum(np.abs(now), 1e-4) * delta
            jac = np.empty((len(res), 6))
            for k in range(6):
                up, down = now.copy(), now.copy()
                up[k] += h[k]
                down[k] -= h[k]
                diff = residuals(predict(up, epoch, mjd[used], observer[used]), predict(down, epoch, mjd[used], observer[used]), sigma[used])
                jac[:, k] = diff.ravel() / (2 * h[k])
            normal = jac.T @ jac
            scale = np.sqrt(np.diag(normal))
            if not np.all(np.isfinite(normal)) or np.any(scale == 0) or np.linalg.cond(normal / np.outer(scale, scale)) > 1e15:
                # A step that differences cannot resolve: a larger one, a few times.
                delta *= 10
                if delta > 1e3 * rules.delta:
                    break
                continue
            covariance = np.linalg.inv(normal / np.outer(scale, scale)) / np.outer(scale, scale)
            step = np.linalg.solve(normal + damp * np.diag(np.diag(normal)), jac.T @ res)
            trial = now + step
            new = residuals(seen[used], predict(trial, epoch, mjd[used], observer[used]), sigma[used]).ravel()
            if np.all(np.isfinite(new)) and new @ new < cost:
                gain, now, res, cost, damp = cost - float(new @ new), trial, new, float(new @ new), damp / 10
                if gain < 1e-9 * max(cost, 1.0):
                    break
            else:
                damp *= 100
                if damp > 1e6:
                    break
        rchi2 = cost / max(2 * int(used.sum()) - 6, 1)
        if covariance is not None and np.all(np.diag(covariance) > 0) and rchi2 <= rules.rchi2 and mjd[used].max() - mjd[used].min() >= rules.min_arc_length:
            return now, covariance, ~used, rchi2, iterations
        if int((~used).sum()) >= allowed:
            return None
        chi2 = (residuals(seen, predict(now, epoch, mjd, observer), sigma) ** 2).sum(1)
        chi2[~used] = -1
        used[int(np.nanargmax(chi2))] = False


STATE = ("x", "y", "z", "vx", "vy", "vz")


def to_orbits(fitted: DataFrame) -> DataFrame:
    """Fitted orbits as orbits: (orbit_id, coordinates with time, state and origin)."""
    days = F.floor("epoch").cast("bigint")
    nanos = F.round((F.col("epoch") - days) * 86400e9).cast("bigint")
    origin = F.struct(F.lit("SUN").alias("code")).alias("origin")
    return fitted.select("orbit_id", F.struct(*STATE, F.struct(days.alias("days"), nanos.alias("nanos")).alias("time"), origin).alias("coordinates"))


def from_orbits(orbits: DataFrame) -> DataFrame:
    """Orbits as flat rows with an epoch, the inverse of ``to_orbits``."""
    time = F.col("coordinates.time")
    return orbits.select("orbit_id", (time["days"] + time["nanos"] / 86400e9).alias("epoch"), *[F.col(f"coordinates.{c}").alias(c) for c in STATE])


ORBIT = "orbit_id string, epoch double, x double, y double, z double, vx double, vy double, vz double, arc_length double, num_obs long, reduced_chi2 double, iterations int, outliers array<string>, members array<string>, covariance array<double>, residuals array<struct<obs_id:string,d_lon:double,d_lat:double,chi2:double,outlier:boolean>>"


def _row(key, epoch, state, mjd, ids, out, rchi2, iterations, covariance, missed) -> dict:
    kept = ~out
    names = dict(zip(("x", "y", "z", "vx", "vy", "vz"), map(float, state), strict=True))
    return {"orbit_id": key, "epoch": epoch, **names, "arc_length": float(mjd[kept].max() - mjd[kept].min()), "num_obs": int(kept.sum()), "reduced_chi2": float(rchi2), "iterations": iterations, "outliers": list(ids[out]), "members": list(ids[kept]), "covariance": None if covariance is None else covariance.ravel().tolist(), "residuals": [{"obs_id": i, "d_lon": float(x), "d_lat": float(y), "chi2": float(x * x + y * y), "outlier": bool(o)} for i, (x, y), o in zip(ids, missed, out, strict=True)]}


def _arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values(["mjd", "obs_id"])
    observer = pdf[["ox", "oy", "oz"]].to_numpy(float)
    return pdf["obs_id"].to_numpy(), pdf[["lon", "lat"]].to_numpy(float), pdf["mjd"].to_numpy(float), pdf[["sigma_lon", "sigma_lat"]].to_numpy(float), observer


def _grouped(df: DataFrame, key: str, fit: Callable[[str, pd.DataFrame], dict | None]) -> DataFrame:
    columns = [f.name for f in StructType.fromDDL(ORBIT)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = fit(str(pdf[key].iloc[0]), pdf)
        return pd.DataFrame([found] if found else [], columns=columns)

    return df.groupBy(key).applyInPandas(run, ORBIT)


def initial_orbits(linkages: DataFrame, rules: FitRules = FitRules()) -> DataFrame:
    """ORBIT rows of the linkages (linkage_id, obs_id, mjd, lon, lat, sigma_lon, sigma_lat, ox, oy, oz) that have a preliminary orbit."""

    def fit(key, pdf):
        ids, seen, mjd, sigma, observer = _arrays(pdf)
        found = initial_orbit(seen, mjd, sigma, observer, rules)
        if found is None:
            return None
        missed = residuals(seen, predict(found[1], found[0], mjd, observer), sigma)
        return _row(key, found[0], found[1], mjd, ids, found[2], found[3], 0, None, missed)

    return _grouped(linkages, "linkage_id", fit)


def corrected_orbits(orbits: DataFrame, linkages: DataFrame, rules: FitRules = FitRules(rchi2=10.0)) -> DataFrame:
    """ORBIT rows after differential correction; linkages have ``orbit_id`` in place of linkage_id."""
    starts = orbits.select("orbit_id", "epoch", "x", "y", "z", "vx", "vy", "vz")

    def fit(key, pdf):
        first = pdf.iloc[0]
        ids, seen, mjd, sigma, observer = _arrays(pdf)
        state = first[["x", "y", "z", "vx", "vy", "vz"]].to_numpy(float)
        found = correct(float(first["epoch"]), state, seen, mjd, sigma, observer, rules)
        if found is None:
            return None
        missed = residuals(seen, predict(found[0], float(first["epoch"]), mjd, observer), sigma)
        return _row(key, float(first["epoch"]), found[0], mjd, ids, found[2], found[3], found[4], found[1], missed)

    return _grouped(linkages.join(starts, "orbit_id"), "orbit_id", fit)


def members_of(orbits: DataFrame) -> DataFrame:
    """A row for each observation of each orbit: its residuals in sigmas, their chi2, and whether it is an outlier."""
    return orbits.select("orbit_id", F.explode("residuals").alias("r")).select("orbit_id", "r.*")


def sky_covariance(state: np.ndarray, covariance: np.ndarray, dt: np.ndarray, observer: np.ndarray) -> np.ndarray:
    """(n, 3) variances and covariance, in degrees squared, of the longitudes and latitudes of states (n, 6) with covariances (n, 6, 6)."""
    moved, phi = transitions(state, dt)
    d = moved[:, :3] - observer
    flat2, rho2 = d[:, 0] ** 2 + d[:, 1] ** 2, (d * d).sum(1)
    jac = np.zeros((len(state), 2, 3))
    jac[:, 0, 0], jac[:, 0, 1] = -d[:, 1] / flat2, d[:, 0] / flat2
    jac[:, 1, :2], jac[:, 1, 2] = -(d[:, 2] / (rho2 * np.sqrt(flat2)))[:, None] * d[:, :2], np.sqrt(flat2) / rho2
    jac = np.degrees(np.einsum("nij,njk->nik", jac, phi[:, :3]))
    full = np.einsum("nik,nkl,njl->nij", jac, covariance.reshape(-1, 6, 6), jac)
    return np.stack([full[:, 0, 0], full[:, 0, 1], full[:, 1, 1]], 1)


def frame_covariance(state: np.ndarray, covariance: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """(n, 4, 4) covariances, in degrees and degrees a day, of (theta_x, theta_y) and their rates in the frames that move with the states."""
    moved, phi = transitions(state, dt)
    p, v = moved[:, :3], moved[:, 3:]
    r = np.linalg.norm(p, axis=1, keepdims=True)
    x = p / r
    z = np.cross(p, v)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = np.cross(z, x)
    out, along = (v * x).sum(1)[:, None], (v * y).sum(1)[:, None]
    jac = np.zeros((len(state), 4, 6))
    # At the frame's centre: angles are displacements over r, rates those of the plane's quotients.
    jac[:, 0, :3], jac[:, 1, :3] = y / r, z / r
    jac[:, 2, :3], jac[:, 2, 3:] = -x * along / r**2 - y * out / r**2, y / r
    jac[:, 3, :3], jac[:, 3, 3:] = -z * out / r**2, z / r
    jac = np.degrees(np.einsum("nij,njk->nik", jac, phi))
    return np.einsum("nik,nkl,njl->nij", jac, covariance.reshape(-1, 6, 6), jac)


def propagated(orbits: DataFrame, epoch: float, method: str = "linear") -> DataFrame:
    """Orbits moved to an epoch, with their covariance (row-major, if they have one) carried by ``method``: linear, sigma-points or monte-carlo."""
    has = "covariance" in orbits.columns

    def run(batches):
        for pdf in batches:
            state, dt = pdf[list(STATE)].to_numpy(float), epoch - pdf["epoch"].to_numpy(float)
            if not has:
                yield pd.DataFrame({"orbit_id": pdf["orbit_id"], "epoch": epoch, **dict(zip(STATE, propagate(state, dt).T, strict=True))})
                continue
            # A row's samples are drawn from a seed of its name, so that they do not depend on the partition.
            moved = [carried(s, np.asarray(c, float).reshape(6, 6), t, method, seed=zlib.crc32(str(i).encode())) for i, s, t, c in zip(pdf["orbit_id"], state, dt, pdf["covariance"], strict=True)]
            places = np.array([m for m, _ in moved]).reshape(-1, 6)
            yield pd.DataFrame({"orbit_id": pdf["orbit_id"], "epoch": epoch, **dict(zip(STATE, places.T, strict=True)), "covariance": [c.ravel() for _, c in moved]})

    kind = "orbit_id string, epoch double, " + ", ".join(f"{c} double" for c in STATE) + (", covariance array<double>" if has else "")
    return orbits.select("orbit_id", "epoch", *STATE, *(["covariance"] if has else [])).mapInPandas(run, kind)


#: Predicted covariance: of the place on the sky, and of angles and rates in the orbit's frame, in degrees and days.
PREDICTED_COVARIANCE = ("sx", "sxy", "sy", "gxx", "gxy", "gyy", "hxx", "hxy", "hyy")


def ephemeris(orbits: DataFrame, states: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, orbit_id, state_id, plon, plat, rho, px .. pvz: the state seen) of every orbit at every state (keys, state_id, mjd, ox, oy, oz).

    Without ``keys`` each orbit row is paired with all states as they pass through the task; states are a table of one
    row an exposure and are broadcast only by the planner's own measure of their size. With ``keys`` an orbit meets
    the states of its own key. Orbits with a ``covariance`` also give PREDICTED_COVARIANCE.
    """
    has = "covariance" in orbits.columns
    left, right = orbits.select(*keys, "orbit_id", "epoch", *STATE, *(["covariance"] if has else [])), states.select(*keys, "state_id", "mjd", "ox", "oy", "oz")
    pairs = left.join(right, keys) if keys else left.crossJoin(right)

    def run(batches):
        for pdf in batches:
            start, dt = pdf[list(STATE)].to_numpy(float), (pdf["mjd"] - pdf["epoch"]).to_numpy(float)
            observer = pdf[["ox", "oy", "oz"]].to_numpy(float)
            lon, lat, rho, seen = directions(propagate(start, dt), observer)
            out = pd.DataFrame({**{k: pdf[k] for k in keys}, "orbit_id": pdf["orbit_id"], "state_id": pdf["state_id"], "plon": lon, "plat": lat, "rho": rho, **{n: seen[:, i] for i, n in enumerate(("px", "py", "pz", "pvx", "pvy", "pvz"))}})
            if has and len(pdf):
                known = pdf["covariance"].notna().to_numpy()
                covariance = np.stack([np.asarray(c, float) if ok else np.full(36, np.nan) for c, ok in zip(pdf["covariance"], known, strict=True)])
                frame = frame_covariance(start, covariance, dt)
                found = [*sky_covariance(start, covariance, dt, observer).T, *(frame[:, i, j] for i, j in ((0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)))]
                for name, column in zip(PREDICTED_COVARIANCE, found, strict=True):
                    out[name] = column
            yield out

    kinds = [f"`{k}` {orbits.schema[k].dataType.simpleString()}" for k in keys]
    kinds += ["orbit_id string, state_id string, plon double, plat double, rho double, px double, py double, pz double, pvx double, pvy double, pvz double"]
    return pairs.mapInPandas(run, ", ".join([*kinds, *([f"{c} double" for c in PREDICTED_COVARIANCE] if has else [])]))


def attribute(orbits: DataFrame, observations: DataFrame, radius: float, k: int = 3, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Up to ``k`` nearest orbits within ``radius`` degrees of each observation (keys, obs_id, state_id, mjd, lon, lat, ox, oy, oz), among those of its key.

    Ids of observations and states differ between keys. Residuals are given in degrees, of longitude on the sky.
    """
    from .relational import attributed

    states = observations.select(*keys, "state_id", "mjd", "ox", "oy", "oz").dropDuplicates(["state_id"])
    predicted = ephemeris(orbits.drop("covariance"), states, keys).drop("rho", "px", "py", "pz", "pvx", "pvy", "pvz", *keys)
    found = attributed(observations.withColumnRenamed("mjd", "obs_mjd"), predicted, radius, k)
    return found.withColumns({"d_lon": sphere.wrapped(F.col("lon") - F.col("plon")) * F.cos(F.radians("lat")), "d_lat": F.col("lat") - F.col("plat")})


def merge_and_extend(orbits: DataFrame, observations: DataFrame, radius: float, rules: FitRules, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Orbits grown by attribution until none gains observations; every observation ends with its best orbit.

    An orbit of a further round has more observations than before, and the pool only shrinks, so rounds end.
    A round attributes, drops coincident attributions, corrects, and gives shared observations to the
    better orbit. Orbits that did not grow are final, and their observations leave the pool. With ``keys`` (test
    orbits) all keys grow in the same rounds, each in its own observations. A column ``success`` says whether the
    last correction held; an orbit for which it failed is as it was before.
    """
    from skyloom.sources.staging import stage

    from .relational import assign_duplicates, drop_coincident

    times = observations.select("obs_id", F.floor("mjd").cast("bigint").alias("days"), F.round((F.col("mjd") - F.floor("mjd")) * 86400e9).cast("bigint").alias("nanos"))
    owner = stage(orbits.select("orbit_id", *keys), "extend")
    now, pool, done = stage(orbits.drop(*keys), "extend"), observations, None
    keyed = lambda df: df.join(owner, "orbit_id") if keys else df
    while True:
        found = drop_coincident(attribute(keyed(now), pool, radius, keys=keys).select("orbit_id", "obs_id", "distance"), times)
        linked = found.select("orbit_id", "obs_id").join(pool, "obs_id")
        fitted = stage(corrected_orbits(now, linked, rules), "extend")
        members = fitted.select("orbit_id", F.explode("members").alias("obs_id"))
        kept, owned = assign_duplicates(fitted.select("orbit_id", "num_obs", "arc_length", "reduced_chi2"), members)
        owned = stage(owned, "extend")
        fitted = fitted.join(owned.select("orbit_id").distinct(), "orbit_id", "left_semi")
        before = now.select("orbit_id", F.col("num_obs").alias("had"))
        grown = stage(fitted.join(before, "orbit_id").withColumn("grew", F.col("num_obs") > F.col("had")), "extend")
        # Orbits whose correction fails end as they were.
        failed = now.join(members.select("orbit_id").distinct(), "orbit_id", "left_anti").withColumn("success", F.lit(False))
        final = grown.where("NOT grew").drop("grew", "had").withColumn("success", F.lit(True)).unionByName(failed)
        # What is final is written once, so that a round's plan does not hold those before it.
        done = stage(final if done is None else done.unionByName(final), "extend-done")
        claimed = owned.join(final.select("orbit_id"), "orbit_id", "left_semi")
        pool = stage(pool.join(claimed.select("obs_id"), "obs_id", "left_anti"), "extend")
        now = stage(grown.where("grew").drop("grew", "had"), "extend")
        if now.isEmpty():
            return keyed(done)
