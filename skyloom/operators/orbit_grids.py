"""Test orbits on a healpixel grid: directions, distances and Kepler-consistent velocities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import healpix

from . import phase_space
from .orbits import MU

ORBITS = "orbit_id string, bundle_id long, epoch double, x double, y double, z double, vx double, vy double, vz double, covariance array<double>"


def centres(edges: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Centres and half widths of bins."""
    e = np.asarray(edges, float)
    return (e[1:] + e[:-1]) / 2, (e[1:] - e[:-1]) / 2


def state_of(rho, lon, lat, e, nu, psi, mu: float = MU) -> np.ndarray:
    """Heliocentric states of orbits at distance rho and direction (lon, lat), with eccentricity e and true anomaly nu.

    The semi-latus rectum follows from the distance, radial and transverse speeds from the conic, and psi
    turns the transverse speed from prograde along longitude towards the pole. Angles are in degrees.
    """
    lon, lat, nu, psi = (np.radians(x) for x in (lon, lat, nu, psi))
    p = rho * (1 + e * np.cos(nu))
    radial, across = np.sqrt(mu / p) * e * np.sin(nu), np.sqrt(mu * p) / rho
    r_hat = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)
    east = np.stack([-np.sin(lon), np.cos(lon), np.zeros_like(lon)], -1)
    north = np.stack([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)], -1)
    v = radial[..., None] * r_hat + (across * np.cos(psi))[..., None] * east + (across * np.sin(psi))[..., None] * north
    return np.concatenate([rho[..., None] * r_hat, v], -1)


def geocentric_state(rho, lon, lat, e, nu, psi, earth: np.ndarray, mu: float = MU) -> np.ndarray:
    """The same from a geocentric direction and distance: the place is moved to the Sun first."""
    lo, la = np.radians(lon), np.radians(lat)
    place = rho[..., None] * np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], -1) + earth
    r = np.linalg.norm(place, axis=-1)
    return state_of(r, np.degrees(np.arctan2(place[..., 1], place[..., 0])), np.degrees(np.arcsin(place[..., 2] / r)), e, nu, psi, mu)


def phase_angle(state: np.ndarray, earth: np.ndarray) -> np.ndarray:
    """The angle at the object between the Sun and the Earth, in degrees."""
    to_sun, to_earth = -state[..., :3], earth - state[..., :3]
    c = (to_sun * to_earth).sum(-1) / np.linalg.norm(to_sun, axis=-1) / np.linalg.norm(to_earth, axis=-1)
    return np.degrees(np.arccos(np.clip(c, -1, 1)))


def _covariances(elements: list[np.ndarray], halves: list[np.ndarray], function) -> np.ndarray:
    """Row-major covariances of states from element half widths, by central differences."""
    n = len(elements[0])
    jac = np.empty((n, 6, 6))
    for k in range(6):
        h = np.maximum(np.abs(elements[k]), 1.0) * 1e-6
        up, down = [x.copy() for x in elements], [x.copy() for x in elements]
        up[k], down[k] = up[k] + h, down[k] - h
        jac[:, :, k] = (function(*up) - function(*down)) / (2 * h)[:, None]
    sigma2 = np.stack(halves, 1) ** 2
    return np.einsum("nik,nk,njk->nij", jac, sigma2, jac).reshape(n, 36)


def healpixel_orbits(
    pixels: DataFrame, nside: int, rho: list[float], e: list[float], nu: list[float], psi: list[float], epoch: float,
    min_q: float | None = None, max_q: float | None = None, geocentric: np.ndarray | None = None, max_phase: float | None = None,
) -> DataFrame:
    """ORBITS for every combination of a pixel of the table (pixel) and bin centres; ``geocentric`` is the Earth's position for distances from it.

    A pixel's combinations are numbers decoded in the tasks, so the product is made where it is used.
    """
    axes = [centres(x) for x in (rho, e, nu, psi)]
    sizes = [len(c) for c, _ in axes]
    size = math.degrees(math.sqrt(math.pi / 3) / nside) / 2

    def run(batches):
        for pdf in batches:
            own = pdf["pixel"].to_numpy()
            lon, lat = healpix.pix2ang_nest(nside, own)
            at, rest = [], pdf["id"].to_numpy()
            for n in sizes:
                at.append(rest % n)
                rest = rest // n
            (r, hr), (ec, he), (nc, hn), (pc, hp) = ((c[i], h[i]) for (c, h), i in zip(axes, at, strict=True))
            ec = np.clip(ec, 0, 0.999)
            elements = [r, lon, lat, ec, nc, pc]
            halves = [hr, np.full(len(r), size), np.full(len(r), size), he, hn, hp]
            make = state_of if geocentric is None else lambda *x: geocentric_state(*x, geocentric)
            state = make(*elements)
            ok = np.ones(len(r), bool) if geocentric is None or max_phase is None else phase_angle(state, geocentric) <= max_phase
            names = [f"hp{a:06d}_r{x:.4f}_e{b:.4f}_nu{c:.2f}_psi{d:.2f}" for a, x, b, c, d in zip(own, r, ec, nc, pc, strict=True)]
            out = pd.DataFrame({"orbit_id": names, "bundle_id": own, "epoch": epoch, **{n: state[:, i] for i, n in enumerate(("x", "y", "z", "vx", "vy", "vz"))}})
            out["covariance"] = list(_covariances(elements, halves, make))
            yield out[ok]

    numbered = pixels.select(F.col("pixel").cast("bigint").alias("pixel"), F.explode(F.sequence(F.lit(0), F.lit(math.prod(sizes) - 1))).alias("id"))
    made = numbered.mapInPandas(run, ORBITS)
    q: Column = phase_space.perihelion(tuple(map(F.col, "xyz")), tuple(map(F.col, ("vx", "vy", "vz"))), MU)
    if min_q is not None:
        made = made.where(q >= min_q)
    return made if max_q is None else made.where(q <= max_q)


def write_by_pixel(orbits: DataFrame, path: str) -> None:
    """Generated orbits as a table with a folder a pixel, so that a run over part of the sky reads its pixels alone.

    Rows are dealt by pixel and a hash of their names, so that a pixel with most of the orbits is several tasks' work and files.
    """
    dealt = orbits.repartition("bundle_id", F.pmod(F.xxhash64("orbit_id"), F.lit(8)))
    dealt.withColumn("pixel", F.col("bundle_id")).write.mode("overwrite").partitionBy("pixel").parquet(path)
