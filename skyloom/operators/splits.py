"""Splits of test orbits whose neighbourhood holds too many detections: children that cover a parent's phase space in smaller pieces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import healpix

from .orbits import STATE

#: Fixed values of a split along the leading axis: reach in sigmas, shares of the leading and the other sigmas, children a level, levels.
REACH, LEADING, OTHERS, CHILDREN, LEVELS = 1.0, 0.67, 1.0, 3, 2


def positive(covariance: np.ndarray) -> np.ndarray:
    """The nearest symmetric matrix without negative eigenvalues."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return vectors @ np.diag(np.maximum(values, 0.0)) @ vectors.T


def along_axis(mean: np.ndarray, covariance: np.ndarray, dt: float, levels: int = LEVELS, k: float = REACH, beta: float = LEADING, gamma: float = OTHERS, num: int = CHILDREN) -> list[tuple[np.ndarray, np.ndarray]]:
    """``num`` children a level along the longest axis of the covariance, with rates measured by what they move over ``dt`` days."""
    if levels == 0:
        return [(mean, positive(covariance))]
    scale = np.array([1.0] * 3 + [max(dt, 1e-6)] * 3)
    values, vectors = np.linalg.eigh(positive(covariance * np.outer(scale, scale)))
    lead = int(np.argmax(values))
    shares = np.where(np.arange(6) == lead, beta**2, gamma**2)
    child = vectors @ np.diag(np.maximum(values, 0.0) * shares) @ vectors.T / np.outer(scale, scale)
    steps = np.linspace(-k * (1 - beta), k * (1 - beta), num) if num > 1 else np.zeros(1)
    out = []
    for s in steps * math.sqrt(max(values[lead], 0.0)):
        out += along_axis(mean + s * vectors[:, lead] / scale, child, dt, levels - 1, k, beta, gamma, num)
    return out


def spherical(state: np.ndarray) -> np.ndarray:
    """(n, 6) distance, longitude, latitude (degrees) and their rates of Cartesian states."""
    x, y, z, vx, vy, vz = state.T
    flat2 = x * x + y * y
    r = np.sqrt(flat2 + z * z)
    out = (x * vx + y * vy + z * vz) / r
    return np.stack([r, np.degrees(np.arctan2(y, x)) % 360, np.degrees(np.arcsin(z / r)), out, np.degrees((x * vy - y * vx) / flat2), np.degrees((vz - out * z / r) / np.sqrt(flat2))], 1)


def cartesian(coordinates: np.ndarray) -> np.ndarray:
    """The inverse of ``spherical``."""
    r, lon, lat, out, vlon, vlat = coordinates.T
    lon, lat, vlon, vlat = (np.radians(a) for a in (lon, lat, vlon, vlat))
    cb, sb, cl, sl = np.cos(lat), np.sin(lat), np.cos(lon), np.sin(lon)
    return np.stack([
        r * cb * cl, r * cb * sl, r * sb,
        out * cb * cl - r * sb * cl * vlat - r * cb * sl * vlon, out * cb * sl - r * sb * sl * vlat + r * cb * cl * vlon, out * sb + r * cb * vlat,
    ], 1)


def derivative(function, at: np.ndarray) -> np.ndarray:
    """The 6 x 6 derivative of a change of coordinates at one row, by central differences; longitudes are kept together."""
    h = np.maximum(np.abs(at), 1e-2) * 1e-6
    up, down = function(at + np.diag(h)), function(at - np.diag(h))
    apart = up - down
    if function is spherical:
        apart[:, 1] = (apart[:, 1] + 180) % 360 - 180
    return (apart / (2 * h)[:, None]).T


def by_pixel(mean: np.ndarray, covariance: np.ndarray, nside: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(pixel, state, covariance) of the four pixels of twice the ``nside`` in the orbit's own: directions and their sigmas become the child's, all else stays."""
    here = spherical(mean[None])[0]
    forth = derivative(spherical, mean)
    known = forth @ covariance @ forth.T
    parent = healpix.pixel_of(nside, float(here[1]), float(here[2]))
    out = []
    for pixel in range(4 * parent, 4 * parent + 4):
        lon, lat = (float(np.ravel(a)[0]) for a in healpix.pix2ang_nest(2 * nside, np.array([pixel])))
        edge_lon, edge_lat = healpix.boundary_nest(2 * nside, pixel)
        child, c = here.copy(), known.copy()
        child[1], child[2] = lon, lat
        c[1, 2] = c[2, 1] = 0.0
        c[1, 1], c[2, 2] = np.max(np.abs((np.asarray(edge_lon) - lon + 180) % 360 - 180)) ** 2, np.max(np.abs(np.asarray(edge_lat) - lat)) ** 2
        back = derivative(cartesian, child)
        out.append((pixel, cartesian(child[None])[0], back @ positive(c) @ back.T))
    return out


def split_orbits(orbits: DataFrame, method: str) -> DataFrame:
    """Children of test orbits (orbit_id, epoch, state, covariance, arc; nside for pixels): the same columns without ``arc``, with their ``owner``.

    Names are the parent's with the child's number. By ``eigenvalue``, nine along the longest axis; by ``healpixel``, four pixels.
    """
    if method not in ("eigenvalue", "healpixel"):
        raise ValueError(f"unknown split method {method!r}")
    pixels = "nside" in orbits.columns
    if method == "healpixel" and not pixels:
        raise ValueError("a split by pixels needs the orbits' nside")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mean, covariance = np.array([getattr(r, c) for c in STATE], float), np.asarray(r.covariance, float).reshape(6, 6)
                children = [(m, c) for _, m, c in by_pixel(mean, covariance, int(r.nside))] if method == "healpixel" else along_axis(mean, covariance, float(r.arc))
                for i, (m, c) in enumerate(children):
                    rows.append((f"{r.orbit_id}_{i:03d}", r.orbit_id, r.epoch, *map(float, m), c.ravel().tolist(), *([int(r.nside) * (2 if method == "healpixel" else 1)] if pixels else [])))
            yield pd.DataFrame(rows, columns=["orbit_id", "owner", "epoch", *STATE, "covariance", *(["nside"] if pixels else [])])

    kind = "orbit_id string, owner string, epoch double, " + ", ".join(f"{c} double" for c in STATE) + ", covariance array<double>" + (", nside long" if pixels else "")
    return orbits.where(F.col("covariance").isNotNull()).mapInPandas(run, kind)
