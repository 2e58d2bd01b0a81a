"""HEALPix pixel numbers (nested order) as column expressions, after Gorski et al. 2005."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(v: Column) -> Column:
    """The bits of v moved to the even places: its binary digits read in base four. ``v`` stands here once, so expressions stay small."""
    return F.conv(F.bin(v.cast("long")), 4, 10).cast("long")


def ang2pix_nest(lon: Column, lat: Column, nside: int) -> Column:
    """Nested pixel of a direction in degrees; ``nside`` is a power of two up to 65536."""
    z = F.sin(F.radians(lat))
    tt = F.pmod(lon, F.lit(360.0)) / 90.0
    up = nside * (0.5 + tt)
    down = nside * z * 0.75
    jp, jm = F.floor(up - down).cast("long"), F.floor(up + down).cast("long")
    fp, fm = F.floor(jp / F.lit(nside)).cast("long"), F.floor(jm / F.lit(nside)).cast("long")
    face_eq = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    ix_eq = F.pmod(jm, F.lit(nside))
    iy_eq = F.lit(nside - 1) - F.pmod(jp, F.lit(nside))
    ntt = F.least(F.floor(tt), F.lit(3)).cast("long")
    tp = tt - ntt
    tmp = nside * F.sqrt(3.0 * (1.0 - F.abs(z)))
    jp2 = F.least(F.floor(tp * tmp), F.lit(nside - 1)).cast("long")
    jm2 = F.least(F.floor((1.0 - tp) * tmp), F.lit(nside - 1)).cast("long")
    north = z >= 0
    polar = F.abs(z) > 2.0 / 3.0
    face = F.when(polar, F.when(north, ntt).otherwise(ntt + 8)).otherwise(face_eq)
    ix = F.when(polar, F.when(north, nside - 1 - jm2).otherwise(jp2)).otherwise(ix_eq).cast("long")
    iy = F.when(polar, F.when(north, nside - 1 - jp2).otherwise(jm2)).otherwise(iy_eq).cast("long")
    return (face * nside * nside + _spread(ix) + F.shiftleft(_spread(iy), 1)).cast("long")


def pixel_of(nside: int, lon: float, lat: float) -> int:
    """Nested pixel of one direction in degrees."""
    z, tt = math.sin(math.radians(lat)), lon % 360.0 / 90.0
    if abs(z) <= 2.0 / 3.0:
        jp, jm = math.floor(nside * (0.5 + tt - z * 0.75)), math.floor(nside * (0.5 + tt + z * 0.75))
        fp, fm = jp // nside, jm // nside
        face = fp % 4 + 4 if fp == fm else fp % 4 if fp < fm else fm % 4 + 8
        ix, iy = jm % nside, nside - 1 - jp % nside
    else:
        quarter = min(int(tt), 3)
        far = nside * math.sqrt(3.0 * (1.0 - abs(z)))
        a, b = min(int((tt - quarter) * far), nside - 1), min(int((1.0 - tt + quarter) * far), nside - 1)
        face, ix, iy = (quarter, nside - 1 - b, nside - 1 - a) if z >= 0 else (quarter + 8, a, b)
    spread = lambda v: int(bin(v)[2:], 4)
    return face * nside * nside + spread(ix) + 2 * spread(iy)


def children_nest(pixel: Column) -> Column:
    """The four pixels of twice the resolution."""
    return F.sequence(4 * pixel, 4 * pixel + 3)


def pix2ang_nest(nside: int, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees of pixel centres."""
    p = np.asarray(pixels, np.int64)
    face, low = p // (nside * nside), p % (nside * nside)

    def squeeze(v):
        v = v & 0x5555555555555555
        for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF)):
            v = (v | (v >> shift)) & mask
        return v

    ix, iy = squeeze(low), squeeze(low >> 1)
    row, column = 2 + face // 4, np.where(face // 4 == 1, 2 * (face % 4), 2 * (face % 4) + 1)
    jr = row * nside - ix - iy - 1
    cap_n, cap_s = jr < nside, jr > 3 * nside
    nr = np.where(cap_n, jr, np.where(cap_s, 4 * nside - jr, nside))
    z = np.where(cap_n, 1 - nr**2 / (3 * nside**2), np.where(cap_s, nr**2 / (3 * nside**2) - 1, (2 * nside - jr) * 2 / (3 * nside)))
    shift = np.where(cap_n | cap_s, 0, (jr - nside) & 1)
    jp = (column * nr + ix - iy + 1 + shift) // 2
    jp = np.where(jp > 4 * nr, jp - 4 * nr, np.where(jp < 1, jp + 4 * nr, jp))
    lon = (jp - (shift + 1) * 0.5) * (math.pi / 2 / nr)
    return np.degrees(lon) % 360.0, np.degrees(np.arcsin(z))


def boundary_nest(nside: int, pixel: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes along a pixel's edge, from the centres of the fine pixels on its rim."""
    fine = 64 * step
    base = np.arange(fine)

    def spread(v):
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v | (v << shift)) & mask
        return v

    edge = np.full(fine, fine - 1)
    x = np.concatenate([edge, base[::-1], 0 * base, base])
    y = np.concatenate([base, edge, base[::-1], 0 * base])
    return pix2ang_nest(nside * fine, pixel * fine * fine + spread(x) + (spread(y) << 1))
