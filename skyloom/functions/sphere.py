"""Geometry on the sphere and in the tangent plane, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle in degrees between two directions in degrees, stable at all distances."""
    dl, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    a = F.cos(p2) * F.sin(dl)
    b = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    c = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(dl)
    return F.degrees(F.atan2(F.sqrt(a * a + b * b), c))


def mahalanobis2(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column) -> Column:
    """Squared Mahalanobis length of (dx, dy) under a 2 x 2 covariance, by its closed inverse."""
    det = sxx * syy - sxy * sxy
    return (syy * dx * dx - 2.0 * sxy * dx * dy + sxx * dy * dy) / det


def wrapped(degrees: Column) -> Column:
    """An angle's difference brought into [-180, 180)."""
    return degrees - 360.0 * F.floor((degrees + 180.0) / 360.0)


def to_cartesian(rho: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    c = F.cos(F.radians(lat))
    return rho * c * F.cos(F.radians(lon)), rho * c * F.sin(F.radians(lon)), rho * F.sin(F.radians(lat))


def to_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    rho = F.sqrt(x * x + y * y + z * z)
    lon = F.degrees(F.atan2(y, x))
    return rho, F.when(lon < 0, lon + 360.0).otherwise(lon), F.degrees(F.asin(z / rho))


#: Mean obliquity of the ecliptic at J2000 in degrees.
OBLIQUITY = 84381.448 / 3600.0


def equatorial_to_ecliptic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    c, s = F.cos(F.radians(F.lit(OBLIQUITY))), F.sin(F.radians(F.lit(OBLIQUITY)))
    return x, c * y + s * z, c * z - s * y


def ecliptic_to_equatorial(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    c, s = F.cos(F.radians(F.lit(OBLIQUITY))), F.sin(F.radians(F.lit(OBLIQUITY)))
    return x, c * y - s * z, c * z + s * y


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(a: tuple) -> tuple[Column, Column, Column]:
    n = F.sqrt(dot(a, a))
    return a[0] / n, a[1] / n, a[2] / n


def gnomonic_axes(r: tuple, v: tuple) -> list[tuple]:
    """Axes of the frame that moves with an orbit: x along its position, z along its angular momentum.

    A position parallel to its velocity takes the diagonal of the x-y plane as direction of motion.
    """
    x = unit(r)
    h = cross(r, v)
    still = dot(h, h) < 1e-30
    d = (F.lit(0.5**0.5), F.lit(0.5**0.5), F.lit(0.0))
    h = tuple(F.when(still, b).otherwise(a) for a, b in zip(h, cross(r, d), strict=True))
    z = unit(h)
    return [x, cross(z, x), z]


def gnomonic(position: tuple, velocity: tuple, axes: list[tuple]) -> tuple[Column, Column, Column, Column]:
    """Tangent-plane angles and rates in degrees of a Cartesian state in the frame of ``axes``."""
    x, y, z = (dot(a, position) for a in axes)
    vx, vy, vz = (dot(a, velocity) for a in axes)
    theta_x, theta_y = y / x, z / x
    return (
        F.degrees(theta_x),
        F.degrees(theta_y),
        F.degrees((x * vy - y * vx) / (x * x)),
        F.degrees((x * vz - z * vx) / (x * x)),
    )


def assumed_distance(r: Column, direction: tuple, origin: tuple, known: Column | None = None) -> Column:
    """Distance from an observer along a direction to a heliocentric sphere of radius ``r``.

    The ray meets the sphere at rho = -d + sqrt(d^2 + r^2 - R^2) with d the observer's part along the ray.
    A tiny negative root counts as zero, a truly negative one gives null; an outside observer sees the
    nearer point. A known finite distance is kept.
    """
    d, big = dot(direction, origin), dot(origin, origin)
    root2 = d * d + r * r - big
    root2 = F.when((root2 < 0) & (root2 >= -1e-15), 0.0).otherwise(root2)
    root = F.when(root2 >= 0, F.sqrt(root2))
    near = -d - root
    found = F.when((big > r * r) & (near > 0), near).otherwise(-d + root)
    return found if known is None else F.when(known.isNotNull() & ~F.isnan(known), known).otherwise(found)


def variance_at(covariance: Column, k: int, size: int) -> Column:
    """The k-th diagonal entry of a row-major square matrix given as an array."""
    return F.element_at(covariance, k * size + k + 1)


def sigmas(covariance: Column, size: int) -> Column:
    """Square roots of the diagonal; null where an entry is NaN or null."""
    return F.array(*[F.when(~F.isnan(variance_at(covariance, k, size)), F.sqrt(variance_at(covariance, k, size))) for k in range(size)])


def diagonal(sigma: Column, size: int) -> Column:
    """A row-major covariance from an array of sigmas."""
    zero = F.lit(0.0)
    return F.array(*[F.pow(F.element_at(sigma, i + 1), 2) if i == j else zero for i in range(size) for j in range(size)])


def zeroed(covariance: Column, least: float = 1e-20) -> Column:
    """NaN, infinite and negligible entries set to zero."""
    return F.transform(covariance, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) < least), 0.0).otherwise(x))


def nanmean(covariance: Column, size: int) -> Column:
    """The mean matrix of a group, entry by entry over the values that are numbers; null where there is none."""
    entry = lambda k: F.element_at(covariance, k + 1)
    return F.array(*[F.avg(F.when(~F.isnan(entry(k)), entry(k))) for k in range(size * size)])


def correlation(cov: Column, sigma_x: Column, sigma_y: Column) -> Column:
    """Covariance over the product of sigmas; null where that is no finite number."""
    found = cov / F.nullif(sigma_x * sigma_y, F.lit(0.0))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def all_nan(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNull() | F.isnan(x))


def whiten2(dx: Column, dy: Column, sxx: Column, sxy: Column, syy: Column) -> tuple[Column, Column]:
    """(dx, dy) in units of sigma along the covariance's principal axes, by the 2 x 2 closed form."""
    half, mean = (sxx - syy) / 2, (sxx + syy) / 2
    spread = F.sqrt(half * half + sxy * sxy)
    angle = 0.5 * F.atan2(2 * sxy, sxx - syy)
    big, small = F.greatest(mean + spread, F.lit(1e-15)), F.greatest(mean - spread, F.lit(1e-15))
    return (F.cos(angle) * dx + F.sin(angle) * dy) / F.sqrt(big), (F.cos(angle) * dy - F.sin(angle) * dx) / F.sqrt(small)
