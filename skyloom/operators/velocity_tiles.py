"""Clusters over a grid of velocities, by tiles of velocities and blocks of sky.

For density clusters a detection is dealt to the tiles of its test orbit's velocity grid, and in each to the blocks of the
tangent plane that it can lie in at any velocity of the tile: one or a few copies a tile where the product of
detections and velocities has one a velocity. The product itself only ever exists as arrays of one velocity in
a task. A task counts the cells of its block in an array, so velocities without a dense spot cost one count,
and dense spots leave it as clusters with their members.

Hotspots need no tiles. Their blocks move with each velocity, from the middle of the time on, so a detection wanders half as
far as from the epoch, and it is dealt to the few blocks that it meets at any velocity. Cells belong to exactly one
block, so hotspots are complete where they are found. A density cluster may cross blocks: a block also sees two cells of its neighbours, so it knows which of its points and of those next to it
are cores. Clusters that reach its edge leave it open, as members and the cores that they share with neighbours,
and are joined afterwards by connected components; all others are closed, checked and hashed in the task.

What a task holds is the detections of ``cells`` squared at one tile, or at all velocities: it follows the density of the sky,
not the size of the survey. Keys (the test orbit) are part of every group, so all test orbits of a run share a plan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skyloom.sources.staging import stage

from .components import label_components
from .relational import set_hash

#: Cells (of two radii) along a block's side, and the part of it that a tile's velocities may move a detection by.
BLOCK, DRIFT = 64, 0.25
#: The least cells along a side where the sky is crowded, and the detections of a block at one time beyond which it is cut.
SMALL, GROUP_ROWS = 16, 200_000
#: Arcs that a set may end before the middle of the time or begin after it, and still belong to the block that it then lies in.
NEAR = 1
#: Half-cell offsets, in units of the radius, of the four grids of hotspots.
SHIFTS = ((0, 0), (1, 0), (1, 1), (0, 1))
#: Columns of a keyed lattice of velocities; without a covariance the three of its inverse and ``reach`` are null.
LATTICE = "epoch double, radius double, span double, x_low double, x_high double, x_bins int, y_low double, y_high double, y_bins int, zero boolean, ixx double, ixy double, iyy double, reach double"


@dataclass(frozen=True)
class Validity:
    """What makes a dense spot a cluster."""

    min_obs: int = 6
    min_arc_length: float = 1.0
    min_nights: int = 3


def axis(low: float, high: float, bins: int, zero: bool) -> np.ndarray:
    """Evenly spaced velocities, with zero among them if asked for."""
    grid = np.linspace(low, high, bins)
    return np.sort(np.append(grid, 0.0)) if zero and not np.any(np.abs(grid) < 1e-6) else grid


def _axis_tiles(name: str, cells: int) -> Column:
    """Tiles (number, least and greatest velocity) of a lattice's axis. Bounds are a step wide of the mark, which costs copies only."""
    low, high, bins = F.col(f"{name}_low"), F.col(f"{name}_high"), F.col(f"{name}_bins")
    width = F.when(bins > 1, (high - low) / (bins - 1)).otherwise(F.lit(0.0))
    step = _step(width, F.col("span"), F.col("radius"), cells)
    last = F.floor((bins + F.col("zero").cast("int") - 1) / step)
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")),
        lambda i: F.struct(i.cast("int").alias("tile"), (low + width * (i * step - 1)).alias("low"), (low + width * ((i + 1) * step)).alias("high"), step.cast("int").alias("step")),
    )


def _step(width, span, radius, cells: int):
    """How many velocities of an axis a tile has."""
    if isinstance(width, Column):
        return F.least(F.lit(1 << 20), F.greatest(F.lit(1), F.floor(F.lit(DRIFT * cells) * 2 * radius / F.greatest(width * span, F.lit(1e-12))))).cast("int")
    return max(1, min(1 << 20, math.floor(DRIFT * cells * 2 * radius / max(width * span, 1e-12))))


@dataclass(frozen=True)
class Velocities:
    """Velocities given by the caller: all pairs of two axes, or pairs as listed."""

    vx: np.ndarray
    vy: np.ndarray
    paired: bool = False

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.vx, self.vy) if self.paired else (np.repeat(self.vx, len(self.vy)), np.tile(self.vy, len(self.vx)))

    def cut(self, span: float, radius: float, cells: int) -> tuple[list[tuple[int, int, float, float, float, float]], Callable[[int, int], tuple[np.ndarray, np.ndarray]]]:
        """Tiles (x, y, bounds) and what gives a tile's velocities."""
        if self.paired:
            rows = [slice(i, i + 64) for i in range(0, len(self.vx), 64)]
            bounds = [(i, 0, float(self.vx[s].min()), float(self.vx[s].max()), float(self.vy[s].min()), float(self.vy[s].max())) for i, s in enumerate(rows)]
            return bounds, lambda x, y: (self.vx[rows[x]], self.vy[rows[x]])
        cuts = []
        for v in (self.vx, self.vy):
            n = _step(float(np.diff(v).max()) if len(v) > 1 else 0.0, span, radius, cells)
            cuts.append([v[i : i + n] for i in range(0, len(v), n)])
        bounds = [(i, j, float(x[0]), float(x[-1]), float(y[0]), float(y[-1])) for i, x in enumerate(cuts[0]) for j, y in enumerate(cuts[1])]
        return bounds, lambda x, y: (np.repeat(cuts[0][x], len(cuts[1][y])), np.tile(cuts[1][y], len(cuts[0][x])))


def _dealt(points: DataFrame, keys: list[str], carried: list[str], cells: int) -> DataFrame:
    """Points (keys, id, theta_x, theta_y, mjd, days, epoch, radius, tiles) once a tile and block that they may lie in."""
    side, margin, dt = cells * 2 * F.col("radius"), 2.000001 * F.col("radius"), F.col("mjd") - F.col("epoch")
    out = points.withColumn("t", F.explode("tiles"))
    for name in "xy":
        ends = [F.col(f"theta_{name}") - F.col(f"t.{name}_{end}") * dt for end in ("low", "high")]
        low, high = F.floor((F.least(*ends) - margin) / side), F.floor((F.greatest(*ends) + margin) / side)
        out = out.withColumn(f"b{name}", F.explode(F.sequence(low, high)))
    return out.select(*keys, *carried, "epoch", "radius", F.col("t.x").alias("tile_x"), F.col("t.y").alias("tile_y"), "bx", "by", "id", "theta_x", "theta_y", "mjd", "days")


def cells_for(points: DataFrame, radius: float) -> int:
    """Cells along a block's side so that the fullest block of the sky, as it lies, has about ``GROUP_ROWS`` detections."""
    side = BLOCK * 2 * radius
    most = points.groupBy(F.floor(F.col("theta_x") / side).alias("x"), F.floor(F.col("theta_y") / side).alias("y")).count().agg(F.max("count")).first()[0] or 0
    cells = BLOCK
    while cells > SMALL and most * (cells / BLOCK) ** 2 > GROUP_ROWS:
        cells //= 2
    return cells


def _finite(points: DataFrame, columns: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in ("theta_x", "theta_y"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return points.where(ok).select(*columns, F.col("id").cast("string").alias("id"), "theta_x", "theta_y", "mjd", "days")


def _runs(key: np.ndarray, members: np.ndarray) -> Iterator[np.ndarray]:
    """Members grouped by key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    yield from np.split(members[order], cuts)


def _valid(at: np.ndarray, mjd: np.ndarray, days: np.ndarray, v: Validity) -> bool:
    t = mjd[at]
    return len(at) >= v.min_obs and t.max() - t.min() >= v.min_arc_length and len(np.unique(t)) == len(at) and len(np.unique(days[at])) >= v.min_nights


@dataclass(frozen=True)
class Points:
    """A group's detections by time. ``codes`` number the ids in their order, ``by_id`` lists detections in it, ``unique`` tells whether no id repeats."""

    theta: np.ndarray
    dt: np.ndarray
    mjd: np.ndarray
    days: np.ndarray
    ids: pa.Array
    codes: np.ndarray
    by_id: np.ndarray
    unique: bool

    @classmethod
    def of(cls, table: pa.Table, epoch: float) -> Points:
        order = np.argsort(table.column("mjd").to_numpy(), kind="stable")
        theta_x, theta_y, mjd, days = (table.column(c).to_numpy()[order] for c in ("theta_x", "theta_y", "mjd", "days"))
        ids = table.column("id").combine_chunks().take(pa.array(order))
        names = ids.dictionary_encode()
        rank = np.empty(len(names.dictionary), np.int64)
        rank[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank))
        codes = rank[names.indices.to_numpy()]
        return cls(np.stack([theta_x, theta_y]), mjd - epoch, mjd, days, ids, codes, np.argsort(codes, kind="stable"), len(rank) == len(order))

    def part(self, at: np.ndarray) -> Points:
        place = np.full(len(self.codes), -1, np.int64)
        place[at] = np.arange(len(at))
        by_id = place[self.by_id]
        return Points(self.theta[:, at], self.dt[at], self.mjd[at], self.days[at], self.ids.take(pa.array(at)), self.codes[at], by_id[by_id >= 0], self.unique)

    def sets(self, at: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The ids of runs of detections, each once a run and in order, and where the runs begin and the last ends."""
        n = len(starts)
        run = np.full(len(self.codes), n, np.uint16 if n < 1 << 16 else np.int64)
        run[at] = np.repeat(np.arange(n), np.diff(np.append(starts, len(at))))
        by = self.by_id[run[self.by_id] < n]
        by = by[np.argsort(run[by], kind="stable")]
        if not self.unique:
            by = by[np.concatenate([[True], (run[by][1:] != run[by][:-1]) | (self.codes[by][1:] != self.codes[by][:-1])])]
        return self.ids.take(pa.array(by)), np.searchsorted(run[by], np.arange(n + 1))


def _valid_runs(at: np.ndarray, starts: np.ndarray, p: Points, v: Validity) -> np.ndarray:
    """Which runs of detections, each in the order of time, make a cluster."""
    n = np.diff(np.append(starts, len(at)))
    ends = starts + n - 1
    t, day = p.mjd[at], p.days[at]
    run = np.repeat(np.arange(len(starts)), n)
    inner = run[1:] == run[:-1]
    again = np.bincount(run[1:][inner & (t[1:] == t[:-1])], minlength=len(starts))
    if (day[1:][inner] < day[:-1][inner]).any():
        order = np.lexsort((day, run))
        day = day[order]
    nights = 1 + np.bincount(run[1:][inner & (day[1:] != day[:-1])], minlength=len(starts))
    return (n >= v.min_obs) & (again == 0) & (t[ends] - t[starts] >= v.min_arc_length) & (nights >= v.min_nights)


def spots_of(p: Points, vx: float, vy: float, radius: float, origin: tuple[int, int], validity: Validity, shifts: int, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(grid, cells' qx, qy, members, starts of their runs) of the cells from ``origin`` on that hold valid clusters at one velocity."""
    x, y = p.theta[0] - vx * p.dt, p.theta[1] - vy * p.dt
    for shift, (dx, dy) in enumerate(SHIFTS[:shifts]):
        qx = np.floor((x + dx * radius) / (2 * radius)).astype(np.int64) - origin[0]
        qy = np.floor((y + dy * radius) / (2 * radius)).astype(np.int64) - origin[1]
        at = np.flatnonzero((qx >= 0) & (qx < cells) & (qy >= 0) & (qy < cells))
        key = (qx[at] * cells + qy[at]).astype(np.uint16 if cells * cells <= 1 << 16 else np.int64)
        count = np.bincount(key, minlength=cells * cells)
        dense = count[key] >= validity.min_obs
        if not dense.any():
            continue
        at, key = at[dense], key[dense]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        good = _valid_runs(at, starts, p, validity)
        if not good.any():
            continue
        n = np.diff(np.append(starts, len(at)))
        at, n, key = at[np.repeat(good, n)], n[good], key[starts[good]]
        yield shift, key.astype(np.int64) // cells + origin[0], key.astype(np.int64) % cells + origin[1], at, np.cumsum(n) - n


@dataclass(frozen=True)
class Density:
    """Local density clusters: closed ones as members, and of open ones (label, member, is a core, lies in the block)."""

    closed: list[np.ndarray]
    open: list[tuple[int, int, bool, bool]]


def density_of(theta: np.ndarray, dt: np.ndarray, vx: float, vy: float, eps: float, block: tuple[int, int], least: int, cells: int = BLOCK) -> Density | None:
    """Density clusters of a block at one velocity. Positions are in the order of ids, so the least label is that of the least id."""
    wide = 2 * cells + 4
    x, y = theta[0] - vx * dt, theta[1] - vy * dt
    cx = np.floor(x / eps).astype(np.int64) - block[0] * 2 * cells + 2
    cy = np.floor(y / eps).astype(np.int64) - block[1] * 2 * cells + 2
    here = np.flatnonzero((cx >= 0) & (cx < wide) & (cy >= 0) & (cy < wide))
    count = np.bincount(cx[here] * wide + cy[here], minlength=wide * wide).reshape(wide, wide)
    around = np.zeros((wide + 2, wide + 2), np.int64)
    for i in range(3):
        for j in range(3):
            around[i : i + wide, j : j + wide] += count
    around = around[1:-1, 1:-1]
    # Only a cell whose neighbourhood holds enough can have a core, and only cells next to such a cell can matter.
    able = (around >= least) & (count > 0)
    if not able.any():
        return None
    beside = np.zeros((wide + 2, wide + 2), bool)
    for i in range(3):
        for j in range(3):
            beside[i : i + wide, j : j + wide] |= able
    here = here[beside[1:-1, 1:-1][cx[here], cy[here]]]
    cell = cx[here] * wide + cy[here]
    order = np.argsort(cell, kind="stable")
    here, cell = here[order], cell[order]
    # Pairs of near points, each point with the runs of its nine cells.
    a_all, b_all = [], []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            target = cell + i * wide + j
            low, high = np.searchsorted(cell, target, "left"), np.searchsorted(cell, target, "right")
            n = high - low
            a = np.repeat(np.arange(len(here)), n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            near = (x[here[a]] - x[here[b]]) ** 2 + (y[here[a]] - y[here[b]]) ** 2 <= eps * eps
            a_all.append(a[near])
            b_all.append(b[near])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    hx, hy = cx[here], cy[here]
    home = (hx >= 2) & (hx < wide - 2) & (hy >= 2) & (hy < wide - 2)
    ring = (hx >= 1) & (hx < wide - 1) & (hy >= 1) & (hy < wide - 1)
    core = (np.bincount(a, minlength=len(here)) >= least) & ring
    if not core.any():
        return None
    label = here.copy()
    link = core[a] & core[b]
    la, lb = a[link], b[link]
    while True:
        before = label.copy()
        np.minimum.at(label, la, before[lb])
        if (label == before).all():
            break
    # A cluster is open if one of its cores lies beside the block or has a neighbour there.
    seen = core[a]
    opened = np.unique(label[a[seen & (~home[a] | ~home[b])]])
    rows: list[tuple[int, int, bool, bool]] = []
    members: list[tuple[int, int]] = []
    border = seen & ~core[b] & home[b]
    offers = np.unique(np.stack([here[b[border]], label[a[border]]], 1), axis=0) if border.any() else np.empty((0, 2), np.int64)
    if len(offers):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(offers[:, 0]) > 0]))
        # A point between clusters goes to the least label; if one of them is open, that is not known yet.
        for part in np.split(offers, starts[1:]):
            touched = part[np.isin(part[:, 1], opened)]
            if len(touched):
                rows += [(int(lab), int(p), False, True) for p, lab in part]
                opened = np.union1d(opened, part[:, 1])
            else:
                members.append((int(part[0, 1]), int(part[0, 0])))
    held = {int(v) for v in opened}
    rows += [(lab, p, False, True) for lab, p in members if lab in held]
    members = [(lab, p) for lab, p in members if lab not in held]
    for p, lab, is_home in zip(here[core].tolist(), label[core].tolist(), home[core].tolist(), strict=True):
        if lab in held:
            rows.append((lab, p, True, is_home))
        elif is_home:
            members.append((lab, p))
    closed: dict[int, list[int]] = {}
    for lab, p in members:
        closed.setdefault(lab, []).append(p)
    return Density([np.array(sorted(m)) for m in closed.values()], rows)


def _tile_velocities(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The velocities of a lattice's tile that lie in its ellipse."""
    g = pdf.iloc[0]
    parts = []
    for name in "xy":
        grid = axis(g[f"{name}_low"], g[f"{name}_high"], int(g[f"{name}_bins"]), bool(g["zero"]))
        step, tile = int(g[f"step_{name}"]), int(g[f"tile_{name}"])
        parts.append(grid[tile * step : (tile + 1) * step])
    return _inside(g, np.repeat(parts[0], len(parts[1])), np.tile(parts[1], len(parts[0])))


def _inside(g: pd.Series, vx: np.ndarray, vy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not np.isfinite(g["reach"]) or not np.isfinite(g["ixx"]):
        return vx, vy
    inside = g["ixx"] * vx * vx + 2 * g["ixy"] * vx * vy + g["iyy"] * vy * vy <= g["reach"] ** 2
    return vx[inside], vy[inside]


def _with_tiles(points: DataFrame, grid: DataFrame | Velocities, keys: list[str], epoch: float | None, radius: float | None, cells: int) -> tuple[DataFrame, Callable]:
    """Points dealt to tiles and blocks, and what gives a group's velocities."""
    if isinstance(grid, Velocities):
        span = points.agg(F.max(F.abs(F.col("mjd") - F.lit(epoch)))).first()[0] or 0.0
        # Smaller blocks get no smaller tiles: that would send every detection to more of them.
        bounds, velocities = grid.cut(span, radius, max(cells, BLOCK))
        names = ("x", "y", "x_low", "x_high", "y_low", "y_high")
        tiles = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(b, names, strict=True)]) for b in bounds])
        return _dealt(points.withColumns({"epoch": F.lit(epoch), "radius": F.lit(radius), "tiles": tiles}), keys, [], cells), lambda pdf: velocities(int(pdf["tile_x"].iloc[0]), int(pdf["tile_y"].iloc[0]))
    carried = ["x_low", "x_high", "x_bins", "y_low", "y_high", "y_bins", "zero", "ixx", "ixy", "iyy", "reach"]
    both = F.flatten(
        F.transform(
            _axis_tiles("x", cells),
            lambda a: F.transform(
                _axis_tiles("y", cells), lambda b: F.struct(a["tile"].alias("x"), b["tile"].alias("y"), a["low"].alias("x_low"), a["high"].alias("x_high"), b["low"].alias("y_low"), b["high"].alias("y_high"), a["step"].alias("step_x"), b["step"].alias("step_y"))
            ),
        )
    )
    cut = grid.withColumn("tiles", both)
    with_steps = cut.withColumns({"step_x": F.col("tiles")[0]["step_x"], "step_y": F.col("tiles")[0]["step_y"]})
    joined = points.join(with_steps, keys) if keys else points.crossJoin(with_steps)
    carried += ["step_x", "step_y"]
    return _dealt(joined, keys, carried, cells), _tile_velocities


@dataclass(frozen=True)
class Frame:
    """A key's velocities, and blocks that move with them from the time ``mid`` on."""

    epoch: float
    radius: float
    mid: float
    vx: np.ndarray
    vy: np.ndarray

    def origin(self, block: tuple[int, int], vx: float, vy: float, cells: int) -> tuple[int, int]:
        """A block's first cell at a velocity."""
        return tuple(b * cells - round(v * (self.mid - self.epoch) / (2 * self.radius)) for b, v in zip(block, (vx, vy), strict=True))

    def parts(self, theta: np.ndarray, mjd: np.ndarray, block: tuple[int, int], cells: int, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Velocities some at a time, with the detections that may then lie in the block or within ``margin`` cells of it."""
        if not len(self.vx) or not len(mjd):
            return
        t, side, m = mjd - self.mid, cells * 2 * self.radius, (margin + 1e-6) * 2 * self.radius
        step = DRIFT * side / max(float(np.abs(t).max()), 1e-12)
        tile = np.unique(np.stack([np.floor(self.vx / step), np.floor(self.vy / step)]), axis=1, return_inverse=True)[1].ravel()
        for some in _runs(tile, np.arange(len(tile))):
            near = np.ones(len(t), bool)
            for place, v, b in zip(theta, (self.vx[some], self.vy[some]), block, strict=True):
                one, two = place - v.min() * t, place - v.max() * t
                near &= (np.maximum(one, two) >= b * side - m) & (np.minimum(one, two) < (b + 1) * side + m)
            if near.any():
                yield some, np.flatnonzero(near)


def _lattice_velocities(g: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The velocities of a lattice that lie in its ellipse."""
    x, y = (axis(g[f"{n}_low"], g[f"{n}_high"], int(g[f"{n}_bins"]), bool(g["zero"])) for n in "xy")
    return _inside(g, np.repeat(x, len(y)), np.tile(y, len(x)))


def _framed(points: DataFrame, grid: DataFrame | Velocities, keys: list[str], epoch: float | None, radius: float | None, cells: int, margin: float, more: list[str] = []) -> tuple[DataFrame, Callable[[pd.Series], Frame]]:  # noqa: B006
    """Points once a block that they may lie in, or within ``margin`` cells of, at any velocity; and what gives the frame of a group's first row."""
    if isinstance(grid, Velocities):
        first, last = points.where(~F.isnan("mjd")).agg(F.min("mjd"), F.max("mjd")).first()
        vx, vy = grid.pairs()
        frame = Frame(epoch, radius, epoch if first is None else (first + last) / 2, vx, vy)
        values = {"__mid": F.lit(frame.mid), "__radius": F.lit(radius)}
        for n, v in (("x", vx), ("y", vy)):
            values |= {f"__{n}_low": F.lit(float(v.min())), f"__{n}_high": F.lit(float(v.max()))}
        out, carried, of = points.withColumns(values), [], lambda g: frame
    else:
        carried = ["epoch", "radius", "span", "x_low", "x_high", "x_bins", "y_low", "y_high", "y_bins", "zero", "ixx", "ixy", "iyy", "reach"]
        values = {"__mid": F.col("epoch") + F.col("span") / 2, "__radius": F.col("radius")}
        for n in "xy":
            # The zero of a lattice may lie beyond its ends.
            zero = F.when(F.col("zero"), F.lit(0.0))
            values |= {f"__{n}_low": F.least(f"{n}_low", zero), f"__{n}_high": F.greatest(f"{n}_high", zero)}
        lattice = grid.select(*keys, *carried).withColumns(values)
        out = points.join(lattice, keys) if keys else points.crossJoin(lattice)
        of = lambda g: Frame(float(g["epoch"]), float(g["radius"]), float(g["epoch"] + g["span"] / 2), *_lattice_velocities(g))
    cell, dt = 2 * F.col("__radius"), F.col("mjd") - F.col("__mid")
    for n in "xy":
        ends = [F.col(f"theta_{n}") - F.col(f"__{n}_{end}") * dt for end in ("low", "high")]
        low, high = F.floor((F.least(*ends) / cell - (margin + 1e-6)) / cells), F.floor((F.greatest(*ends) / cell + (margin + 1e-6)) / cells)
        out = out.withColumn(f"b{n}", F.explode(F.sequence(low, high)))
    return out.select(*keys, *carried, "bx", "by", "id", "theta_x", "theta_y", "mjd", "days", *more), of


def hotspot_clusters(
    points: DataFrame, grid: DataFrame | Velocities, validity: Validity = Validity(), shifts: int = 4, keys: list[str] = [], epoch: float | None = None, radius: float | None = None, cells: int = BLOCK, listed: bool = True  # noqa: B006
) -> DataFrame:
    """Valid hotspots over the velocities, each member set once with the least velocity that finds it.

    (keys, cluster_id, vx, vy, shift, qx, qy, num_obs, arc_length, members). ``points`` is (keys, id, theta_x, theta_y, mjd,
    days). ``grid`` is a lattice a key (LATTICE), or velocities with an ``epoch`` and a ``radius`` for all. Members are left
    out unless they are ``listed``.
    """
    kinds = [f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys]
    # A moved grid is half a cell off, and blocks follow a velocity in whole cells.
    margin = 1.5
    dealt, frame = _framed(_finite(points, keys), grid, keys, epoch, radius, cells, margin)
    schema = ", ".join([*kinds, "cluster_id string, vx double, vy double, shift int, qx bigint, qy bigint, num_obs bigint, arc_length double", *(["members array<string>"] if listed else [])])
    columns = _arrow_schema(points, schema)

    def run(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).to_pandas().iloc[0]
        f, block = frame(one), (int(one["bx"]), int(one["by"]))
        whole = Points.of(table, f.epoch)
        out = [columns.empty_table()]
        for some, near in f.parts(whole.theta, whole.mjd, block, cells, margin):
            # Sets of other parts are met again below, so that only a part's are Python objects at a time.
            p, best = whole.part(near), {}
            for vx, vy in zip(f.vx[some].tolist(), f.vy[some].tolist(), strict=True):
                for shift, qx, qy, at, starts in spots_of(p, vx, vy, f.radius, f.origin(block, vx, vy, cells), validity, shifts, cells):
                    ids, begins = p.sets(at, starts)
                    text = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())])[begins].tolist()
                    letters = memoryview(ids.buffers()[2] or b"")
                    ends = np.append(starts[1:], len(at))
                    rows = zip(qx.tolist(), qy.tolist(), (ends - starts).tolist(), (p.mjd[at[ends - 1]] - p.mjd[at[starts]]).tolist(), strict=True)
                    for i, (cx, cy, n, arc) in enumerate(rows):
                        name, found = hashlib.md5(letters[text[i] : text[i + 1]]).digest(), (vx, vy, shift, cx, cy)
                        if name not in best or found < best[name][:5]:
                            best[name] = (*found, n, arc, *([ids[begins[i] : begins[i + 1]].to_pylist()] if listed else []))
            rows = [(*(one[k] for k in keys), name.hex(), *row) for name, row in best.items()]
            out.append(pa.table([pa.array([r[i] for r in rows], c.type) for i, c in enumerate(columns)], schema=columns))
        return pa.concat_tables(out)

    found = dealt.groupBy(*keys, "bx", "by").applyInArrow(run, schema)
    more = ["num_obs", "arc_length", *(["members"] if listed else [])]
    best = found.groupBy(*keys, "cluster_id").agg(F.min(F.struct("vx", "vy", "shift", "qx", "qy")).alias("best"), *[F.first(c).alias(c) for c in more])
    return best.select(*keys, "cluster_id", "best.*", *more)


def hotspot_sets(points: DataFrame, grid: DataFrame | Velocities, validity: Validity = Validity(), shifts: int = 4, keys: list[str] = [], epoch: float | None = None, radius: float | None = None, cells: int = SMALL) -> DataFrame:  # noqa: B006
    """(keys, set_1, set_2, num_obs): the member sets of ``hotspot_clusters`` without their members, known by sums of 128-bit hashes of their ids."""
    found = _sets(points, grid, validity, shifts, keys, epoch, radius, cells, listed=True)
    return found.groupBy(*keys, "set_1", "set_2").agg(F.first("num_obs").alias("num_obs"))


def hotspot_counts(points: DataFrame, grid: DataFrame | Velocities, validity: Validity = Validity(), shifts: int = 4, keys: list[str] = [], epoch: float | None = None, radius: float | None = None, cells: int = SMALL) -> DataFrame:  # noqa: B006
    """(keys, clusters, members): how many sets ``hotspot_sets`` has, and the sum of their sizes. Only sets without a detection near the middle of the time are shuffled."""
    found = _sets(points, grid, validity, shifts, keys, epoch, radius, cells, listed=False)
    sets = found.groupBy(*keys, "set_1", "set_2").agg(F.first("num_obs").alias("num_obs"), F.sum("clusters").alias("clusters"), F.sum("members").alias("members"))
    known = F.col("set_1").isNull()
    return sets.groupBy(*keys).agg(F.sum(F.when(known, F.col("clusters")).otherwise(1)).alias("clusters"), F.sum(F.when(known, F.col("members")).otherwise(F.col("num_obs"))).alias("members"))


def _sets(points: DataFrame, grid: DataFrame | Velocities, validity: Validity, shifts: int, keys: list[str], epoch: float | None, radius: float | None, cells: int, listed: bool) -> DataFrame:
    """(keys, set_1, set_2, num_obs, clusters, members): a row a set, or one for all sets of a block that no other block finds.

    The line through a set's first and last detection tells where it lies in the middle of the time, whatever the velocity, and
    that is in or near every cell that holds the set: so the block there sees it at all velocities, and it alone counts
    it. A set far from the middle, or with an id of several detections, belongs to the block of its cell, and may be found by others.
    """
    kinds = [f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys]
    finite = _finite(points, keys)
    again = F.lit(False)
    if not finite.groupBy(*keys, "id").count().where("count > 1").isEmpty():
        again = F.count("*").over(Window.partitionBy(*keys, "id")) > 1
    dealt, frame = _framed(finite.withColumn("again", again), grid, keys, epoch, radius, cells, NEAR + 1, ["again"])
    schema = ", ".join([*kinds, "set_1 bigint, set_2 bigint, num_obs bigint, clusters bigint, members bigint"])
    columns = _arrow_schema(points, schema)

    def run(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).to_pandas().iloc[0]
        own, others = sets_of(table, frame(one), (int(one["bx"]), int(one["by"])), validity, shifts, cells)
        rows = np.concatenate([own, others]) if listed else others
        whole = [] if listed or not len(own) else [(len(own), int(own["n"].sum()))]
        n, none = len(rows) + len(whole), [None] * len(whole)
        out = [pa.array([one[k]] * n, columns.field(k).type) for k in keys]
        for c in ("h1", "h2", "n"):
            out.append(pa.concat_arrays([pa.array(np.ascontiguousarray(rows[c]).view(np.int64)), pa.array(none, pa.int64())]))
        for i in range(2):
            out.append(pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array([w[i] for w in whole], pa.int64())]))
        return pa.table(out, schema=columns)

    return dealt.groupBy(*keys, "bx", "by").applyInArrow(run, schema)


def sets_of(table: pa.Table, frame: Frame, block: tuple[int, int], v: Validity, shifts: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sets of a block at all velocities: those that it owns, and others of its cells.

    Detections are summed once by half cells; the cells of the four grids are all squares of two by two of those.
    """
    names = table.column("id").combine_chunks().dictionary_encode()
    words = names.dictionary.to_numpy(zero_copy_only=False).astype(object)
    codes = names.indices.to_numpy()
    h1, h2 = (pd.util.hash_array(words, hash_key=k, categorize=False)[codes] for k in ("skyloom-set-one-", "skyloom-set-two-"))
    t = table.column("mjd").to_numpy() - frame.mid
    order = np.argsort(t, kind="stable")
    h1, h2, t, codes = h1[order], h2[order], t[order], codes[order]
    x, y, mjd, days, again = (table.column(c).to_numpy()[order] for c in ("theta_x", "theta_y", "mjd", "days", "again"))
    own, others = _Sets(), _Sets()
    if not len(frame.vx):
        return own.distinct(), others.distinct()
    r, edge, side = frame.radius, NEAR + 2, cells * 2 * frame.radius
    time, times = np.unique(mjd, return_inverse=True, return_counts=True)[1:]
    shared = times[time] > 1
    day = np.unique(days, return_inverse=True)[1]
    bits = [np.where(day // 64 == w, np.uint64(1) << (day % 64).astype(np.uint64), np.uint64(0)) for w in range(int(day.max()) // 64 + 1)]
    wide = 2 * (cells + 2 * edge)
    small = np.uint16 if wide * wide <= 1 << 16 else np.int64
    offsets = np.array([0, 1, wide, wide + 1])
    allowed = np.zeros((2, 2), bool)
    for dx, dy in SHIFTS[:shifts]:
        allowed[dx, dy] = True
    place = np.arange(wide * wide)
    i, j = place // wide, place % wide
    window = allowed[i % 2, j % 2] & (i < wide - 1) & (j < wide - 1)
    inner = ((i + 1) // 2 >= edge) & ((i + 1) // 2 < edge + cells) & ((j + 1) // 2 >= edge) & ((j + 1) // 2 < edge + cells)

    def squares(values, starts, u, empty, join):
        """A figure of the half cells, joined over squares of two by two."""
        grid = np.full(wide * wide + wide + 1, empty, values.dtype)
        grid[u] = join.reduceat(values, starts)
        pairs = join(grid[:-1], grid[1:])
        return join(pairs[: wide * wide], pairs[wide:])

    for some, at in frame.parts(np.stack([x, y]), mjd, block, cells, NEAR + 1):
        px, py, dt, pt, p1, p2 = x[at], y[at], (mjd - frame.epoch)[at], t[at], h1[at], h2[at]
        pbits, twins = [b[at] for b in bits], np.flatnonzero(shared[at])
        pm, ptime = mjd[at], time[at][twins]
        pagain = again[at]
        odd = pagain.any()
        for vx, vy in zip(frame.vx[some], frame.vy[some], strict=True):
            first = frame.origin(block, vx, vy, cells)
            local = []
            for along, speed, o in ((px, vx, first[0]), (py, vy, first[1])):
                moved = along - speed * dt
                # The cells on the plain and on the shifted grid give the half cell.
                local.append(np.floor(moved / (2 * r)) + np.floor((moved + r) / (2 * r)) - 2.0 * (o - edge))
            lx, ly = local
            here = np.flatnonzero((lx >= 0) & (lx < wide) & (ly >= 0) & (ly < wide))
            if len(here) < v.min_obs:
                continue
            key = (lx[here] * wide + ly[here]).astype(small)
            by = np.argsort(key, kind="stable")
            sorted_, key = here[by], key[by]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            u = key[starts].astype(np.int64)
            runs = np.diff(np.append(starts, len(key)))
            each = np.arange(len(u))
            count = squares(runs, each, u, 0, np.add)
            good = np.flatnonzero((count >= v.min_obs) & window)
            if not len(good):
                continue
            one, two = (squares(sorted_[ends], each, u, e, join)[good] for ends, e, join in ((starts, len(at), np.minimum), (starts + runs - 1, -1, np.maximum)))
            arc, gap = pt[two] - pt[one], np.maximum(np.maximum(pt[one], -pt[two]), 0)
            close = (arc > 0) & (gap <= NEAR * arc)
            part = -pt[one] / np.where(arc > 0, arc, 1.0)
            home = [np.floor((p[one] + (p[two] - p[one]) * part) / side) == b for p, b in ((px, block[0]), (py, block[1]))]
            if odd:
                close &= squares(pagain[sorted_].astype(np.int64), starts, u, 0, np.add)[good] == 0
            mine = np.where(close, home[0] & home[1], inner[good]) & (pm[two] - pm[one] >= v.min_arc_length)
            good, close = good[mine], close[mine]
            nights = sum(np.bitwise_count(squares(b[sorted_], starts, u, np.uint64(0), np.bitwise_or)[good]).astype(np.int64) for b in pbits)
            good, close = good[nights >= v.min_nights], close[nights >= v.min_nights]
            if len(twins) and len(good):
                half = np.full(len(at), -1, np.int64)
                half[sorted_] = key
                half = half[twins]
                some_twins = half >= 0
                wanted = np.zeros(wide * wide, bool)
                wanted[good] = True
                # Squares that begin before the first half cell wrap to the last row or column, where none begins.
                square = (half[some_twins][:, None] - offsets).ravel()
                asked = np.flatnonzero(wanted[square])
                square = square[asked] % (wide * wide)
                when = ptime[some_twins][asked // 4]
                by = np.argsort(square.astype(small), kind="stable")
                square, when = square[by], when[by]
                wanted[square[1:][(square[1:] == square[:-1]) & (when[1:] == when[:-1])]] = False
                right = wanted[good]
                good, close = good[right], close[right]
            if not len(good):
                continue
            sets = np.empty(len(good), _SET)
            sets["n"] = count[good]
            sets["h1"] = squares(p1[sorted_], starts, u, np.uint64(0), np.add)[good]
            sets["h2"] = squares(p2[sorted_], starts, u, np.uint64(0), np.add)[good]
            if odd:
                # An id counts once.
                for k in np.flatnonzero(~close):
                    members = sorted_[np.isin(key, (good[k] + offsets).astype(small))]
                    members = members[np.unique(codes[at[members]], return_index=True)[1]]
                    sets["h1"][k], sets["h2"][k] = p1[members].sum(), p2[members].sum()
            own.add(sets[close])
            others.add(sets[~close])
    return own.distinct(), others.distinct()


_SET = np.dtype([("h1", np.uint64), ("h2", np.uint64), ("n", np.int64)])


class _Sets:
    """Distinct sets, of those added now and then."""

    def __init__(self):
        self.kept, self.waiting, self.n = np.empty(0, _SET), [], 0

    def add(self, sets: np.ndarray) -> None:
        self.waiting.append(sets)
        self.n += len(sets)
        if self.n > max(1 << 19, len(self.kept) // 2):
            self.distinct()

    def distinct(self) -> np.ndarray:
        self.kept = _distinct([self.kept, *self.waiting])
        self.waiting, self.n = [], 0
        return self.kept


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    sets = np.concatenate(parts)
    one, two = sets["h1"].copy(), sets["h2"].copy()
    order = np.argsort(one)
    one, two = one[order], two[order]
    same = one[1:] == one[:-1]
    if (same & (two[1:] != two[:-1])).any():
        # Only for sets that agree in the first hash alone.
        order = np.lexsort((sets["h2"], sets["h1"]))
        one, two = sets["h1"][order], sets["h2"][order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    return sets[order[np.concatenate([[True], ~same])[: len(sets)]]]


def _arrow_schema(points: DataFrame, schema: str) -> pa.Schema:
    return to_arrow_schema(points.sparkSession.createDataFrame([], schema).schema)


def density_clusters(
    points: DataFrame, grid: DataFrame | Velocities, validity: Validity = Validity(), keys: list[str] = [], epoch: float | None = None, radius: float | None = None, cells: int = BLOCK  # noqa: B006
) -> DataFrame:
    """(keys, cluster_id, members) of the valid density clusters at every velocity, each member set once.

    A core has ``validity.min_obs`` detections within the radius, itself included; cores that are neighbours
    share a cluster, another detection goes to the cluster of the least id among its neighbouring cores'.
    """
    kinds = [f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys]
    dealt, velocities = _with_tiles(_finite(points, keys), grid, keys, epoch, radius, cells)
    columns = [*keys, "vx", "vy", "members", "label", "id", "core", "home", "mjd", "days"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, mjd, days = (pdf[c].to_numpy() for c in ("id", "mjd", "days"))
        theta, dt = pdf[["theta_x", "theta_y"]].to_numpy().T, mjd - pdf["epoch"].iloc[0]
        eps, block = float(pdf["radius"].iloc[0]), (int(pdf["bx"].iloc[0]), int(pdf["by"].iloc[0]))
        own, seen, rows = tuple(pdf[k].iloc[0] for k in keys), set(), []
        for vx, vy in zip(*velocities(pdf), strict=True):
            found = density_of(theta, dt, vx, vy, eps, block, validity.min_obs, cells)
            if found is None:
                continue
            for at in found.closed:
                if (name := at.tobytes()) not in seen:
                    seen.add(name)
                    if _valid(at, mjd, days, validity):
                        rows.append((*own, vx, vy, sorted(set(ids[at])), None, None, None, None, None, None))
            rows += [(*own, vx, vy, None, ids[lab], ids[p], core, home, mjd[p], days[p]) for lab, p, core, home in found.open]
        return pd.DataFrame(rows, columns=columns)

    schema = ", ".join([*kinds, "vx double, vy double, members array<string>, label string, id string, core boolean, home boolean, mjd double, days bigint"])
    found = stage(dealt.groupBy(*keys, "tile_x", "tile_y", "bx", "by").applyInPandas(run, schema), "tiles")
    closed = found.where("members IS NOT NULL").select(*keys, F.md5(F.array_join("members", "")).alias("cluster_id"), "members")

    # Open clusters: one that a block sees a core of is the one that the core's own block puts it in.
    opened = found.where("label IS NOT NULL")
    where = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.col("vx").cast("string"), F.col("vy").cast("string"))
    opened = stage(opened.select(*keys, "vx", "vy", "id", "core", "home", "mjd", "days", F.concat_ws(" ", where, "label").alias("cluster"), F.concat_ws(" ", where, "id").alias("point")), "tiles-open")
    if opened.isEmpty():
        return closed.dropDuplicates([*keys, "cluster_id"])
    mine, theirs = opened.where("core AND home").select("point", F.col("cluster").alias("a")), opened.where("core AND NOT home").select("point", F.col("cluster").alias("b"))
    links = mine.join(theirs, "point").select("a", "b").distinct()
    labels = label_components(opened.select(F.col("cluster").alias("v")).distinct(), links.union(links.select("b", "a")))
    placed = opened.where("home").join(labels, opened["cluster"] == labels["v"]).groupBy(*keys, "vx", "vy", "id", "mjd", "days").agg(F.min("label").alias("label"))
    joined = placed.groupBy(*keys, "label").agg(
        F.count("*").alias("num_obs"), F.size(F.collect_set("mjd")).cast("bigint").alias("n_times"), (F.max("mjd") - F.min("mjd")).alias("arc_length"), F.size(F.collect_set("days")).alias("nights"),
        set_hash(F.col("id")).alias("cluster_id"), F.array_sort(F.collect_set("id")).alias("members"),
    )
    ok = (F.col("num_obs") >= validity.min_obs) & (F.col("n_times") == F.col("num_obs")) & (F.col("arc_length") >= validity.min_arc_length) & (F.col("nights") >= validity.min_nights)
    return closed.unionByName(joined.where(ok).select(*keys, "cluster_id", "members")).dropDuplicates([*keys, "cluster_id"])
