"""Vectors as blocks of exact integers that rounds of an iterative operator read and write in the shared folder.

A block is a row: the carried columns of its vectors as lists, their integers in the narrowest type that holds
them, and what the operator remembers of them. A pass reads every block, writes it with a new memory, and adds a
row a task with the changes of its sums; sums of tasks are aggregated by Spark, so the driver gets as many
numbers as there are centroids or entries times their width. Integers are exact at any size: blocks whose
arithmetic would leave 64 bits are computed with Python's integers, and sums travel as limbs of 32 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged

#: Vectors of a block.
ROWS = 4096
_LIMB = 32
#: key: of the centroid or entry; limb: place of these 32 bits in its sum; n: vectors that came, less those that left; far: greatest squared distance.
SUMS = "array<struct<key:int,limb:int,n:bigint,far:double,v:array<bigint>>>"


def valid(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` components, all finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & ~odd)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers, exact for a ``scale`` that is a power of two: 64-bit integers, or Python's where these are too narrow."""
    x = np.asarray(values).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    flat = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def bound(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def squared(x: np.ndarray, centres: np.ndarray, most: int | None = None) -> np.ndarray:
    """Squared distances of rows to centres, exact. ``most`` bounds all magnitudes, if known."""
    m = bound(x) + bound(centres) if most is None else 2 * most
    room = x.shape[1] * m * m
    if room < 1 << 52:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if room < 1 << 60 else object
    a, b = x.astype(kind), centres.astype(kind)
    out = np.empty((len(a), len(b)), kind)
    for j in range(len(b)):
        apart = a - b[j]
        out[:, j] = (apart * apart).sum(1)
    return out


def integers(rows: list[list[int]], width: int) -> np.ndarray:
    """Python's integers as an array of them, in 64 bits where they fit with room to spare."""
    out = np.empty((len(rows), width), object)
    for i, row in enumerate(rows):
        out[i] = row
    return out.astype(np.int64) if bound(out) < 1 << 62 else out


def as_long(values: np.ndarray) -> pa.Array:
    """A column of longs, null where a value has more than 64 bits."""
    return pa.array(values, pa.int64()) if values.dtype != object else pa.array([v if v < 1 << 63 else None for v in values.tolist()], pa.int64())


def sha256(rows: list[list[int]]) -> str:
    return hashlib.sha256(",".join(str(v) for row in rows for v in row).encode()).hexdigest()


@dataclass
class Block:
    """Carried columns, integers and the operator's memory of some vectors."""

    columns: list[pa.Array]
    x: np.ndarray
    raw: bytes
    memory: bytes | None

    def __len__(self) -> int:
        return len(self.x)


def _encoded(values: np.ndarray, scale: int) -> tuple[np.ndarray, bytes]:
    q = quantised(values, scale)
    if q.dtype == object:
        return q, b"r" + np.ascontiguousarray(values, np.float64).tobytes()
    most = bound(q)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return q, np.dtype(kind).char.encode() + q.astype(kind).tobytes()


def _decoded(raw: bytes, dim: int, scale: int) -> np.ndarray:
    if raw[:1] == b"r":
        return quantised(np.frombuffer(raw, np.float64, offset=1).reshape(-1, dim), scale)
    return np.frombuffer(raw, np.dtype(raw[:1].decode()), offset=1).reshape(-1, dim).astype(np.int64)


def _blocks_of_rows(batches: Iterator[pa.RecordBatch], dim: int, scale: int, rows: int) -> Iterator[Block]:
    """Blocks from rows whose last column is the vector."""

    def made(held: list[pa.RecordBatch]) -> Block:
        whole = pa.Table.from_batches(held).combine_chunks()
        *columns, vectors = (c.chunk(0) for c in whole.columns)
        x, raw = _encoded(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
        return Block(columns, x, raw, None)

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == rows:
                yield made(held)
                held, n = [], 0
    if n:
        yield made(held)


def _blocks_of_table(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[Block]:
    for batch in batches:
        *columns, raws, memories = batch.columns
        for i in range(batch.num_rows):
            raw = raws[i].as_py()
            yield Block([c[i].values for c in columns], _decoded(raw, dim, scale), raw, memories[i].as_py())


class Changes:
    """A task's changes of sums and counts by key, and the greatest squared distance of a key's vectors."""

    def __init__(self, width: int):
        self.width, self.held, self.far = width, {}, {}

    def add(self, keys: np.ndarray, x: np.ndarray, sign: int) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        wide = x[order] if x.dtype != object and bound(x) * len(x) < 1 << 62 else x[order].astype(object)
        for key, total, n in zip(keys[starts].tolist(), np.add.reduceat(wide, starts, axis=0), np.diff([*starts, len(keys)]).tolist(), strict=True):
            entry = self.held.setdefault(key, [0, np.zeros(self.width, object)])
            entry[0] += sign * n
            entry[1] = entry[1] + sign * total.astype(object)

    def reach(self, key: int, far: float) -> None:
        self.far[key] = max(self.far.get(key, 0.0), far)

    def rows(self) -> list[dict]:
        out = []
        for key in sorted(self.held.keys() | self.far.keys()):
            n, total = self.held.get(key, (0, np.zeros(self.width, object)))
            v = [int(t) for t in total]
            limbs = max(t.bit_length() for t in v) // _LIMB + 1
            for i in range(limbs):
                # The last limb carries the sign.
                parts = [t >> _LIMB * i if i == limbs - 1 else t >> _LIMB * i & (1 << _LIMB) - 1 for t in v]
                out.append({"key": key, "limb": i, "n": n, "far": self.far.get(key, 0.0), "v": parts})
        return out


@dataclass(frozen=True)
class Total:
    n: int
    v: list[int]
    far: float


class Rounds:
    """Passes over the valid vectors of a table, each of which replaces the table that the one before has written.

    ``df`` has the carried columns and, last, the vector.
    """

    def __init__(self, df: DataFrame, scratch: Scratch, dim: int, scale: int, width: int, rows: int = ROWS):
        self.source, self.scratch, self.dim, self.scale, self.width, self.rows = df, scratch, dim, scale, width, rows
        self.carried, self.state, self.path = df.columns[:-1], None, None
        self.kinds = [df.schema[c].dataType.simpleString() for c in self.carried]

    def _blocks(self) -> tuple[DataFrame, Callable]:
        dim, scale, rows = self.dim, self.scale, self.rows
        if self.state is None:
            return self.source, lambda batches: _blocks_of_rows(batches, dim, scale, rows)
        return self.state.where("raw IS NOT NULL").drop("sums"), lambda batches: _blocks_of_table(batches, dim, scale)

    def step(self, visit: Callable[[Block, Changes], bytes]) -> dict[int, Total]:
        """Runs ``visit`` on every block, which returns its new memory and notes changes; gives the changes of all tasks by key."""
        df, blocks = self._blocks()
        kinds = [f"`{c}` array<{k}>" for c, k in zip(self.carried, self.kinds, strict=True)]
        schema = ", ".join([*kinds, "raw binary", "memory binary", f"sums {SUMS}"])
        width, names = self.width, [*self.carried, "raw", "memory", "sums"]
        count, sums_type = len(self.carried), pa.list_(pa.struct([("key", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("far", pa.float64()), ("v", pa.list_(pa.int64()))]))

        def run(batches):
            changes, types = Changes(width), None
            for block in blocks(batches):
                memory = visit(block, changes)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), c) for c in block.columns]
                types = [c.type for c in lists]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([block.raw], pa.binary()), pa.array([memory], pa.binary()), pa.array([None], sums_type)], names)
            if types is not None:
                none = [pa.nulls(1, t) for t in types]
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([changes.rows()], sums_type)], names)

        assert count == len(kinds)
        before = self.path
        self.state = staged(df.mapInArrow(run, schema), "vector-blocks")
        self.path = self.scratch.paths[-1]
        if before is not None:
            self.scratch.drop([before])
        parts = self.state.where("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.key", "s.limb", "s.n", "s.far", F.posexplode("s.v").alias("at", "part"))
        found: dict[int, Total] = {}
        sums: dict[int, list[int]] = {}
        # As many rows as keys times width times limbs.
        for r in parts.groupBy("key", "limb", "at").agg(F.sum("part").alias("part"), F.sum("n").alias("n"), F.max("far").alias("far")).collect():
            sums.setdefault(r["key"], [0] * width)[r["at"]] += r["part"] << _LIMB * r["limb"]
            if r["limb"] == 0 and r["at"] == 0:
                found[r["key"]] = Total(r["n"], sums[r["key"]], r["far"])
        return found

    def rows_of(self, visit: Callable[[Block], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
        """Rows, as carried columns and those that ``visit`` gives of every block."""
        df, blocks = self._blocks()
        every = [*self.carried, *names]

        def run(batches):
            for block in blocks(batches):
                yield pa.RecordBatch.from_arrays([*block.columns, *visit(block)], every)

        return df.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in zip(self.carried, self.kinds, strict=True)), schema]))
