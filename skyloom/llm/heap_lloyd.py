"""Vector codes by a product quantiser whose codebooks are trained by heap Lloyd, exact in integers.

Vectors are cut into equal parts, each with a codebook of its own. A block of vectors keeps, for every entry of
every codebook, a heap of the parts that the entry holds. A part's key is its slack, the distance to the second
nearest entry less that to its own, plus the drift that the entry had gathered when it was put in: its own moves and
the largest move of any other entry. While a heap's least key is above the entry's drift of today no part of the
heap can have a nearer entry, so only the parts below are popped and compared with all entries again. Sums of
entries change by the parts that have moved.

Comparisons, means and errors are integers, ties included; keys are floating, rounded so that a part is popped
too early but never too late. Heaps are arrays in rising order of keys, a heap whose parts to pop are its front, so
all are popped at once.

Edge cases: vectors that are null, of another length or with a null or non-finite component go. Fewer vectors
than entries give as many entries as vectors, and equal vectors give equal entries, of which the lower is used.
Among equal ids, which null ids follow, the smaller vector is the earlier entry. Repeated rows are coded alike.
An empty table gives an empty result. Columns other than id, vector and label are not read, so their names cannot
clash. Errors, and their sums, that exceed 64 bits are null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, staged
from .vector_blocks import Block, Changes, Rounds, as_long, integers, quantised, sha256, squared, valid

#: Relative room for the rounding of keys and drifts.
MARGIN = 1e-9
_MOST = float(np.finfo(np.float32).max)


class Heaps:
    """The heaps of one codebook over a block: keys and parts of all entries, entry after entry, each in rising order of keys."""

    def __init__(self, starts: np.ndarray, keys: np.ndarray, parts: np.ndarray):
        self.starts, self.keys, self.parts = starts, keys, parts

    @classmethod
    def of(cls, entries: int, labels: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> Heaps:
        order = np.lexsort((parts, keys, labels))
        return cls(np.searchsorted(labels[order], np.arange(entries + 1)), keys[order], parts[order])

    def labels(self) -> np.ndarray:
        """The entry of every part, by part."""
        out = np.empty(len(self.parts), np.int64)
        out[self.parts] = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return out

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, parts) whose key is not above their entry's drift; they leave their heaps."""
        ends = [a + np.searchsorted(self.keys[a:b], d, side="right") for a, b, d in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), drift.tolist(), strict=True)]
        out = np.zeros(len(self.keys), bool)
        for a, b in zip(self.starts[:-1].tolist(), ends, strict=True):
            out[a:b] = True
        entry = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        popped = entry[out], self.parts[out]
        self.keys, self.parts = self.keys[~out], self.parts[~out]
        self.starts = np.searchsorted(entry[~out], np.arange(len(self.starts)))
        return popped

    def push(self, labels: np.ndarray, keys: np.ndarray, parts: np.ndarray) -> None:
        """Puts parts into the heaps of ``labels``; what lies there is merged with, not sorted again."""
        new = Heaps.of(len(self.starts) - 1, labels, keys, parts)
        places = [a + np.searchsorted(self.keys[a:b], new.keys[c:d]) for a, b, c, d in zip(self.starts[:-1], self.starts[1:], new.starts[:-1], new.starts[1:], strict=True)]
        at = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64)
        self.keys, self.parts = np.insert(self.keys, at, new.keys), np.insert(self.parts, at, new.parts)
        self.starts = self.starts + new.starts

    def dump(self) -> bytes:
        return self.starts.astype(np.int32).tobytes() + self.keys.astype(np.float32).tobytes() + self.parts.astype(np.uint32).tobytes()

    @classmethod
    def load(cls, raw: bytes, entries: int, n: int) -> Heaps:
        starts = np.frombuffer(raw, np.int32, entries + 1).astype(np.int64)
        keys = np.frombuffer(raw, np.float32, n, 4 * (entries + 1))
        return cls(starts, keys, np.frombuffer(raw, np.uint32, n, 4 * (entries + 1 + n)).astype(np.int64))


@dataclass(frozen=True)
class Books:
    """A codebook a part position, and the drift that each entry has gathered."""

    entries: list[np.ndarray]
    drift: np.ndarray


def scan(x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, key) of parts by comparing all entries."""
    d = squared(x, entries)
    labels = d.argmin(1).astype(np.int64)
    rows = np.arange(len(x))
    own = np.sqrt(d[rows, labels].astype(np.float64))
    if d.shape[1] == 1:
        return labels, np.full(len(x), _MOST, np.float32)
    others = d.astype(np.float64)
    others[rows, labels] = np.inf
    second, gathered = np.sqrt(others.min(1)), drift[labels]
    keys = np.minimum(second - own + gathered - MARGIN * (second + own + gathered), _MOST)
    low = keys.astype(np.float32)
    return labels, np.where(low > keys, np.nextafter(low, np.float32(-np.inf)), low)


def visited(block: Block, changes: Changes | None, books: Books, dump: bool = True) -> tuple[bytes | None, list[np.ndarray]]:
    """(new memory, entries by part position) of a block, its changes noted."""
    width, memory, labels = books.entries[0].shape[1], [], []
    size = len(books.entries[0])
    each = 4 * (size + 1 + 2 * len(block))
    for p, entries in enumerate(books.entries):
        x, drift = block.x[:, p * width : (p + 1) * width], books.drift[p]
        if block.memory is None:
            found, keys = scan(x, entries, drift)
            heaps = Heaps.of(size, found, keys, np.arange(len(block)))
            if changes is not None:
                changes.add(p * size + found, x, 1)
        else:
            heaps = Heaps.load(block.memory[p * each : (p + 1) * each], size, len(block))
            before, parts = heaps.pop(drift)
            found, keys = scan(x[parts], entries, drift)
            heaps.push(found, keys, parts)
            if changes is not None:
                moved = np.flatnonzero(found != before)
                changes.add(p * size + before[moved], x[parts[moved]], -1)
                changes.add(p * size + found[moved], x[parts[moved]], 1)
        if dump:
            memory.append(heaps.dump())
        else:
            labels.append(heaps.labels())
    return b"".join(memory) if dump else None, labels


def drifted(gathered: np.ndarray, old: list[list[list[int]]], new: list[list[list[int]]]) -> np.ndarray:
    """The drift after a move: an entry's own, and the largest of any other entry of its codebook."""
    out = gathered.copy()
    for p, (a, b) in enumerate(zip(old, new, strict=True)):
        moves = np.array([math.sqrt(sum((u - v) ** 2 for u, v in zip(x, y, strict=True))) for x, y in zip(a, b, strict=True)]) * (1 + MARGIN)
        order = np.argsort(moves)
        other = np.full(len(moves), moves[order[-1]])
        other[order[-1]] = moves[order[-2]] if len(moves) > 1 else 0.0
        out[p] = (out[p] + moves + other) * (1 + MARGIN * 1e-3)
    return out


def heap_codes(
    df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dim: int = 64, id: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = 4096
) -> DataFrame:
    """Per valid vector: id, code (two hex digits a part), error (squared), label_error (summed over equal labels) and codebooks_sha256.

    At most 256 entries a codebook; they start as the parts of the vectors of the smallest ids. The rounds end early
    when no entry moves.
    """
    if dim % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide the dimension, and a codebook has 1 to 256 entries")
    spark, width = df.sparkSession, dim // parts
    kept = valid(df.select(id, label, vector), vector, dim)
    first = kept.orderBy(F.col(id).asc_nulls_last(), vector).limit(entries).collect()
    start = quantised(np.array([r[vector] for r in first], np.float64).reshape(-1, dim), scale).tolist()
    kind = kept.schema[id].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"`{id}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    size = len(start)
    books = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]

    with Scratch(spark) as scratch:
        passes = Rounds(kept, scratch, dim, scale, width, block_rows)
        counts, sums = [0] * (parts * size), [[0] * width for _ in range(parts * size)]
        drift = np.zeros((parts, size))
        for _ in range(rounds):
            now = Books([integers(b, width) for b in books], drift)
            totals = passes.step(lambda block, changes, now=now: visited(block, changes, now)[0])
            for key, t in totals.items():
                counts[key] += t.n
                sums[key] = [a + b for a, b in zip(sums[key], t.v, strict=True)]
            moved = [[[s // counts[k] for s in sums[k]] if counts[k] else books[p][k - p * size] for k in range(p * size, (p + 1) * size)] for p in range(parts)]
            drift = drifted(drift, books, moved)
            settled = moved == books
            books = moved
            if settled:
                break
        now = Books([integers(b, width) for b in books], drift)

        def last(block: Block, now: Books = now) -> list[pa.Array]:
            _, labels = visited(block, None, now, dump=False)
            error: np.ndarray | int = 0
            for p, found in enumerate(labels):
                x, own = block.x[:, p * width : (p + 1) * width], now.entries[p][found]
                small = x.dtype != object and own.dtype != object and dim * (2 * max(int(np.abs(x).max()), int(np.abs(own).max()))) ** 2 < 1 << 62
                apart = x - own if small else x.astype(object) - own.astype(object)
                error = error + (apart * apart).sum(1)
            digits = np.stack(labels, 1).astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            return [pa.array(codes, pa.string()), as_long(error)]

        coded = staged(passes.rows_of(last, "code string, error long", ["code", "error"]), "heap-coded")
        total, missing = F.sum(F.col("error").cast("decimal(38,0)")), F.max(F.col("error").isNull())
        by_label = coded.groupBy(F.col(label).alias("of")).agg(F.when(~missing & (total <= F.lit(2**63 - 1)), total.cast("bigint")).alias("label_error"))
        by_label = staged(by_label, "heap-labels")
        if by_label.count() * 40 <= BROADCAST_BYTES:
            by_label = F.broadcast(by_label)
        result = coded.join(by_label, F.col(label).eqNullSafe(F.col("of")))
        return scratch.kept(result.select(id, "code", "error", "label_error", F.lit(sha256([e for b in books for e in b])).alias("codebooks_sha256")), "heap-result")
