"""Columns of numbers in compressed blobs for exchanges, and words of texts as hashes, by numpy.

An exchange of many small rows costs a row header, a sort entry and a conversion each. Operators that
exchange numbers send one blob a task and bucket instead: columns split into byte planes (so that equal high
bytes lie together) and compressed. A bucket is a partition of the exchange, so its size is that of a
shuffle partition.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; longer texts are cut between words.
CHUNK = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
#: Odd bases of the two word hashes, and their inverses modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def pack(*columns: np.ndarray) -> bytes:
    """The columns, all of one length, as a compressed blob."""
    import zstandard

    n = len(columns[0])
    kinds = "".join(c.dtype.char for c in columns).encode()
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T).tobytes() for c in columns]
    return struct.pack("<IB", n, len(kinds)) + kinds + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n, k = struct.unpack_from("<IB", blob)
    kinds = [np.dtype(chr(c)) for c in blob[5 : 5 + k]]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5 + k :], max_output_size=max(1, n * sum(d.itemsize for d in kinds))), np.uint8)
    out, at = [], 0
    for d in kinds:
        part = raw[at : at + n * d.itemsize].reshape(d.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(d).reshape(n))
        at += n * d.itemsize
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bucket_of(m: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of evenly spread 64-bit numbers; it never falls as they rise."""
    return ((m >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def blobs_by_bucket(order_key: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of rows sorted by an evenly spread key."""
    if not len(order_key):
        return
    held = bucket_of(order_key, buckets)
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(held)], strict=True):
        yield int(held[a]), pack(*(c[a:b] for c in columns))


def dealt(blobs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, blob) in as many partitions as there are buckets, each in its own."""
    return blobs.repartitionById(buckets, F.col("bucket"))


def exchange_width(df: DataFrame) -> int:
    """How many buckets an exchange has: ``spark.sql.shuffle.partitions``, which the cluster sets by its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


class WordHasher:
    """Words of texts (runs of characters other than ASCII white space, A-Z in lower case unless said otherwise) as 64-bit hashes.

    A hash is a polynomial of a word's bytes modulo 2 ** 64, spread by a bijection. With two bases the
    pair has 128 bits: that two different words share it is as good as excluded, but for words built to.
    """

    def __init__(self, hashes: int = 1, lower: bool = True):
        self.powers, self.lower = [Powers(b) for b in _BASES[:hashes]], lower

    def lines(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(line of each word, its hashes, first line of each text): lines are counted over all texts."""
        _, starts, _, hashes, _, breaks = self._all(texts)
        # The line of a word is how many breaks lie before it. Breaks are few, so words are counted up to each.
        line = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts) + 1)[: len(starts)])
        counts = np.fromiter((1 + (t or b"").count(b"\n") for t in texts), np.int64, len(texts))
        return line, hashes, np.concatenate([[0], np.cumsum(counts)])

    def words(self, texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(all bytes, start, end and hashes of each word there, first word of each text)."""
        joined, starts, ends, hashes, offsets, _ = self._all(texts)
        return joined, starts, ends, hashes, np.searchsorted(starts, offsets)

    def _all(self, texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        joined = b"\n".join([t or b"" for t in texts])
        offsets = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
        at, found = 0, []
        while at < len(joined):
            end = min(at + CHUNK, len(joined))
            # A chunk ends at white space, or where the word at its end does.
            while end < len(joined) and _IS_WORD[joined[end]]:
                end += 1
            part = joined[at:end]
            starts, ends, hashes, breaks = self._chunk(np.frombuffer(part.translate(_LOWER) if self.lower else part, np.uint8))
            found.append((starts + at, ends + at, breaks + at, *hashes))
            at = end
        if not found:
            none = np.empty(0, np.int64)
            return joined, none, none, [np.empty(0, np.uint64) for _ in self.powers], offsets, none
        starts, ends, breaks, *hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        return joined, starts, ends, hashes, offsets, breaks

    def _chunk(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        word = np.zeros(len(part) + 2, bool)
        word[1:-1] = _IS_WORD[part]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        hashes = []
        values = part.astype(np.uint64) + np.uint64(1)
        for p in self.powers:
            p.reach(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values * p.up[: len(part)], out=sums[1:])
            hashes.append(mixed((sums[ends] - sums[starts]) * p.down[starts]))
        return starts, ends, hashes, np.flatnonzero(part == 10)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The bytes of a column of texts, without making strings of them."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
