"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

1. Texts are split into words by the tokenizer's pattern in Arrow batches. A block of documents gives its
   distinct words, dealt into buckets by hash, and a layout: which words its texts have, in order.
2. Words of up to SHARD blocks meet by bucket, so that each is folded once a shard. A fold over a word
   (``aggregate`` over the pieces' bounds) merges the lowest-ranked adjacent pair, leftmost first, until
   none is left. Ranks come from a literal map, hashed into buckets so that a lookup costs one bucket.
3. The ids of a block's words return to its layout, which strings the words of each document together.
   Decoding takes the ids' binary pieces, one after another, as Arrow lays them out.

Exchanges carry compressed arrays, a row a block and bucket: about the size of the distinct words. Texts
are not shuffled, and layouts lie in a table bucketed by block, so neither are they. A shard's bucket has
at most SHARD blocks' words, so hot words, sources and groups of copies cost no more than others.

Edge cases: a null or empty text has no ids; its decoded bytes are empty. Very long texts form a block of
their own; memory follows one text. A fold looks at all pieces a step, so words of more than LONG bytes are
merged in the same order with a heap, in n log n steps, next to where words meet. Repeated rows give equal
rows; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import exchange_width, pack, unpack
from .common import release_memory, shared_dir

BUCKETS = 1 << 15
#: A block of documents is closed once its texts have so many characters.
BLOCK_CHARS = 8 << 20
#: Words are folded once for so many blocks, and dealt into so many buckets.
SHARD = 64
WORD_BUCKETS = 256
#: Longer words, in bytes, are merged with a heap.
LONG = 256

_LITERALS: dict = {}


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(piece, rank) of a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(bytes.strip, f))]


def _as_literal(df: DataFrame) -> Column:
    """The only value of a one-row, one-column plan as a literal."""
    jvm = df.sparkSession._jvm
    row = df._jdf.queryExecution().executedPlan().executeCollect()[0]
    kind = df._jdf.schema().apply(0).dataType()
    value = row.copy().get(0, kind)
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def rank_literal(spark: SparkSession, path: str) -> Column:
    """The rank map as array<map<binary,int>> by bucket."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _LITERALS:
        ranks = spark.createDataFrame(read_ranks(path), "piece binary, rank int")
        by_bucket = (
            ranks.groupBy(_bucket(F.col("piece")).alias("b"))
            .agg(F.map_from_entries(F.collect_list(F.struct("piece", "rank"))).alias("m"))
            .join(spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")), "b", "right")
            .select(F.struct("b", F.coalesce("m", F.create_map().cast("map<binary,int>")).alias("m")).alias("x"))
        )
        # Maps cannot be sorted, so entries are carried as arrays until they are in order.
        entries = by_bucket.select(F.struct(F.col("x.b").alias("b"), F.map_entries("x.m").alias("e")).alias("x"))
        rank_map = entries.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.map_from_entries(x["e"])).alias("v"))
        _LITERALS[key] = _as_literal(rank_map)
    return _LITERALS[key]


def _bucket(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(BUCKETS))


def encode_word(word: Column, ranks: Column) -> Column:
    """Ids of one word given as binary: its own rank, or a fold of merges over its bytes.

    The state is the pieces' bounds: the first byte of each piece, and one past the end. A step looks up
    the rank of every two adjacent pieces (null where they do not merge) and removes the bound inside the
    leftmost of the lowest rank; without any, the state stays.
    """

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(ranks, F.pmod(F.hash(piece), F.lit(BUCKETS))), piece)

    def piece_ranks(bounds: Column, apart: int) -> Column:
        """Ranks of what lies between bounds so many places apart; null at the end."""
        return F.zip_with(bounds, F.slice(bounds, 1 + apart, n + 1), lambda a, c: rank(F.substring(word, a, c - a)))

    def step(bounds: Column, _: Column) -> Column:
        # A one-element transform binds the ranks, so they are computed once.
        merged = F.transform(
            F.array(piece_ranks(bounds, 2)),
            lambda r: F.array_remove(bounds, F.get(bounds, F.array_position(r, F.array_min(r)).cast("int"))),
        )
        return F.coalesce(F.get(merged, F.lit(0)), bounds)

    n = F.octet_length(word)
    folded = F.aggregate(F.sequence(F.lit(2), n), F.sequence(F.lit(1), n + 1), step, lambda last: F.array_compact(piece_ranks(last, 1)))
    whole = F.transform(F.array(rank(word)), lambda r: r)
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.when(F.get(whole, F.lit(0)).isNotNull(), whole).otherwise(folded))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the merges of the fold, lowest rank and leftmost first, with a heap of pairs."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def offer(i: int) -> None:
        """The pair of the piece at ``i`` and its neighbour; the place past the neighbour tells whether it still holds."""
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _pack_bytes(sizes: np.ndarray, data: bytes) -> bytes:
    """Byte strings, given by sizes and put together, as a compressed blob."""
    head, body = pack(sizes.astype(np.int32)), pack(np.frombuffer(data, np.uint8))
    return struct.pack("<I", len(head)) + head + body


def _unpack_bytes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    (k,) = struct.unpack_from("<I", blob)
    return unpack(blob[4 : 4 + k])[0], unpack(blob[4 + k :])[0]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _large_binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


def _spaced(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Each word's ids as decimal text, a space before each."""
    said = pc.binary_join_element_wise("", pa.array(ids, pa.int32()).cast(pa.string()), " ").cast(pa.large_string())
    offsets = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1]
    return _large_binary(offsets[starts], said.buffers()[2] or pa.py_buffer(b""))


def _decoded(ids: np.ndarray, starts: np.ndarray, ranks: dict[bytes, int]) -> pa.Array:
    """Each word's bytes: its ids' pieces put together."""
    pieces: list[bytes] = [b""] * (1 + max(ranks.values()))
    for piece, rank in ranks.items():
        pieces[rank] = piece
    taken = pa.array(pieces, pa.large_binary()).take(pa.array(ids, pa.int32()))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    return _large_binary(offsets[starts], taken.buffers()[2] or pa.py_buffer(b""))


def _bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """``df`` in a table of the shared folder that lies bucketed by ``column``; the catalog forgets its name at once."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/skyloom/{table}").bucketBy(buckets, column).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The id and the asked outputs: n_tokens, ids (array<int>), decoded (binary), ids_sha256, decoded_sha256."""
    source = docs.select(key, text)
    key_kind = source.schema[key].dataType.simpleString()
    ranks = rank_literal(docs.sparkSession, path)

    sent = docs.sparkSession.sparkContext.broadcast(dict(read_ranks(path)))

    def split(batches: Iterator[pa.RecordBatch]):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        after_space = re.compile(r"\s ").search
        names = ["block", "shard", "bucket", "keys", "layout", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), None, pa.binary(), pa.binary()]
        part, numbers = TaskContext.get().partitionId(), count()

        def block(keys, texts):
            # A space after a character that is none parts words for sure, so texts are cut there first and
            # the pattern runs over distinct chunks. A first chunk, and a text with spaces after white
            # space, is a chunk of its own kind: a tuple, without the space before it.
            chunks: dict = defaultdict(count().__next__)
            lengths, places = [], []
            for t in texts:
                if after_space(t):
                    own = [(t,)]
                else:
                    own = t.split(" ")
                    own[0] = (own[0],)
                lengths.append(len(own))
                places.append(np.fromiter(map(chunks.__getitem__, own), np.int32, len(own)))
            words: dict[str, int] = defaultdict(count().__next__)
            ends, flat = [], []
            for chunk in chunks:
                flat += map(words.__getitem__, find(chunk[0] if type(chunk) is tuple else " " + chunk))
                ends.append(len(flat))
            data = [w.encode("utf-8") for w in words]
            buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in data), np.int32, len(data))
            order = np.argsort(buckets, kind="stable")
            at = np.empty(len(order), np.int32)
            at[order] = np.arange(len(order), dtype=np.int32)
            number = next(numbers)
            own_block, shard = part << 32 | number, part // SHARD << 32 | number
            # Chunks are numbered by falling counts, so that most numbers are small.
            spots = np.concatenate(places) if places else np.empty(0, np.int32)
            by_count = np.argsort(-np.bincount(spots, minlength=len(chunks)), kind="stable")
            ranked = np.empty(len(by_count), np.int32)
            ranked[by_count] = np.arange(len(by_count), dtype=np.int32)
            sizes, starts = np.diff(ends, prepend=0)[by_count], np.concatenate([[0], ends]).astype(np.int64)[by_count]
            new_ends = np.cumsum(sizes)
            moved = np.arange(len(flat)) + np.repeat(starts - new_ends + sizes, sizes)
            layout = [pack(ranked[spots]), pack(np.array(lengths, np.int32)), pack(new_ends.astype(np.int32)), pack(at[np.array(flat, np.int64)[moved]])]
            cuts = np.searchsorted(buckets[order], np.arange(WORD_BUCKETS + 1)).tolist()
            rows = [(own_block, shard, -1, keys.to_pylist(), b"".join(struct.pack("<I", len(x)) + x for x in layout), None)]
            for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if i < j:
                    own_words = [data[k] for k in order[i:j].tolist()]
                    rows.append((own_block, shard, b, None, None, _pack_bytes(np.fromiter(map(len, own_words), np.int32, j - i), b"".join(own_words))))
            kinds[3] = pa.list_(keys.type)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            # What the last block took is given back before the next is built.
            release_memory()
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            start = chars = 0
            for i, t in enumerate(texts):
                if i > start and chars + len(t) > block_chars:
                    yield block(keys.slice(start, i - start), texts[start:i])
                    start, chars = i, 0
                chars += len(t)
            if texts:
                yield block(keys.slice(start), texts[start:])

    def meet(rows: pa.Table) -> pa.Table:
        """The distinct words of a shard's bucket, long ones merged and last, and where each block has them."""
        found: dict[bytes, int] = defaultdict(count().__next__)
        refs, sizes = [], []
        for blob in rows.column("words").to_pylist():
            lens, data = _unpack_bytes(blob)
            raw, ends = data.tobytes(), _offsets(lens).tolist()
            refs.append(np.fromiter((found[raw[i:j]] for i, j in zip(ends, ends[1:], strict=False)), np.int32, len(lens)))
            sizes.append(len(lens))
        words = list(found)
        late = np.array([len(w) > LONG for w in words])
        at = np.empty(len(words), np.int32)
        at[np.argsort(late, kind="stable")] = np.arange(len(words), dtype=np.int32)
        one = [rows.column("bucket")[0].as_py(), rows.column("block").to_pylist(), pack(np.array(sizes, np.int32)), pack(at[np.concatenate(refs)]), [w for w in words if len(w) <= LONG], [merge_long(w, sent.value) for w in words if len(w) > LONG]]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32()))]
        return pa.table([pa.array([x], k) for x, k in zip(one, kinds, strict=True)], names=["bucket", "blocks", "sizes", "refs", "words", "long_ids"])

    width = exchange_width(docs)
    blocks = source.mapInArrow(split, f"block long, shard long, bucket int, keys array<{key_kind}>, layout binary, words binary")
    blocks = _bucketed(blocks, "block", width, "bpe_blocks")
    layouts = blocks.where("bucket < 0").select("block", "keys", "layout")
    met = blocks.where("bucket >= 0").select("block", "shard", "bucket", "words").groupBy("shard", "bucket")
    met = met.applyInArrow(meet, "bucket int, blocks array<long>, sizes binary, refs binary, words array<binary>, long_ids array<array<int>>")
    held = ["bucket", "blocks", "sizes", "refs"]
    folded = met.select(*held, F.concat(F.transform("words", lambda w: encode_word(w, ranks)), "long_ids").alias("ids"))

    def scatter(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, blocks, (sizes,), (refs,) = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), unpack(batch.column(2)[r].as_py()), unpack(batch.column(3)[r].as_py())
                ids = batch.column(4)[r].values
                cuts, rows = _offsets(sizes).tolist(), []
                for i, j in zip(cuts, cuts[1:], strict=False):
                    own = ids.take(pa.array(refs[i:j]))
                    counts = pack(pc.list_value_length(own).to_numpy())
                    rows.append(struct.pack("<I", len(counts)) + counts + pack(own.flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["block", "bucket", "words"])

    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def gather(layout: pa.Table, words: pa.Table) -> pa.Table:
        raw, at, arrays = layout.column("layout")[0].as_py(), 0, []
        while at < len(raw):
            (k,) = struct.unpack_from("<I", raw, at)
            arrays += unpack(raw[at + 4 : at + 4 + k])
            at += 4 + k
        places, lengths, chunk_ends, flat = arrays
        keys = layout.column("keys").combine_chunks().values
        parts = []
        for _, blob in sorted(zip(words.column("bucket").to_pylist(), words.column("words").to_pylist(), strict=True)):
            (k,) = struct.unpack_from("<I", blob)
            parts.append((*unpack(blob[4 : 4 + k]), *unpack(blob[4 + k :])))
        counts, ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int32),) * 2
        starts = _offsets(counts)
        ends, chunk_at = _offsets(lengths), np.concatenate([[0], chunk_ends]).astype(np.int64)
        own_words, at = pa.array(flat), pa.array(places)

        def laid_out(values: pa.Array) -> tuple[memoryview, np.ndarray]:
            """Words' values put together by chunk, and chunks side by side in the order of the texts: bytes and offsets."""
            by_word = values.take(own_words)
            spots = np.frombuffer(by_word.buffers()[1], np.int64)[: len(by_word) + 1]
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk_at) - 1, [None, pa.py_buffer(np.ascontiguousarray(spots[chunk_at])), by_word.buffers()[2] or pa.py_buffer(b"")])
            taken = chunks.take(at)
            offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
            return memoryview(taken.buffers()[2] or b""), offsets[ends]

        arrays = []
        for name in outputs:
            if name == "n_tokens":
                by_chunk = _offsets(np.diff(starts)[flat])[chunk_at]
                totals = _offsets(np.diff(by_chunk)[places])
                arrays.append(pa.array(np.diff(totals[ends]), pa.int64()))
            elif name == "ids":
                raw, spots = laid_out(_large_binary(starts * 4, pa.py_buffer(ids)))
                arrays.append(pa.array([np.frombuffer(raw[a:b], np.int32) for a, b in zip(spots, spots[1:])], pa.list_(pa.int32())))
            else:
                skip = int(name == "ids_sha256")
                raw, spots = laid_out(_spaced(ids, starts) if skip else _decoded(ids, starts, sent.value))
                parts = [raw[a + skip * (b > a) : b] for a, b in zip(spots, spots[1:])]
                arrays.append(pa.array([bytes(x) for x in parts], pa.binary()) if name == "decoded" else pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()))
        out = pa.table([keys, *arrays], names=[key, *outputs])
        release_memory()
        return out

    scattered = folded.mapInArrow(scatter, "block long, bucket int, words binary")
    out = f"`{key}` {key_kind}, " + ", ".join(f"{n} {kinds[n][0]}" for n in outputs)
    return layouts.groupBy("block").cogroup(scattered.groupBy("block")).applyInArrow(gather, out)
