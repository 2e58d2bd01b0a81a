"""Mixture-controlled packing: deficit round-robin over source queues, solved in closed form.

Every source is a queue of tokens with a target share. A window of W tokens credits each queue its share
of the window; queues send in turn, whole tokens, and what rounding leaves over is a deficit that a queue
carries to the next window, over as many windows as it takes: a queue with a share of less than one token a
window sends one every few windows. A queue that runs dry leaves the round, and the shares of the others
grow in proportion, so every window but the last is full. Targets are given by source, or are the sources'
shares of all tokens. Sources without a target follow when those with one are empty, in proportion to their
tokens.

Between two queues running dry, every queue sends a known number of tokens in proportion. Queues settle in
a balanced tree: of what two halves have sent together, the left half's part is its share, rounded down, and
the right half's the rest. Both only grow, so places never run backwards however small a share is, and a
deficit stays under one token a level of the tree. No state passes from window to window: where a token
lands follows from its place in its queue, in steps as many as the tree has levels. ``Rounds`` holds the
numbers of tokens, one a queue and stretch. Sources beyond the ``MOST_QUEUES`` largest share as many queues,
dealt by hash.

Places come from prefix sums. One pass tokenises each text once, writes the ids to the shared folder and
counts, within each task, the tokens before each document in its queue. Sums by task and source (partial
aggregation), and a running total over the tasks, give every document its place. Documents are never
shuffled, so a hot source costs no more than others, and deficits carry across windows and partitions.

Edge cases: a null or empty text is the end token alone. A null source is a queue of its own. Very long
texts are cut into many windows. Repeated rows are packed as often as they occur. An empty table gives
an empty result. Only the id, text and source columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import WordHasher, utf8
from .common import Scratch, join_small, slices, staged

#: Sources with a queue of their own: their names and numbers of tokens are known to the driver and every task.
MOST_QUEUES = 1 << 16

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class WordIds:
    """Little-endian id bytes of texts; words are tokenised once while they are remembered.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in a
    row. Nor does it merge a Latin letter with punctuation after it, so a word is a stem and a tail. A stem of
    Latin letters is one run for the splitter, and the ids of a run end with one that ends a word, so many
    such stems are tokenised as one text. İ is none of them, as its lower case ends with a combining mark.
    Everything else goes through the tokenizer by itself; strings of its special tokens give their ids.
    """

    TAIL = b"*$%&#!,.;|?:"
    #: 1 for ASCII letters, 2 for bytes of a tail, else 0.
    _KINDS = np.array([1 if bytes([c]).isalpha() else 2 if c in b"*$%&#!,.;|?:" else 0 for c in range(256)], np.uint8)

    def __init__(self, path: str, end_id: int, most: int = 600_000, most_parts: int = 450_000, most_long: int = 8 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its share
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.end, self.most = np.array([end_id], self.kind).tobytes(), most
        #: Short words are bounded by their number, words of over 64 bytes by their bytes. What is remembered grows old
        #: when it reaches the bound, and what is not asked for before the next time is forgotten: twice the bounds at most.
        self.most_parts, self.most_long, self.long = most_parts, most_long, 0
        self.ends_word = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_parts: dict[bytes, bytes] = {}
        self.hasher = WordHasher(2, lower=False)

    @staticmethod
    def _plain(stem: str) -> bool:
        return stem.isalpha() and max(stem) < "\u0250" and "\u0130" not in stem

    def _alone(self, part: bytes) -> bytes:
        return np.array(self.tok.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()

    def _split(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes, bytes, bool]]:
        """(word, stem, tail, whether the stem is Latin letters alone). Stems of ASCII letters are in lower case."""
        text = b" ".join(words)
        lower, lengths = text.lower(), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        kinds = self._KINDS[np.frombuffer(text, np.uint8)]
        letters = np.concatenate([[0], np.cumsum(kinds == 1)])
        # ASCII letters and then a tail: no other byte, and no letter after another kind of byte.
        breaks = kinds == 0
        breaks[1:] |= (kinds[1:] == 1) & (kinds[:-1] != 1)
        breaks = np.concatenate([[0], np.cumsum(breaks)])
        simple = (kinds[starts] == 1) & (breaks[ends] == breaks[starts + 1])
        cuts = starts + letters[ends] - letters[starts]
        for word, start, cut, end, ok in zip(words, starts.tolist(), cuts.tolist(), ends.tolist(), simple.tolist(), strict=True):
            if ok:
                yield word, lower[start:cut], text[cut:end], True
                continue
            stem = word.rstrip(self.TAIL)
            s = stem.decode("utf-8", "replace")
            if plain := self._plain(s):
                stem = stem.lower() if stem.isascii() else stem
            elif not (s and self._plain(s[-1])):
                stem = word
            yield word, stem, word[len(stem) :], plain

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of words."""
        if not words:
            return
        split = list(self._split(words))
        parts, old = self.parts, self.old_parts
        for _, stem, _, _ in split:
            if stem not in parts and (found := old.get(stem)) is not None:
                parts[stem] = found
        names = list(dict.fromkeys(stem for _, stem, _, plain in split if plain and stem not in parts))
        for i in range(0, len(names), 2000):
            ids = np.array(self.tok.encode_batch_fast([b" ".join(names[i : i + 2000]).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = (self.width * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw, at = ids.astype(self.kind).tobytes(), 0
            for name, end in zip(names[i : i + 2000], ends, strict=True):
                parts[name] = raw[at:end]
                at = end
        known, part = self.words, parts.get
        for word, stem, tail, _ in split:
            found = part(stem)
            if found is None:
                found = parts[stem] = self._alone(stem)
            if tail:
                if (more := part(tail)) is None:
                    more = parts[tail] = self._alone(tail)
                found += more
            known[word] = found
            if len(word) > 64:
                self.long += len(word) + len(found)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text and the end id. Words are parted at ASCII white space only."""
        joined, starts, ends, (h, h2), first = self.hasher.words(texts)
        if not len(h):
            return [self.end] * len(texts)
        # Equal words have equal hashes; one of each is looked up.
        order = np.argsort(h)
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        some = order[new]
        words = [joined[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        if len(self.words) > self.most or self.long > self.most_long:
            self.old_words, self.words, self.long = self.words, {}, 0
            self.old_parts, self.parts = self.parts, {}
        elif len(self.parts) > self.most_parts:
            self.old_parts, self.parts = self.parts, {}
        known, old, new = self.words, self.old_words, []
        for w in words:
            if w not in known:
                found = old.get(w)
                if found is None:
                    new.append(w)
                else:
                    known[w] = found
                    if len(w) > 64:
                        self.long += len(w) + len(found)
        self.learn(new)
        ids = list(map(self.words.__getitem__, words))
        which, bounds = which.tolist(), first.tolist()
        return [b"".join(map(ids.__getitem__, which[a:b])) + self.end for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(1)
def remembered(path: str, end_id: int) -> WordIds:
    """The ids of words, kept from task to task of a Python worker. Its bounds hold over all of them."""
    return WordIds(path, end_id)


def tokenized(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, task, before (tokens before it in this task's part of its source), n, ids (uint16 or uint32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        words = remembered(path, end_id)
        width = words.width
        task, sent = TaskContext.get().partitionId(), {}
        for batch in slices(batches, 1024):
            data = words.encode(utf8(batch.column(1)))
            n = [len(x) // width for x in data]
            before = []
            for s, m in zip(batch.column(2).to_pylist(), n, strict=True):
                before.append(sent.get(s, 0))
                sent[s] = before[-1] + m
            arrays = [batch.column(0), batch.column(2), pa.array([task] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "task", "before", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    return staged(rows.mapInArrow(run, "doc_id long, source string, task int, before long, n long, ids binary"), "packing-ids")


def queues(parts: DataFrame, targets: Mapping[str | None, float] | None, most: int) -> tuple[list[tuple[str | None, int, Fraction]], list[int]]:
    """The sources with a queue of their own as (source, tokens, weight), in a fixed order, and the tokens of the queues that the others share.

    ``most`` bounds what is read here: the largest sources, and those that a target names.
    """
    by_source = staged(parts.groupBy("source").agg(F.sum("n").alias("n")), "packing-sources")
    large = {r["source"]: r["n"] for r in by_source.orderBy(F.desc("n"), "source").limit(most).collect()}
    if targets is None:
        weights = {s: Fraction(n) for s, n in large.items()}
    else:
        whole = sum(Fraction(t) for t in targets.values() if t > 0)
        weights = {s: (Fraction(t) / whole).limit_denominator(10**9) for s, t in targets.items() if t > 0}
        named = parts.sparkSession.createDataFrame([(s,) for s in weights], "wanted string")
        large |= {r["source"]: r["n"] for r in by_source.join(F.broadcast(named), by_source["source"].eqNullSafe(named["wanted"])).collect()}
    own = sorted(large.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    shared: list[int] = []
    if by_source.count() > len(own):
        shared = [0] * most
        named = parts.sparkSession.createDataFrame([(s,) for s in large], "wanted string")
        others = by_source.join(F.broadcast(named), by_source["source"].eqNullSafe(named["wanted"]), "left_anti")
        for r in others.groupBy(_share(most).alias("share")).agg(F.sum("n").alias("n")).collect():
            shared[r["share"]] = r["n"]
    return [(s, n, weights.get(s, Fraction(0))) for s, n in own], shared


def _share(most: int):
    return F.pmod(F.xxhash64("source"), F.lit(most))


class Rounds:
    """Deficit round-robin of queues of ``sizes`` tokens by ``weights``; queues without a weight follow when all others are empty."""

    def __init__(self, sizes: list[int], weights: list[Fraction], window: int):
        self.window, self.sizes, self.total = window, sizes, sum(sizes)
        sent, fluid = [0] * len(sizes), [Fraction(0)] * len(sizes)
        active = [i for i, n in enumerate(sizes) if n and weights[i]]
        waiting = [i for i, n in enumerate(sizes) if n and not weights[i]]
        rate: Mapping[int, Fraction] = dict(enumerate(weights))
        #: For each stretch: its last token, and running totals over the queues of what they send in it and have sent before it.
        self.stretches: list[tuple[int, list[int], list[int]]] = []
        while active or waiting:
            if not active:
                active, waiting, rate = waiting, [], {i: Fraction(n) for i, n in enumerate(sizes)}
            lasts = min((sizes[i] - fluid[i]) / rate[i] for i in active)
            before = sent[:]
            for i in active:
                fluid[i] += lasts * rate[i]
                sent[i] = int(fluid[i])
            active = [i for i in active if fluid[i] < sizes[i]]
            moved = [b - a for a, b in zip(before, sent, strict=True)]
            if any(moved):
                self.stretches.append((sum(sent), [0, *accumulate(moved)], [0, *accumulate(before)]))
        self.lasts = [s[0] for s in self.stretches]
        self._cached: dict[int, tuple[int, tuple[int, int, int, int]]] = {}

    def _until(self, x: int, q: int) -> tuple[int, int]:
        """Of the first ``x`` tokens, those that the queues before ``q`` have sent, and those of ``q``."""
        if not self.stretches:
            return 0, 0
        last, totals, before = self.stretches[min(bisect_left(self.lasts, x), len(self.lasts) - 1)]
        s = x - last + totals[-1]
        low, high, ahead = 0, len(self.sizes), 0
        while high - low > 1:
            middle = (low + high) // 2
            both = totals[high] - totals[low]
            left = s * (totals[middle] - totals[low]) // both if both else 0
            if q < middle:
                high, s = middle, left
            else:
                low, s, ahead = middle, s - left, ahead + left
        return ahead + before[q], s + before[q + 1] - before[q]

    def span(self, w: int, q: int) -> tuple[int, int, int]:
        """(first token, token after the last, place of the first in the window) of what queue ``q`` sends in window ``w``."""
        cached = self._cached.get(q)
        if cached is None or cached[0] != w:
            start = cached[1][2:] if cached is not None and cached[0] == w - 1 else self._until(min(w * self.window, self.total), q)
            cached = w, (*start, *self._until(min((w + 1) * self.window, self.total), q))
            self._cached[q] = cached
        ahead, first, ahead_after, after = cached[1]
        return first, after, ahead_after - ahead

    def window_of(self, q: int, at: int) -> int:
        """The window in which token ``at`` of queue ``q`` is sent."""
        cached = self._cached.get(q)
        if cached is not None and cached[1][1] <= at < cached[1][3]:
            return cached[0]
        last, totals, sent, own = next(
            (last, totals, sent, own) for last, totals, before in self.stretches if at < (sent := before[q + 1] - before[q]) + (own := totals[q + 1] - totals[q])
        )
        guess = (last - totals[-1] + (at - sent) * totals[-1] // own) // self.window
        end = -(-self.total // self.window) - 1
        low = high = min(max(guess, 0), end)
        step = 1
        while low > 0 and self._until(low * self.window, q)[1] > at:
            high, low, step = low, max(0, low - step), 2 * step
        step = 1
        while high < end and self._until((high + 1) * self.window, q)[1] <= at:
            low, high, step = high + 1, min(end, high + step), 2 * step
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self._until(min((middle + 1) * self.window, self.total), q)[1] > at else (middle + 1, high)
        return low


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    window: int = 4096,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    targets: Mapping[str | None, float] | None = None,
    most_queues: int = MOST_QUEUES,
) -> DataFrame:
    """Pieces of all documents in windows of ``window`` tokens, PIECE_SCHEMA. ``targets`` are shares by source; by default the sources' shares of all tokens."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.kept(_pack(docs, path, end_id, window, key, text, source, targets, most_queues), "packing-pieces")


def _pack(docs: DataFrame, path: str, end_id: int, window: int, key: str, text: str, source: str, targets: Mapping[str | None, float] | None, most_queues: int) -> DataFrame:
    spark = docs.sparkSession
    ids = tokenized(docs, path, end_id, key, text, source)
    parts = staged(ids.groupBy("task", "source").agg(F.sum("n").alias("n")), "packing-parts")
    own, shared = queues(parts, targets, most_queues)
    if not own:
        return spark.createDataFrame([], PIECE_SCHEMA)
    sizes = [n for _, n, _ in own] + shared
    weights = [w for _, _, w in own] + [Fraction(n if targets is None else 0) for n in shared]
    rounds = Rounds(sizes, weights, window)
    named = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(own)], "source string, queue long")
    by_queue = parts.join(F.broadcast(named), parts["source"].eqNullSafe(named["source"]), "left").select(
        parts["task"], parts["source"], "n", F.coalesce("queue", F.lit(len(own)) + F.pmod(F.xxhash64(parts["source"]), F.lit(most_queues))).alias("queue")
    )
    # The running total over tasks has a row a task and queue; within them, the rest's sources are put in a row.
    tasks = by_queue.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("queue", "task", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("task_at"))
    inner = Window.partitionBy("queue", "task").orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    places = by_queue.withColumn("inner_at", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(tasks, ["queue", "task"])
    places = staged(
        places.select("task", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"), "queue", (F.col("task_at") + F.col("inner_at")).alias("at")), "packing-places"
    )
    placed = join_small(ids.withColumns({"s": F.coalesce("source", F.lit("")), "no_s": F.col("source").isNull()}), places, ["task", "s", "no_s"], "inner", 64)
    placed = placed.select("doc_id", "source", "queue", (F.col("at") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]):
        kinds = [pa.int64()] * 7 + [pa.string()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        span, crc = rounds.span, zlib.crc32
        for batch in batches:
            rows = []
            for doc, name, q, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = memoryview(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes())
                w, done = rounds.window_of(q, at), 0
                while done < n:
                    first, after, place = span(w, q)
                    take = min(n - done, after - at - done)
                    if take > 0:
                        # A window holds what its queues send, one after another.
                        rows.append((doc, done, take, crc(raw[4 * done : 4 * (done + take)]), n, w, place + at + done - first, name))
                        done += take
                        w += 1
                    else:
                        w = rounds.window_of(q, at + done)
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return placed.mapInArrow(run, PIECE_SCHEMA)
