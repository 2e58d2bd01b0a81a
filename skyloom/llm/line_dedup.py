"""Line dedup: an exact set-similarity join over lines' token sets; a line that matches an earlier one is removed.

Lines are ordered by document id, then place. A line is removed when an earlier line has an equal token
set, or one with a Jaccard similarity of the threshold or more, whether or not that one is removed too.

1. Tokens (words, ASCII letters in lower case) are counted over all texts. The most frequent ones, at
   most ``ranked`` of them, get their rank; all rarer tokens come before them. That is one order for all
   lines, so the prefix filter holds exactly, and what is sent to the tasks has a fixed bound.
2. Lines with equal sets are one class, kept by its first line; partial aggregation meets common lines.
   Sets are equal when their sizes and sums of 128-bit word hashes are, which shorter keys do not decide.
3. Sets at the threshold share a token of their prefixes of n - ceil(t n) + 1 rarest tokens. Lines that
   share one are joined under the length, positional and bitmap filters: a line's bitmap has the parities
   of its tokens' bits, so two sets differ in at least as many tokens as their bitmaps differ in bits.
4. Postings go to their lists in one exchange of compressed columns. A task walks the sorted lists of its
   bucket. A line whose best earlier line there leaves so much room under the filters that it is as good as
   certain gets that candidate alone, so a large group of near copies gives a candidate a line; any other
   line gets all earlier lines that pass. The list of a token of more than ``hot`` occurrences is dealt out
   by classes of set size: sets at the threshold lie in one class or in neighbouring ones.
5. Candidates are verified on the real words. Should a lone candidate fail and leave its line unmatched,
   that line is joined with all earlier lines of its lists under the same filters, and all are verified.

Edge cases: null and empty texts have no lines, and lines without a word are never removed. Lines of fewer
than ``min_tokens`` distinct tokens are never removed or matched; by default there are none such. Sets too
small to be near another one (up to 3 tokens at 80 %) meet equal sets only and send no postings. Equal
lines within a document keep the first. Repeated rows keep the same lines, as one document; rows with a
null id are passed through. Very long texts are processed whole, a stretch at a time. An empty table gives
an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import WordHasher, blobs_by_bucket, dealt, exchange_width, mixed, unpack, utf8
from .common import Scratch, join_small, slices, staged


@dataclass(frozen=True)
class LineRules:
    percent: int = 80
    min_tokens: int = 1
    #: Most tokens that are ranked by frequency; all others count as equally rare.
    ranked: int = 1 << 17
    #: Lists of tokens of more occurrences are dealt out by size classes.
    hot: int = 1 << 20
    #: Lists of at most so many entries are walked together, longer ones one at a time.
    short: int = 16
    #: Pairs of a longer list that are looked at together.
    block: int = 1 << 20


#: Order keys: ranked tokens have RANKED and their rank, all rarer ones bits of their hash.
HASH_BITS = 44
RANKED = 1 << HASH_BITS
#: A task counts so many words before it sends their counts on.
COUNTED = 4 << 20


class Ranks:
    """Ranks of token hashes in two tables of slots. A token that finds both slots taken by more frequent ones counts as rare."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray, hot_rank: int):
        self.hot_key = RANKED | hot_rank
        self.bits = max(4, int(2 * max(1, len(hashes)) - 1).bit_length())
        self.tables = []
        order = np.argsort(-ranks, kind="stable")
        left_h, left_r = hashes[order], ranks[order]
        for way in range(2):
            keys, values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            slots = self._slots(left_h, way)
            _, won = np.unique(slots, return_index=True)
            keys[slots[won]], values[slots[won]] = left_h[won], left_r[won]
            lost = np.ones(len(left_h), bool)
            lost[won] = False
            left_h, left_r = left_h[lost], left_r[lost]
            self.tables.append((keys, values))

    def _slots(self, h: np.ndarray, way: int) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits) if way == 0 else h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Order keys of token hashes."""
        rank = np.zeros(len(h), np.int64)
        for way, (keys, values) in enumerate(self.tables):
            slots = self._slots(h, way)
            rank += np.where(keys[slots] == h, values[slots], 0)
        return np.where(rank > 0, rank | RANKED, (h & np.uint64(RANKED - 1)).astype(np.int64))


def _run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]])[: len(x)])


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n): the counts over all texts of token hashes that occur twice or more."""
    width = exchange_width(docs)

    def count(batches: Iterator[pa.RecordBatch]):
        hasher, held, many = WordHasher(1), [], 0

        def flush():
            h = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            starts = _run_starts(h)
            rows = list(blobs_by_bucket(h[starts], [h[starts], np.diff(np.append(starts, len(h)))], width))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

        for batch in slices(batches):
            _, (h,), _ = hasher.lines(utf8(batch.column(0)))
            held.append(h)
            many += len(h)
            if many > COUNTED:
                yield flush()
                held, many = [], 0
        yield flush()

    def total(batches: Iterator[pa.RecordBatch]):
        parts = [unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not parts:
            return
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        starts = _run_starts(h)
        sums = np.add.reduceat(n, starts)
        held = sums > 1
        yield pa.RecordBatch.from_arrays([pa.array(h[starts][held].view(np.int64)), pa.array(sums[held])], ["h", "n"])

    return dealt(docs.select("text").mapInArrow(count, "bucket int, blob binary"), width).mapInArrow(total, "h long, n long")


def frequent_tokens(docs: DataFrame, rules: LineRules) -> Ranks:
    """Ranks, from 1 in order of rising counts, of at most ``rules.ranked`` most frequent tokens, by counts over all texts."""
    with Scratch(docs.sparkSession):
        counts = staged(token_counts(docs), "lines-counts")
        # The least count that no more than ``ranked`` tokens reach, from the counts of counts.
        by_count, total, least = counts.groupBy("n").count().orderBy(F.desc("n")), 0, None
        for r in by_count.toLocalIterator():
            total += r["count"]
            if total > rules.ranked:
                break
            least = r["n"]
        rows = counts.where(F.col("n") >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    h, n = rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    order = np.lexsort((h, n))
    return Ranks(h[order].view(np.uint64), np.arange(1, len(h) + 1), 1 + int(np.count_nonzero(n <= rules.hot)))


#: Words of the bitmap of a line's tokens.
BITS = ["bits0", "bits1"]
LINE_SCHEMA = "doc_id long, line int, n int, k1 long, k2 long, " + "".join(f"{b} long, " for b in BITS) + "again boolean, prefix array<long>"


def line_sets(docs: DataFrame, rules: LineRules, ranks: Ranks) -> DataFrame:
    """A row for each line of enough tokens: its size, set key (k1, k2), bitmap, prefix, and whether its document has it before."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]):
        ranks, hasher = sent.value, WordHasher(2)
        names = ["doc_id", "line", "n", "k1", "k2", *BITS, "again", "prefix"]
        for batch in slices(batches, 256):
            line, (h, h2), first = hasher.lines(utf8(batch.column(1)))
            if not len(h):
                continue
            key = ranks.keys(h)
            if line[-1] < 1 << (63 - HASH_BITS - 1):
                at = (line << (HASH_BITS + 1)) | key
                order = np.argsort(at)
                at = at[order]
                # Different tokens of one key in a line (they share bits of their hashes) must not lie mixed.
                mixed_up = np.any((at[1:] == at[:-1]) & (h[order][1:] != h[order][:-1]))
            else:
                mixed_up = True
            if mixed_up:
                order = np.lexsort((h, key, line))
            line, key, h, h2 = line[order], key[order], h[order], h2[order]
            new = np.concatenate([[True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])])
            line, key, h, h2 = line[new], key[new], h[new], h2[new]
            starts = _run_starts(line)
            n = np.diff(np.append(starts, len(line)))
            enough = n >= rules.min_tokens
            if not enough.all():
                token_held = np.repeat(enough, n)
                line, key, h, h2 = line[token_held], key[token_held], h[token_held], h2[token_held]
                n = n[enough]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            if not len(n):
                continue
            k1, k2 = (np.add.reduceat(x, starts).view(np.int64) for x in (h, h2))
            # Each token turns over one bit of one word.
            bit, word = np.uint64(1) << (h2 & np.uint64(63)), (h2 >> np.uint64(6)) & np.uint64(len(BITS) - 1)
            bits = [pa.array(np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), starts).view(np.int64)) for w in range(len(BITS))]
            # A set that even one token more takes below the threshold matches equal sets only: it has no prefix.
            length = np.where(100 * n < rules.percent * (n + 1), 0, n - (-(-rules.percent * n // 100)) + 1)
            held = np.arange(len(key)) - np.repeat(starts, n) < np.repeat(length, n)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[held]))
            own = line[starts]
            row = np.searchsorted(first, own, side="right") - 1
            again = np.zeros(len(own), bool)
            groups = np.lexsort((own, k2, k1, row))
            same = (row[groups][1:] == row[groups][:-1]) & (k1[groups][1:] == k1[groups][:-1]) & (k2[groups][1:] == k2[groups][:-1])
            again[groups[1:][same]] = True
            arrays = [batch.column(0).take(pa.array(row)), pa.array((own - first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(k1), pa.array(k2), *bits, pa.array(again), prefix]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return staged(docs.mapInArrow(run, LINE_SCHEMA), "lines-sets")


def _near(a: str, b: str, p: LineRules):
    """Length, positional and bitmap filters as a condition between the columns of two postings."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    # 100 o >= percent (na + nb - o), so this many tokens must be shared at least.
    need = F.ceil(F.lit(p.percent) * (na + nb) / (100 + p.percent))
    ia, ib = F.col(f"{a}.pos"), F.col(f"{b}.pos")
    reach = F.least(ia, ib) + 1 + F.least(na - ia - 1, nb - ib - 1)
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITS), F.lit(0))
    return (100 * F.least(na, nb) >= p.percent * F.greatest(na, nb)) & (reach >= need) & (apart <= na + nb - 2 * need)


def candidates(firsts: DataFrame, p: LineRules, ranks: Ranks) -> DataFrame:
    """(da, la, db, lb, sure): pairs of an earlier and a later line that pass the filters; ``sure`` ones are the only candidate of their line in a list."""
    width, t, hot_key = exchange_width(firsts), p.percent, ranks.hot_key
    ratio = 0.99 * np.log(100 / t)

    def send(batches: Iterator[pa.RecordBatch]):
        held, many = [], 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.argsort(columns[0])
            rows = list(blobs_by_bucket(columns[0][order], [c[order] for c in columns], width))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            prefix = batch.column("prefix")
            ends = prefix.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            token = prefix.values.to_numpy()[ends[0] : ends[-1]]
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(token)) - np.repeat(ends[:-1] - ends[0], sizes)
            n = batch.column("n").to_numpy()[row]
            listed = mixed(token)
            hot = token >= hot_key
            if hot.any():
                # A hot token's list is one of its size class, with the members of the class below as guests.
                at = np.flatnonzero(hot)
                kind = np.floor(np.log(n[at]) / ratio).astype(np.uint64)
                listed[at] = mixed(listed[at] + kind)
                row, pos, n, listed = np.append(row, row[at]), np.append(pos, pos[at]), np.append(n, n[at]), np.append(listed, mixed(mixed(token[at]) + kind + np.uint64(1)))
            held.append([listed, batch.column("doc_id").to_numpy()[row], batch.column("line").to_numpy()[row], n.astype(np.int32), pos.astype(np.int32), *(batch.column(b).to_numpy()[row] for b in BITS)])
            many += len(row)
            if many > 1 << 19:
                yield flush()
                held, many = [], 0
        if many:
            yield flush()

    def passing(c: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows i and j, and their room, that pass the positional, then the bitmap filter; their lengths have passed. A repeated row is no match of itself."""
        other = (c["doc_id"][i] != c["doc_id"][j]) | (c["line"][i] != c["line"][j])
        i, j = i[other], j[other]
        na, nb = c["n"][i], c["n"][j]
        need = -(-t * (na + nb) // (100 + t))
        ia, ib = c["pos"][i], c["pos"][j]
        ok = np.minimum(ia, ib) + np.minimum(na - ia, nb - ib) >= need
        i, j, most = i[ok], j[ok], (na + nb - 2 * need)[ok]
        for b in BITS:
            most = most - np.bitwise_count((c[b][i] ^ c[b][j]).view(np.uint64))
            ok = most >= 0
            i, j, most = i[ok], j[ok], most[ok]
        return i, j, most

    def walk(c: dict) -> pa.RecordBatch:
        """The candidates of whole lists, sorted by list and place."""
        token, n = c["token"], c["n"]
        low, high, enough = t * n, 100 * n, 2 + n // 20
        room = np.full(len(token), -1)
        found = [(np.empty(0, np.int64),) * 3]

        def keep(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> None:
            np.maximum.at(room, j, most)
            found.append((i, j, most))

        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        small = np.repeat(sizes <= p.short, sizes)
        for gap in range(1, int(sizes[sizes <= p.short].max(initial=1))):
            i = np.flatnonzero((token[gap:] == token[:-gap]) & (high[gap:] >= low[:-gap]) & (high[:-gap] >= low[gap:]) & small[gap:])
            if len(i):
                keep(*passing(c, i, i + gap))
        for start, size in zip(starts[sizes > p.short].tolist(), sizes[sizes > p.short].tolist(), strict=True):
            open_, at, width = np.arange(start + 1, start + size), start, 4
            while at < start + size - 1 and len(open_):
                heads = np.arange(at, min(at + width, start + size))
                at, width = int(heads[-1]) + 1, max(1, min(4 * width, p.block // len(open_)))
                similar = (high[open_][None] >= low[heads][:, None]) & (high[heads][:, None] >= low[open_][None]) & (open_[None] > heads[:, None])
                i, j = np.nonzero(similar)
                keep(*passing(c, heads[i], open_[j]))
                open_ = open_[(open_ > at) & (room[open_] < enough[open_])]
        i, j, most = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((i, -most, j))
        i, j = i[order], j[order]
        sure = room[j] >= enough[j]
        held = ~sure | np.concatenate([[True], j[1:] != j[:-1]])[: len(j)]
        i, j, sure = i[held], j[held], sure[held]
        return pa.RecordBatch.from_arrays([pa.array(c["doc_id"][i]), pa.array(c["line"][i]), pa.array(c["doc_id"][j]), pa.array(c["line"][j]), pa.array(sure)], ["da", "la", "db", "lb", "sure"])

    names = ["token", "doc_id", "line", "n", "pos", *BITS]

    def meet(batches: Iterator[pa.RecordBatch]):
        parts = [unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not parts:
            return
        c = dict(zip(names, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
        del parts
        order = np.lexsort((c["line"], c["doc_id"], c["token"]))
        starts = _run_starts(c["token"][order])
        # Lists are walked some 200,000 entries at a time, and whole.
        cuts = [0, *starts[np.flatnonzero(np.diff(starts // 200_000)) + 1].tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = {k: v[order[a:b]] for k, v in c.items()}
            yield walk(own | {k: own[k].astype(np.int64) for k in ("n", "pos")})

    blobs = firsts.select("doc_id", "line", "n", *BITS, "prefix").mapInArrow(send, "bucket int, blob binary")
    found = dealt(blobs, width).mapInArrow(meet, "da long, la int, db long, lb int, sure boolean")
    return found.groupBy("da", "la", "db", "lb").agg(F.max("sure").alias("sure"))


def verify(pairs: DataFrame, docs: DataFrame, p: LineRules) -> DataFrame:
    """The later lines (doc_id, line) of ``pairs`` (da, la, db, lb) whose token sets reach the threshold."""
    wanted = staged(pairs.select(F.col("da").alias("doc_id"), F.col("la").alias("line")).union(pairs.select("db", "lb")).distinct(), "lines-wanted")
    ids = staged(wanted.select("doc_id").distinct(), "lines-wanted-docs")

    def split(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, 256):
            own, places, sets = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                for place, line in enumerate((text or b"").lower().split(b"\n")):
                    if line and not line.isspace():
                        own.append(doc)
                        places.append(place)
                        sets.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(places, pa.int32()), pa.array(sets, pa.binary())], ["doc_id", "line", "words"])

    lines = join_small(docs, ids, ["doc_id"], "left_semi", 16).mapInArrow(split, "doc_id long, line int, words binary")
    lines = staged(join_small(lines, wanted, ["doc_id", "line"], "left_semi", 24), "lines-words")
    a = lines.select(F.col("doc_id").alias("da"), F.col("line").alias("la"), F.col("words").alias("wa"))
    b = lines.select(F.col("doc_id").alias("db"), F.col("line").alias("lb"), F.col("words").alias("wb"))
    joined = pairs.join(b, ["db", "lb"]).join(a, ["da", "la"]).select("db", "lb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ok = []
            for wa, wb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = set(wa.split()), set(wb.split())
                shared = len(x & y)
                ok.append(100 * shared >= p.percent * (len(x) + len(y) - shared))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["doc_id", "line"])

    return joined.mapInArrow(run, "doc_id long, line int").distinct()


def removed_lines(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line) of every line that an earlier one matches; ``line`` counts \\n-split lines from 0. Reads staged tables."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    ranks = frequent_tokens(docs, rules)
    lines = line_sets(docs, rules, ranks)
    own = lines.where("NOT again")
    copied = own.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copied = staged(copied, "lines-classes")
    placed = join_small(own, copied, ["n", "k1", "k2"], "left", 40)
    repeats = placed.where("first_doc < doc_id").select("doc_id", "line")
    firsts = placed.where("(first_doc IS NULL OR first_doc = doc_id) AND size(prefix) > 0").select("doc_id", "line", "n", *BITS, "prefix")

    tried = staged(candidates(firsts, rules, ranks), "lines-candidates")
    settled = staged(verify(tried.drop("sure"), docs, rules), "lines-settled")

    # Lines whose lone candidate fails meet all earlier lines of their lists.
    left = staged(tried.where("sure").select(F.col("db").alias("doc_id"), F.col("lb").alias("line")).distinct().join(settled, ["doc_id", "line"], "left_anti"), "lines-left")
    near = settled
    if not left.isEmpty():
        postings = firsts.select("doc_id", "line", "n", *BITS, F.posexplode("prefix").alias("pos", "token"))
        later = staged(join_small(postings, left, ["doc_id", "line"], "left_semi", 24), "lines-later")
        lists = staged(later.select("token").distinct(), "lines-lists")
        members = join_small(postings, lists, ["token"], "left_semi", 16)
        pairs = members.alias("a").join(later.alias("b"), (F.col("a.token") == F.col("b.token")) & _earlier("a", "b") & _near("a", "b", rules))
        pairs = staged(_ends(pairs).distinct().join(tried.drop("sure"), ["da", "la", "db", "lb"], "left_anti"), "lines-pairs")
        near = settled.union(verify(pairs, docs, rules))

    # Copies of a line, near or not, are removed as copies of its first place.
    return repeats.union(lines.where("again").select("doc_id", "line")).union(near)


def _earlier(a: str, b: str):
    return (F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id")) | ((F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.line") < F.col(f"{b}.line")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a.doc_id").alias("da"), F.col("a.line").alias("la"), F.col("b.doc_id").alias("db"), F.col("b.line").alias("lb"))


def removed_by_document(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, removed): the sorted places of each document's removed lines, staged; documents without any are absent."""
    with Scratch(docs.sparkSession) as own:
        gone = removed_lines(docs, rules, key, text)
        return own.kept(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed")), "lines-removed")


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the removed lines cut out of the text, and their number as ``n_removed_lines``.

    Texts and places meet by a shuffle at every size: places grow with the texts, so a broadcast would hold for small inputs alone.
    """
    gone = removed_by_document(docs, rules, key, text).withColumnRenamed("doc_id", "__gone_id").withColumnRenamed("removed", "__gone")
    joined = docs.join(gone.hint("merge"), docs[key].cast("long") == gone["__gone_id"], "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False)))
    cut = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({text: cut, "n_removed_lines": F.coalesce(F.array_size("__gone"), F.lit(0))}).select(*docs.columns, "n_removed_lines")


def line_report(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places of the removed lines) of every document."""
    gone = removed_by_document(docs, rules, key, text)
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n", -1)))
    counts = docs.select(F.col(key).cast("long").alias("doc_id"), lines.cast("long").alias("n_lines"))
    out = counts.join(gone, "doc_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.array_size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
