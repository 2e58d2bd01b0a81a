"""Near-duplicate documents by bottom-k sketches of one hash function, with exact verification.

1. Each text becomes its set of hashed word shingles; the k smallest values are its sketch. Documents
   with equal sets form a class, and only its smallest id goes on.
2. The sketch values form inverted lists. A value in at most ``cold`` lists' entries links all of them,
   and the number of shared values is a pair's overlap. Counts come first (partial aggregation), so no
   long list is ever gathered.
3. The union-sketch estimate filters: the values of both sketches up to the lesser of their largest are
   a uniform sample of the union, so a pair at the threshold shares at least ``least_share`` of k of them
   (0.45 for 0.8 and k = 64 fails once in about 10^10 such pairs; for sets that lie whole in their
   sketches the bound is the threshold itself and certain). A pair is dropped only if its overlap, and as
   many hot values as either has, cannot reach that.
4. A pair may be missed there only if all values that it shares are hot; both documents then have at
   least that share of hot values (a set that lies whole in its sketch less, as its partner's may drop some). These few documents are joined exactly: their whole sets are ordered
   by rarity among them, and a pair at the threshold shares a value of the prefixes of length
   n - ceil(t n) + 1. Long prefix lists first link to their most central member, the one with the least
   share of values that few others have, then to members picked by hash; after the components are
   known, only pairs of different components that share a value are left, and all are verified.
5. Every candidate pair is verified on the whole sets, and components give each document its group.

Edge cases: texts without words (null and empty ones too) have no shingles and are linked with nothing.
Texts with fewer words than a shingle have one shingle, the whole sequence. Rows that share an id are one
document, so different texts of an id are linked; a null id forms no link by near copies. Very long texts are shingled whole. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_small, slices, staged
from .graph import components


@dataclass(frozen=True)
class Similarity:
    shingle: int = 5
    #: Link at 100 * intersection >= percent * union.
    percent: int = 80
    k: int = 64
    least_share: float = 0.45
    #: An inverted list of at most so many entries is expanded to pairs.
    cold: int = 32
    #: Rounds of stars around members picked by hash.
    stars: int = 2


class _WordHashes(dict):
    """64-bit hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of a text's shingles as sorted 63-bit hashes. Bytes' lower() and split() know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = (h ^ w[i : len(w) - size + 1 + i]) * _M
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def signatures(docs: DataFrame, p: Similarity) -> DataFrame:
    """id, n (size of the set), set_key (null without shingles), sketch (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            sets = [shingles(t, p.shingle) for t in batch.column(1).to_pylist()]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([s[: p.k] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "set_key", "sketch"])

    return docs.mapInArrow(run, "id long, n long, set_key binary, sketch array<long>")


def _sizes_allow(a: str, b: str, p: Similarity):
    return (100 * F.least(a, b)) >= (p.percent * F.greatest(a, b))


#: 64-bit words of the bitmap over a set's met values.
BITMAP_WORDS = 16
BITS = [f"b{i}" for i in range(BITMAP_WORDS)]


def _bits_allow(na, nb, ma, mb, bits: list[tuple], p: Similarity):
    """Whether two sets' bitmaps leave room for the intersection that the threshold asks for."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in bits), F.lit(0))
    return (ma + mb - differ) >= 2 * F.ceil(F.lit(p.percent) * (na + nb) / (100 + p.percent))


def _met_allow(na: str, nb: str, met, p: Similarity):
    """Whether an intersection of at most ``met`` can reach the threshold."""
    return (100 * met >= p.percent * (F.col(na) + F.col(nb) - met)) & _sizes_allow(na, nb, p)


def _pairs_of_list(members: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of the members of short lists: a bounded array a list, expanded to (a, b) of ordered ids."""
    lists = members.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("id", "n", "hot"))).alias("m"))
    pairs = lists.select(
        F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p")
    )
    return pairs.select(F.col("p.x.id").alias("a"), F.col("p.y.id").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"), F.least("p.x.hot", "p.y.hot").alias("hot"))


def sketch_pairs(sketches: DataFrame, p: Similarity) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) by shared cold values, and the ids whose shared values may all be hot."""
    values = sketches.select("id", "n", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    counts = staged(counts, "near-values")
    multi = staged(join_small(values, counts, ["v"], "inner", 24), "near-postings")
    hot = multi.where(F.col("df") > p.cold).groupBy("id").agg(F.count("*").cast("int").alias("hot"))
    hot = staged(hot, "near-hot")
    cold = join_small(multi.where(F.col("df") <= p.cold), hot, ["id"], "left", 24).select("id", "n", F.coalesce("hot", F.lit(0)).alias("hot"), "v")
    overlap = _pairs_of_list(cold, ["v"]).where(_sizes_allow("na", "nb", p)).groupBy("a", "b", "na", "nb", "hot").agg(F.count("*").alias("overlap"))
    whole = F.greatest("na", "nb") <= p.k
    need = F.when(whole, F.ceil(F.lit(p.percent) * F.greatest("na", "nb") / 100)).otherwise(F.lit(math.floor(p.least_share * p.k)))
    pairs = overlap.where(F.col("overlap") + F.col("hot") >= need).select("a", "b")
    # Whole sets at the threshold share at least that part of their own values, less what the sketch of the
    # largest partner drops; sampled ones the least share.
    most = F.floor(100 * F.col("n") / p.percent)
    sketched = F.floor(F.lit(p.percent) * (F.col("n") + most) / (100 + p.percent)) - F.greatest(most - p.k, F.lit(0))
    certain = F.least(F.floor(F.lit(p.percent) * F.col("n") / 100), sketched)
    enough = F.when(F.col("n") <= p.k, certain).otherwise(F.lit(math.floor(p.least_share * p.k)))
    risky = hot.join(multi.select("id", "n").distinct(), "id").where(F.col("hot") >= enough).select("id")
    return pairs, risky


def prefix_postings(docs: DataFrame, p: Similarity) -> DataFrame:
    """(v, id, n, met, central): the rarest values of whole sets, as many as a pair at the threshold cannot all leave unshared.

    Only ``met`` values of a set occur in another one; a set that has too few of them has no pair, and
    the lesser of two counts bounds their intersection. A bitmap of them bounds it more tightly: two sets
    differ in at least as many values as their bitmaps differ in bits. ``central`` is the share, by 1000, of
    values in long lists.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            sets = [shingles(t, p.shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "s"])

    values = docs.mapInArrow(run, "id long, n long, s array<long>").select("id", "n", F.explode("s").alias("v"))
    values = staged(values, "near-whole")
    counts = values.groupBy("v").agg(F.count("*").alias("df"))
    ordered = Window.partitionBy("id").orderBy("df", "v")
    length = F.col("n") - F.ceil(F.lit(p.percent) * F.col("n") / 100) + 1
    ranked = staged(values.join(counts, "v").withColumn("place", F.row_number().over(ordered)), "near-ranked")
    bit = F.expr("shiftleft(1L, CAST(v & 63 AS INT))")
    word = F.shiftright("v", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    by_id = ranked.where("df > 1").groupBy("id").agg(
        F.count("*").alias("met"),
        F.sum((F.col("df") > p.cold).cast("long")).alias("common"),
        *[F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"b{i}") for i in range(BITMAP_WORDS)],
    )
    postings = ranked.where((F.col("place") <= length) & (F.col("df") > 1)).join(by_id, "id").where(100 * F.col("met") >= p.percent * F.col("n"))
    return postings.select("v", "id", "n", "met", (F.col("common") * 1000 / F.col("n")).cast("int").alias("central"), *BITS)


def verify(pairs: DataFrame, texts: DataFrame, p: Similarity) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the threshold. ``texts`` is (id, text) of every id in them."""
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]):
        last, own = None, None
        for batch in slices(batches):
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last or own is None:
                    last, own = a, shingles(ta, p.shingle)
                other = shingles(tb, p.shingle)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(shared > 0 and 100 * shared >= p.percent * (len(own) + len(other) - shared))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _star(members: DataFrame, order, p: Similarity) -> DataFrame:
    """Pairs (a, b) of each list's least member by ``order`` with its members of other labels."""
    heads = members.groupBy("v").agg(F.min_by(F.struct("id", "n", "met", "label", *BITS), order).alias("head"))
    joined = members.join(heads, "v").where("label <> head.label").withColumn("nh", F.col("head.n")).where(_met_allow("n", "nh", F.least("met", "head.met"), p))
    joined = joined.where(_bits_allow(F.col("n"), F.col("nh"), F.col("met"), F.col("head.met"), [(F.col(c), F.col(f"head.{c}")) for c in BITS], p))
    return joined.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct()


def _unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the lists that have more than one label."""
    placed = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    apart = placed.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("v")
    return placed.join(apart, "v", "left_semi")


def _together(out: DataFrame, every: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows of ``out`` (doc_id, n_shingles, component_id) under the ids that they were given: a component is named by its least, and each row of ``every`` is one."""
    own = staged(out.join(apart.withColumnsRenamed({"id": "was", "own": "doc_id"}), "doc_id", "left").select(F.coalesce("was", "doc_id").alias("id"), "n_shingles", "component_id"), "near-own")
    least = staged(own.groupBy("component_id").agg(F.min("id").alias("least")), "near-least")
    found = staged(join_small(own, least, ["component_id"], "left", 24), "near-named")
    rows = join_small(every.where("id IS NOT NULL"), found.select("id", "least").distinct(), ["id"], "left", 24).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return rows.unionByName(found.where("id IS NULL").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id")))


def near_duplicates(docs: DataFrame, p: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the group), kept (it is that document)."""
    with Scratch(docs.sparkSession) as own:
        return own.kept(_near_duplicates(docs, p, key, text), "near-result")


def _apart(docs: DataFrame, signed: DataFrame, p: Similarity) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents and signatures in which every different text of an id has an id of its own, and (id, own) of these new ids; None where no id has two texts.

    New ids are negative, below all others, so that they meet none.
    """
    key = F.coalesce("set_key", F.lit(b""))
    several = signed.where("id IS NOT NULL").groupBy("id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("id")
    several = staged(several, "near-several")
    if several.isEmpty():
        return docs, signed, None
    least = min(signed.agg(F.min("id")).first()[0], 0)
    texts = join_small(docs, several, ["id"], "left_semi", 16).distinct()
    texts = staged(texts.select("id", (F.lit(least - 1) - F.monotonically_increasing_id()).alias("own"), "text"), "near-apart")
    rows = texts.select(F.col("own").alias("id"), "text")
    others = join_small(docs, several, ["id"], "left_anti", 16).unionByName(rows)
    signed = staged(join_small(signed, several, ["id"], "left_anti", 16).unionByName(signatures(rows, p)), "near-signatures")
    return others, signed, texts.select("id", "own")


def _near_duplicates(docs: DataFrame, p: Similarity, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    every = staged(signatures(rows, p), "near-signatures")
    docs, signed, apart = _apart(rows, every, p)
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copied = staged(classes.where("copies > 1").select("set_key", "rep"), "near-classes")
    members = join_small(signed.select("id", "n", "set_key"), copied, ["set_key"], "left", 32)
    members = staged(members.select("id", "n", F.coalesce("rep", "id").alias("rep")), "near-members")
    repeated = members.where("id <> rep").select("id").distinct()
    sketches = join_small(signed.where("n > 0 AND id IS NOT NULL").select("id", "n", "sketch"), staged(repeated, "near-repeated"), ["id"], "left_anti", 16)

    pairs, risky = sketch_pairs(sketches, p)
    pairs, risky = staged(pairs, "near-pairs"), staged(risky, "near-risky")
    wanted = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(risky).distinct(), "near-wanted")
    texts = staged(join_small(docs, wanted, ["id"], "left_semi", 16).dropDuplicates(["id"]), "near-texts")
    postings = staged(prefix_postings(join_small(texts, risky, ["id"], "left_semi", 16), p), "near-prefixes")

    # Prefix lists: short ones give all pairs, long ones a star around their most central member.
    lists = staged(postings.groupBy("v").agg(F.count("*").alias("entries")).where("entries > 1"), "near-lists")
    entries = staged(join_small(postings, lists, ["v"], "inner", 24), "near-entries")
    short = _pairs_of_list(entries.where(F.col("entries") <= p.cold).withColumn("hot", F.col("met")), ["v"]).where(_met_allow("na", "nb", F.col("hot"), p)).select("a", "b")
    long_lists = entries.where(F.col("entries") > p.cold).drop("entries")
    unlabelled = long_lists.withColumn("label", F.col("id"))
    star = _star(unlabelled, F.struct(-F.col("central"), "id"), p)
    tried = staged(pairs.union(short).union(star).distinct(), "near-candidates")
    links = verify(tried, texts, p)
    if apart is not None:
        # The classes that the texts of one id lie in are linked.
        places = apart.join(members.select(F.col("id").alias("own"), "rep"), "own").select("id", "rep")
        heads = places.groupBy("id").agg(F.min("rep").alias("a"))
        links = links.union(places.join(heads, "id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    links = staged(links, "near-links")
    labels = components(links)

    # More stars where a long list still has several components, around members picked by hash.
    for seed in range(p.stars):
        placed = _unsettled(long_lists, labels)
        star = staged(_star(placed, F.struct(F.xxhash64("id", F.pmod("v", F.lit(4)), F.lit(seed)), "id"), p).join(tried, ["a", "b"], "left_anti"), "near-star")
        if star.isEmpty():
            break
        tried, more = tried.union(star), staged(verify(star, texts, p), "near-more")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links, labels)

    # What the stars leave: all pairs of a long list that lie in different components.
    left = staged(_unsettled(long_lists, labels), "near-left")
    x = left.select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("met").alias("ma"), F.col("label").alias("la"), *[F.col(c).alias(f"x{c}") for c in BITS])
    y = left.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("met").alias("mb"), F.col("label").alias("lb"), *[F.col(c).alias(f"y{c}") for c in BITS])
    room = _bits_allow(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), [(F.col(f"x{c}"), F.col(f"y{c}")) for c in BITS], p)
    cross = x.join(y, (x["v"] == y["v"]) & (x["a"] < y["b"]) & (x["la"] != y["lb"]) & _met_allow("na", "nb", F.least("ma", "mb"), p) & room).select("a", "b").distinct()
    rest = staged(cross.join(tried, ["a", "b"], "left_anti"), "near-rest")
    more = staged(verify(rest, texts, p), "near-more")
    if not more.isEmpty():
        labels = components(links.union(more), labels)

    out = join_small(members, labels.select(F.col("id").alias("rep"), "label"), ["rep"], "left", 24)
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    if apart is not None:
        out = _together(out, every, apart)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
