"""Benchmark decontamination over a distributed positional inverted index, by DataFrame functions alone.

The index holds a posting (document, term, position) for every word of a document that is a term of some
test item, and a heading a document with its number of words. It is built by one pass over the texts without a
shuffle: documents are shards, and a shard's postings stay where its text was read. Windows of the items are
looked up from their rarest terms: the list of the rarest is met with that of the second rarest at its offset,
once for all windows that share this pair, and what is left with the lists of all other terms. Lists are met
on (document, term, position), so no key is hot, however common a term, a passage or a document is.

Words are the runs of ``WORDS``, with A-Z in lower case. A position counts from 1.

Edge cases: a null or empty text, or one without a word, has no words and is neither hit nor an item that
could occur. An item of fewer words than a window is one window. Repeated rows of documents each give a row,
rows that share an id but not their text are told apart by the text's hash, and null ids are ids like others.
Items that share an id are one item; windows of a null item id hit words but count as no item. Very long texts
and items are taken whole. Empty tables give an empty result, or documents without hits. Columns other than id
and text are not read, so their names cannot clash. Ids are numbers or strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, join_small, staged

#: The words before their ASCII letters are put in lower case: digits, letters and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a document's heading in the index; its position is the document's number of words.
HEADING = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ["doc", "text_hash"]


def words(text: str) -> Column:
    """The words of a text, not yet in lower case; none for a null."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))


def lowered(word: str) -> Column:
    """A word with A-Z in lower case and all else as it is; words of ASCII alone take the fast way."""
    w = F.col(word)
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, a staged table, marked for broadcast if the sum of its rows' bytes is within BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


@dataclass(frozen=True)
class PhraseIndex:
    """``postings`` (doc, text_hash, term, pos) with headings, ``terms`` (word, term), ``counts`` (term, n)."""

    postings: DataFrame
    terms: DataFrame
    counts: DataFrame
    id: str


def item_windows(items: DataFrame, size: int = 10, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, gram): every run of ``size`` words of an item, or all of its words where it has fewer."""
    split = items.select(F.col(id).alias("item"), words(text).alias("ws")).where(F.size("ws") > 0)
    split = split.select("item", F.transform("ws", lambda w: F.translate(w, _UPPER, _LOWER)).alias("ws"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("gram"))


def build_index(docs: DataFrame, vocabulary: DataFrame, id: str = "doc_id", text: str = "text") -> PhraseIndex:
    """The index of ``docs`` over the words of ``vocabulary`` (word), staged in the shared folder.

    The vocabulary is broadcast when its bytes are few, else tokens meet it by a shuffle.
    """
    terms = staged(vocabulary.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "phrase-terms")
    known = terms.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(HEADING).cast("bigint").alias("term")))
    own = F.col(id)
    shards = docs.select(
        # A null id is an id of its own: the hash tells it from the id that stands for it.
        F.coalesce(own, F.lit(0).cast(docs.schema[id].dataType)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), own.isNull()).alias("text_hash"),
        F.concat(F.array(F.lit("")), words(text)).alias("ws"),
        own.isNull().alias("null_id"),
    )
    tokens = shards.select("doc", "text_hash", "null_id", (F.size("ws") - 1).alias("n"), "ws").select("doc", "text_hash", "null_id", "n", F.posexplode("ws").alias("at", "raw"))
    tokens = tokens.select("doc", "text_hash", "null_id", "n", "at", lowered("raw").alias("word"))
    found = tokens.join(_small(known, 64 + F.octet_length("word")), "word")
    heading = F.col("term") == HEADING
    postings = staged(found.select("doc", "text_hash", "term", F.when(heading, F.col("n")).otherwise(F.col("at")).alias("pos"), (heading & F.col("null_id")).alias("null_id")), "phrase-postings")
    counts = staged(postings.where(~heading).groupBy("term").agg(F.count("*").alias("n")), "phrase-counts")
    return PhraseIndex(postings, terms, counts, id)


def plans(index: PhraseIndex, windows: DataFrame) -> DataFrame:
    """(window, plan): the terms of every window (window, gram) as (n, off, term), the rarest in the documents first; windows of an absent term go."""
    entries = windows.select("window", F.size("gram").alias("size"), F.posexplode("gram").alias("off", "word")).join(index.terms, "word").join(index.counts, "term")
    listed = entries.groupBy("window", "size").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("plan"))
    return listed.where(F.size("plan") == F.col("size")).select("window", "plan")


def _held(wanted: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Rows (doc, text_hash, term, want) for which the term stands within ``slop`` of the wanted position. A row may come twice."""
    width = 2 * slop + 1
    bins = F.array_distinct(F.array(F.floor((F.col("want") - slop) / width), F.floor((F.col("want") + slop) / width)))
    lists = postings.select(*_DOC, "term", F.floor(F.col("pos") / width).alias("bin"), F.col("pos").alias("there"))
    left, right = wanted.withColumn("bin", F.explode(bins)).alias("l"), lists.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*_DOC, "term", "bin")]
    near = F.abs(F.col("l.want") - F.col("r.there")) <= slop
    return left.join(right, [*same, near], "left_semi").drop("bin")


def matches(index: PhraseIndex, plan: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, text_hash, window, start, end) of every place where a window's terms stand: exactly, or each within ``slop`` of its place.

    ``end`` is exclusive; with a slop, both count from the place of the rarest term. ``plan`` should be staged.
    """
    lists = index.postings.where(F.col("term") != HEADING).select(*_DOC, "term", "pos")
    first, second = F.col("plan")[0], F.get(F.col("plan"), F.lit(1))
    keyed = plan.select("window", "plan", first["term"].alias("t1"), F.coalesce(second["term"], F.lit(HEADING)).alias("t2"), F.coalesce(second["off"] - first["off"], F.lit(0)).alias("apart"))
    keyed = staged(keyed, "phrase-keyed")
    pairs = staged(keyed.select("t1", "t2", "apart").distinct(), "phrase-pairs")
    rarest = join_small(lists, pairs.select(F.col("t1").alias("term")), ["term"], "left_semi", 16)
    # Rows of documents may repeat; a place is looked up once.
    seen = join_small(rarest.distinct().withColumnRenamed("term", "t1"), pairs, ["t1"], "inner", 32)
    alone, both = seen.where(F.col("t2") == HEADING), seen.where(F.col("t2") != HEADING)
    partners = join_small(lists, pairs.select(F.col("t2").alias("term")), ["term"], "left_semi", 16)
    both = _held(both.withColumn("want", F.col("pos") + F.col("apart")).withColumn("term", F.col("t2")), partners, slop).drop("want", "term").distinct()
    start = F.col("pos") - first["off"]
    places = both.unionByName(alone).join(_small(keyed, 64 + 32 * F.size("plan")), ["t1", "t2", "apart"]).select(*_DOC, "window", start.alias("start"), (start + F.size("plan")).alias("end"), F.slice("plan", 3, F.greatest(F.size("plan"), F.lit(1))).alias("rest"))
    places = staged(places, "phrase-places")
    # Only postings of the documents that are left are sorted for the other terms.
    left = staged(places.select(*_DOC).distinct(), "phrase-left")
    others = join_small(lists, left, _DOC, "left_semi", 32)
    wanted = places.select(*_DOC, "window", "start", "end", F.size("rest").alias("more"), F.explode("rest").alias("of"))
    wanted = wanted.select(*_DOC, "window", "start", "end", "more", F.col("of.off").alias("off"), F.col("of.term").alias("term"), (F.col("start") + F.col("of.off")).alias("want"))
    met = _held(wanted, others, slop).groupBy(*_DOC, "window", "start", "end", "more").agg(F.count_distinct("off").alias("n"))
    whole = met.where("n = more").select(*_DOC, "window", "start", "end")
    return whole.unionByName(places.where(F.size("rest") == 0).select(*_DOC, "window", "start", "end"))


def _windows(items: DataFrame, size: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged (window, gram) of the different windows, and (window, item)."""
    grams = staged(item_windows(items, size, id, text), "phrase-grams")
    windows = staged(grams.select("gram").distinct().select(F.monotonically_increasing_id().alias("window"), "gram"), "phrase-windows")
    return windows, grams.join(windows, "gram").select("window", "item").distinct()


def find_phrases(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, start, end): where a window of an item occurs in a document, exactly or with each word within ``slop`` of its place.

    Rows that share an id but not their text give the places of each.
    """
    with Scratch(docs.sparkSession) as scratch:
        windows, owners = _windows(items, size, item_id, item_text)
        index = build_index(docs, windows.select(F.explode("gram").alias("word")), id, text)
        plan = staged(plans(index, windows), "phrase-plans")
        heads = index.postings.where(F.col("term") == HEADING).select(*_DOC, "null_id").distinct()
        found = matches(index, plan, slop).join(heads, _DOC).join(owners, "window")
        own = F.when(~F.col("null_id"), F.col("doc")).alias(id)
        return scratch.kept(found.select(own, F.col("item").alias(item_id), "start", "end").distinct(), "phrases")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: its id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated.

    Documents with the same windows share their list of items, which is made once.
    """
    with Scratch(docs.sparkSession) as scratch:
        windows, owners = _windows(items, size, item_id, item_text)
        index = build_index(docs, windows.select(F.explode("gram").alias("word")), id, text)
        plan = staged(plans(index, windows), "phrase-plans")
        spans = matches(index, plan).groupBy(*_DOC).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("window")).alias("found"))
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach")),
            lambda s, x: F.struct(
                (s["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(x["start"].cast("bigint"), s["reach"]))).alias("n"), F.greatest(s["reach"], x["end"].cast("bigint")).alias("reach")
            ),
            lambda s: s["n"],
        )
        hits = staged(spans.select(*_DOC, covered.alias("n_hit"), F.sha2(F.concat_ws(",", F.col("found").cast("array<string>")), 256).alias("kind"), "found"), "phrase-hits")
        kinds = hits.groupBy("kind").agg(F.first("found").alias("found")).select("kind", F.explode("found").alias("window"))
        listed = kinds.join(owners, "window").where("item IS NOT NULL").select("kind", F.col("item").cast("string").alias("item")).distinct()
        listed = listed.groupBy("kind").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
        hits = staged(join_small(hits.select(*_DOC, "n_hit", "kind"), staged(listed, "phrase-listed"), ["kind"], "left", 192).drop("kind"), "phrase-items")
        heads = index.postings.where(F.col("term") == HEADING).select(*_DOC, "null_id", F.col("pos").cast("bigint").alias("n_words"))
        result = join_small(heads, hits, _DOC, "left", 160).select(
            F.when(~F.col("null_id"), F.col("doc")).alias(id),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
        return scratch.kept(result, "phrase-report")
