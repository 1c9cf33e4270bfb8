"""Benchmark decontamination over a distributed positional inverted index, DataFrame functions only.

`Index` tokenises every document once and stores the postings (row, term, position) of all
words that any benchmark item has; a row's own entry, at no position, holds its id, its
number of words and the digest of its text. Counts of terms, exact phrases and proximity
matches are all read from these postings.

Exact phrases: every window of an item names its two rarest terms. Their posting lists,
moved back by the terms' offsets in the item, meet on a diagonal (row, item, position less
offset); where two lists agree, the item's other words are looked up in the postings of the
row, and runs of a window's length or more are the matches. Nothing is estimated.

Proximity: an item's rarest words all within a span, in any order.

Defined cases: a null or wordless text has no words; an item with fewer words than a
window, but at least one, is one window of its own length; wordless items match nothing.
Repeated documents stay repeated. Overlapping occurrences count each word once. Null ids
are ids like any other (as items they count as empty text). Other columns are ignored by
the searches, and kept by `clean_documents`; no name can clash. Empty tables give no
matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

#: Fixed value: what separates words (all ASCII but letters and digits).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of the benchmark's words of at most this many rows is broadcast (64 bytes each: under 64 MB).
BROADCAST_WORDS = 1_000_000
#: Lists that must agree before a phrase is looked up.
ANCHORS = 2
#: Words of a document that are looked up together.
BLOCK = 64


def words_of(text):
    """Array of the words of a text Column."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_WORDS else df


class Index:
    """The postings of docs in the words of items, written to the shared folder."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text"):
        numbered = items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words"))
        spelt = written(numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term")), "items")
        # Number 0, the empty word, is every row's own entry.
        lexicon = spelt.select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("number"))
        lexicon = written(lexicon.unionByName(docs.sparkSession.createDataFrame([("", 0)], "term string, number long")), "lexicon")
        #: Words of items: (item, item_id, n, offset, number).
        self.items = written(spelt.join(lexicon, "term").drop("term"), "item-words")
        self.n_items_words = self.items.count()
        text = F.col(text_col)
        # The digest is taken of the row; no word carries the text.
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), words_of(text).alias("words"))
        entries = rows.select("row", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "term"), "id", "digest")
        own = lambda name: F.when(F.col("at") == 0, F.col(name)).alias(name)
        entries = entries.select("row", "at", "term", own("id"), own("n_words"), own("digest"))
        met = entries.join(small(lexicon, lexicon.count()), "term")
        postings = met.select("row", "number", (F.col("at") - 1).alias("pos"), "id", "n_words", "digest")
        self.table = written(postings, "postings")
        discard(spelt, lexicon)
        self.postings = self.table.where("number > 0").select("row", "number", "pos")
        #: One entry per row of docs: (row, id, n_words, digest).
        self.rows = self.table.where("number = 0").select("row", "id", "n_words", "digest")
        self.counts = written(self.postings.groupBy("number").agg(F.count("*").alias("n_postings")), "counts")

    def places(self, width: int) -> DataFrame:
        """(item, offset, number, need): where the rarest terms of any window stand; need: lists that must agree."""
        starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - width + 1), F.greatest(F.lit(0), F.least(F.col("offset"), F.col("n") - width)))
        in_windows = self.items.join(F.broadcast(self.counts) if self.n_items_words <= BROADCAST_WORDS else self.counts, "number").withColumn("window", F.explode(starts))
        rank = F.row_number().over(Window.partitionBy("item", "window").orderBy("n_postings", "offset"))
        need = F.least(F.lit(ANCHORS), F.col("n"))
        return in_windows.withColumn("rank", rank).where(F.col("rank") <= ANCHORS).select("item", "offset", "number", need.alias("need")).distinct()

    def phrases(self, width=10) -> DataFrame:
        """(row, item_id, start, size): longest runs of an item's words, each of a window's length at least."""
        places = written(self.places(width), "places")
        met = self.postings.join(small(places, self.n_items_words), "number")
        diagonal = (F.col("pos") - F.col("offset")).alias("diagonal")
        agreed = met.groupBy("row", "item", diagonal).agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.min("need").alias("need"))
        candidates = agreed.where("need = 1 or low < high").select("row", "item", "diagonal")
        sizes = self.items.select("item", "n").distinct()
        blocks = F.sequence(F.floor(F.greatest(F.lit(0), F.col("diagonal")) / BLOCK), F.floor(F.greatest(F.lit(0), F.col("diagonal") + F.col("n") - 1) / BLOCK))
        # Written, so that their size decides how they meet the postings.
        spans = written(candidates.join(small(sizes, self.n_items_words), "item").select("row", "item", "diagonal", F.explode(blocks).alias("block")), "candidates")
        near = self.postings.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(spans, ["row", "block"])
        standing = near.select("row", "item", "diagonal", "number", (F.col("pos") - F.col("diagonal")).cast("int").alias("offset"))
        same = standing.join(small(self.items, self.n_items_words), ["item", "offset", "number"])
        along = Window.partitionBy("row", "item", "diagonal").orderBy("offset")
        runs = same.withColumn("run", F.col("offset") - F.row_number().over(along)).groupBy("row", "item", "item_id", "diagonal", "n", "run")
        found = runs.agg(F.min("offset").alias("first"), F.count("*").cast("int").alias("size")).where(F.col("size") >= F.least(F.lit(width), F.col("n")))
        return written(found.select("row", "item_id", (F.col("diagonal") + F.col("first")).cast("int").alias("start"), "size"), "phrases")

    def near(self, terms=3, span=20) -> DataFrame:
        """(row, item_id, start): an item's `terms` rarest different words, all within `span` words, in any order.

        start is a position of any of them from which the others follow within the span.
        Items with fewer different words need all they have.
        """
        own = self.items.groupBy("item", "item_id", "number").agg(F.min("offset").alias("offset")).join(self.counts, "number", "left")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n_postings", F.lit(0)), "offset"))
        chosen = own.withColumn("rank", rank).where(F.col("rank") <= terms)
        chosen = written(chosen.withColumn("need", F.count("*").over(Window.partitionBy("item"))).select("item", "item_id", "number", "need"), "rarest")
        lists = self.postings.join(small(chosen, self.n_items_words), "number")
        ahead = Window.partitionBy("row", "item").orderBy("pos").rangeBetween(0, span - 1)
        return lists.withColumn("seen", F.size(F.collect_set("number").over(ahead))).where("seen = need").select("row", "item_id", F.col("pos").alias("start"))


def matches(docs: DataFrame, items: DataFrame, width=10, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, item_id, start, size): runs of at least a window's length (in words) of items in documents."""
    index = Index(docs, items, id_col, text_col)
    return index.phrases(width).join(index.rows, "row").select(F.col("id").alias(id_col), "item_id", "start", "size")


def proximity_matches(docs: DataFrame, items: DataFrame, terms=3, span=20, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, item_id, start): see Index.near."""
    index = Index(docs, items, id_col, text_col)
    return index.near(terms, span).join(index.rows, "row").select(F.col("id").alias(id_col), "item_id", "start")


def contamination(docs: DataFrame, items: DataFrame, width=10, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted ids as text), contaminated, near (ids of items met by proximity)."""
    index = Index(docs, items, id_col, text_col)
    found = index.phrases(width)
    longest = found.groupBy("row", "start").agg(F.max("size").alias("size"))
    spans = longest.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"))
    # Words in the union of spans: each adds what reaches beyond the furthest end so far.
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["end"], s["start"]))).alias("n"),
    )
    hit = spans.select("row", F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long").alias("n_hit"))
    named = lambda df, name: df.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias(name))
    facts = hit.join(named(found, "items"), "row").join(named(index.near(), "near"), "row", "full")
    none = F.array().cast("array<string>")
    return index.rows.join(facts, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("near", none).alias("near"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, width=10, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs in which no window of an item occurs, unchanged; rows are known by id and SHA-256 of the text."""
    index = Index(docs, items, id_col, text_col)
    found = index.phrases(width)
    bad = found.select("row").distinct().join(index.rows, "row").select(F.col("id").alias("__bad_id"), F.col("digest").alias("__bad_digest"))
    bad = written(bad.distinct(), "bad")
    discard(index.table, index.items, index.counts, found)
    same = docs[id_col].eqNullSafe(bad["__bad_id"]) & (F.sha2(docs[text_col], 256) == bad["__bad_digest"])
    return docs.join(bad, same, "left_anti")
