"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import free_name, offer_broadcast, settle

WINDOW = 10
# Characters that separate words once A-Z are lower-cased, and the same set for text as it is (fixed by the contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), ""))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents by id and text hash: rows that share both have the same result."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("text").alias("text"))


def _items(benchmark: DataFrame) -> DataFrame:
    words = words_of(F.col("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("item")).filter(F.size("item") > 0).distinct()
    return items.withColumn("w", F.least(F.size("item"), F.lit(WINDOW)))


def _word_counts(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """How often each word of the benchmark occurs in all documents; combined before the shuffle."""
    vocabulary = settle(items.select(F.explode("item").alias("word")).distinct())
    tokens = keyed.select(F.explode(words_of(F.col("text"))).alias("word"))
    found = tokens.join(offer_broadcast(vocabulary, 64), "word").groupBy("word").agg(F.count("*").alias("n"))
    return settle(vocabulary.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """The necessary prefix of every window: its rarest word, with the item around it.

    A window occurs only where its rarest word does, so a prefix of one word under the order by rarity is enough to
    find every occurrence. Windows of an item that share the word share the row.
    """
    starts = items.select("item_id", "item", "w", F.explode(F.sequence(F.lit(0), F.size("item") - F.col("w"))).alias("start"))
    spots = starts.select("item_id", "item", "w", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("w") - 1)).alias("p"))
    ranked = spots.withColumn("word", F.get("item", F.col("p"))).join(counts, "word")
    rarest = ranked.groupBy("item_id", "item", "w", "start").agg(F.min(F.struct("n", "word", "p")).alias("least"))
    chosen = rarest.select("item_id", "item", "w", F.col("least.word").alias("word"), F.col("least.p").alias("p")).distinct()
    around = F.array(*[F.get("item", F.col("p") + o) for o in range(1 - WINDOW, WINDOW)])
    return chosen.select("item_id", "w", "word", "p", (F.size("item") - F.col("p") - 1).alias("after"), around.alias("around"))


def _run(side: int) -> Column:
    """How many words next to the anchor agree on one side, WINDOW - 1 at most."""
    length = F.lit(WINDOW - 1)
    for step in range(WINDOW - 1, 0, -1):
        agree = F.get("beside", F.col("here") + side * step) == F.col("around")[WINDOW - 1 + side * step]
        length = F.when(F.coalesce(agree, F.lit(False)), length).otherwise(step - 1)
    return length


def _with_reach(tokens: DataFrame) -> DataFrame:
    """Tokens with the words that a window over them can hold in place of all words, and their place among these."""
    low = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    high = F.col("pos") + WINDOW
    beside = F.slice("words", low + 1, high - low)
    return tokens.withColumn("beside", beside).withColumn("here", F.least("pos", F.lit(WINDOW - 1))).drop("words")


def hits(keyed: DataFrame, prefix: DataFrame) -> DataFrame:
    """(doc_id, h, item_id, first, last): runs of document words that hold whole windows of an item.

    Where the prefix words are few enough to be broadcast, other tokens leave before anything moves. Beyond that tokens are
    shuffled, each with the words within a window's reach of it, never with the text.
    """
    offered = offer_broadcast(prefix, 700)
    words = keyed.select("doc_id", "h", words_of(F.col("text")).alias("words"))
    spread = words.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "word"))
    candidates = _with_reach(spread.join(offered, "word")) if offered is not prefix else _with_reach(spread).join(prefix, "word")
    # Length and position: the document must have room for a window around the anchor.
    room = F.least("here", "p") + F.least(F.size("beside") - F.col("here") - 1, "after", F.lit(WINDOW - 1)) + 1
    runs = candidates.filter(room >= F.col("w")).select("doc_id", "h", "item_id", "w", "pos", _run(-1).alias("before"), _run(1).alias("behind"))
    exact = runs.filter(F.col("before") + F.col("behind") + 1 >= F.col("w"))
    return exact.select("doc_id", "h", "item_id", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") + F.col("behind")).alias("last")).distinct()


def _summaries(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "h").orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, reached))
    runs = found.groupBy("doc_id", "h", "first").agg(F.max("last").alias("last")).select("doc_id", "h", fresh.alias("fresh"))
    covered = runs.groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
    items = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    right = items.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "items")
    return covered.join(right, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))).drop("r_id", "r_h")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents: doc_id, h, n_hit, items."""
    items = settle(_items(benchmark))
    keyed = _keyed(docs)
    prefix = settle(anchors(items, _word_counts(keyed, items)))
    return _summaries(settle(hits(keyed, prefix)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark windows inside every document.

    A window is WINDOW consecutive words of an item, or the whole of a shorter item. Null or empty text has no words;
    an item without words has no window; a null item_id counts as an empty one; equal items are told apart by id.
    Repeated rows get the same result each; very long texts are searched whole; an empty benchmark leaves all clean.
    Result: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "n_hit", "items")
    base = _keyed(docs).select("doc_id", "h", count_words(F.col("text")).cast("long").alias("n_words"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, their columns unchanged."""
    number, text = free_name(docs, "__id"), free_name(docs, "__h")
    found = settle(overlaps(docs, benchmark).select(F.col("doc_id").alias(number), F.col("h").alias(text)))
    same = F.col("doc_id").eqNullSafe(F.col(number)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text))
    return docs.join(offer_broadcast(found, 64), same, "left_anti")
