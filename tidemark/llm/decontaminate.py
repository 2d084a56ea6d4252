"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Items are partitioned by their number of word shingles. A text that contains the share ``CONTAINED`` of an item's
shingles holds at least one of any ``n - ceil(CONTAINED * n) + 1`` of them, so an item is looked up by that many of its
smallest shingle hashes (its MinHash sketch, as long as the largest item of its partition needs): candidates are never
lost. A text must also have enough shingles for the item. Candidates are verified by counting the shared shingles,
compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, row_key, without, written

SHINGLE, CONTAINED = 5, 0.8
#: Separators after lower-casing: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def _shingles(named) -> Column:
    """``named(*words)`` of every run of SHINGLE of the column ``words``; of all words where there are fewer; none
    without words. The words must be a column of their own (spelled out, they would be split again per shingle), and
    are picked one by one (``slice`` copies the whole array each time). Explode the result with ``explode_outer``: the
    filter that the optimizer infers from ``explode`` would be pushed below the split and so repeat it per shingle."""
    words = F.col("words")
    n = F.size(words)
    return (F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: named(
        *[F.get(words, i + k) for k in range(SHINGLE)])))
        .when(n > 0, F.array(named(words))).otherwise(F.slice(F.array(named(words)), 1, 0)))


def _needed(n: Column, contained: float) -> Column:
    return F.ceil(n * contained - 1e-9).cast("int")


def sketches(items: DataFrame, contained: float = CONTAINED) -> tuple[DataFrame, DataFrame]:
    """((h, item_id, needed) sketch entries, (item_id, shingle, n) all distinct shingles) of ``items``
    (item_id, text)."""
    own = (items.where("item_id is not null")
           .select("item_id", _words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
           .select("item_id", F.explode_outer(_shingles(lambda *w: F.concat_ws(" ", *w))).alias("shingle"))
           .where("shingle is not null").distinct())
    own = written(own)
    sizes = own.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # size partition: (2^(c-1), 2^c]; sketch as long as its largest item needs
    largest = F.pow(2, F.ceil(F.log2("n"))).cast("int")
    sizes = sizes.withColumn("depth", largest - _needed(largest, contained) + 1).withColumn(
        "needed", _needed(F.col("n"), contained))
    # hashes that few items share come first: a phrase common to all items finds nothing in particular
    h = F.xxhash64(F.split("shingle", " "))
    hashed = own.select("item_id", h.alias("h"))
    shared = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("shared"))
    ranked = (hashed.join(shared, "h").groupBy("item_id")
              .agg(F.sort_array(F.collect_list(F.struct("shared", "h"))).alias("order")).join(sizes, "item_id")
              .select("item_id", "needed", F.explode(F.slice("order", 1, F.col("depth"))).alias("o"))
              .select(F.col("o.h").alias("h"), "item_id", "needed"))
    return written(ranked), own.join(sizes.select("item_id", "n"), "item_id")


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shared, n_shingles, containment, row_key.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; shingles are ``SHINGLE`` words (all words
    of a shorter text, so an item below five words is only found in a document of the same words). A document contains
    an item if it holds ``contained`` or more of the item's distinct shingles. Null and empty texts and items have no
    shingles and never match; items without id are skipped, repeated items count once. Documents without id, or
    sharing one, are told apart by row_key; fully repeated rows give one row per item. Empty tables give no rows."""
    sketch, shingles = sketches(items, contained)
    d = documents(docs, row_key().alias("row_key"))
    hashes = F.array_distinct(_shingles(F.xxhash64))
    probes = (d.select("row_key", _words(F.col("text")).alias("words")).select("row_key", hashes.alias("hashes"))
              .select("row_key", F.size("hashes").alias("m"), F.explode_outer("hashes").alias("h")).where("h is not null"))
    found = probes.join(sketch, "h").where("m >= needed").select("row_key", "item_id").distinct()
    found = written(found)
    texts = d.join(found.select("row_key").distinct(), "row_key", "left_semi")
    own = (texts.select("doc_id", "row_key", _words(F.col("text")).alias("words"))
           .select("doc_id", "row_key", F.explode_outer(_shingles(lambda *w: F.concat_ws(" ", *w))).alias("shingle"))
           .where("shingle is not null").distinct())
    checked = (found.join(shingles, "item_id").join(own, ["row_key", "shingle"])
               .groupBy("doc_id", "row_key", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared")))
    return (checked.where(F.col("n_shared") >= _needed(F.col("n"), contained))
            .select("doc_id", "item_id", "n_shared", F.col("n").cast("long").alias("n_shingles"),
                    (F.col("n_shared") / F.col("n")).alias("containment"), "row_key"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns kept."""
    return without(docs, leaks(docs, items))
