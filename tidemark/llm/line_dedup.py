"""Line deduplication by a suffix array over line ids (DataFrame functions only).

Lines are ranked by their digest; the suffixes of every document's line sequence are then ranked by their first 1, 2,
4, ... lines by distributed prefix doubling: the pair (rank of a suffix, rank of the suffix that follows its known
lines) is ranked by a range-partitioned sort, so ranks keep the order of a suffix array without any task seeing all of it.
A suffix that shares its rank with no other drops out on the way. The suffixes whose longest common prefix is ``n`` lines
or more are those with equal ranks, at the largest depth within ``n``, of the first and of the last of the ``n`` lines.

A repeated run counts from ``LEAST`` characters on, whatever its number of lines. Every maximal repeated run is the
union of its shortest parts of so many characters, so only the intervals of these parts are formed: from each line
the shortest run forwards, and the shortest one backwards. Doubling ends at the depth of the longest such part, since
the order of suffixes beyond it can't change which lines are covered. In each interval the first suffix stays, the others are
copies, and copies that overlap or touch join up to maximal runs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

#: Shortest repeated run, in characters (code points, line feeds not counted).
LEAST = 50

#: Names one text of one document: rows that share a doc_id but not their text are told apart.
_DOC = ["doc_id", "version"]


def _version():
    return F.xxhash64("text").alias("version")


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """``keys`` (distinct) with ``rank``: increasing in the order of ``cols``, equal keys can't be."""
    return written(keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
                   .withColumn("rank", F.monotonically_increasing_id()))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """The rows of ``lines`` (doc_id, version, line_no, line, size) whose line occurs more than once, with its ``rank``
    instead of the line: suffixes ranked by their first line."""
    repeated = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    return written(lines.join(_ranked(repeated, "line"), "line").select(*_DOC, "line_no", "rank", "size"))


def doubled(now: DataFrame, known: int) -> DataFrame:
    """(doc_id, version, line_no, rank) of the suffixes whose first 2 x ``known`` lines occur more than once, ranked by
    them; ``now`` holds the ranks by ``known`` lines."""
    after = Window.partitionBy(*_DOC).orderBy("line_no").rangeBetween(known, known)
    pairs = (now.select(*_DOC, "line_no", F.col("rank").alias("first"), F.first("rank").over(after).alias("next"))
             .where("next is not null"))
    repeated = pairs.groupBy("first", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first", "next")
    ranks = _ranked(repeated, "first", "next")
    return written(pairs.join(ranks, ["first", "next"]).select(*_DOC, "line_no", "rank"))


def shortest_runs(repeated: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, first, n): from each repeated line the shortest run forwards, and the shortest one backwards, of
    repeated lines with ``least`` characters or more.

    Characters are summed along each stretch of repeated lines. The line where a sum is reached is the nearest one in
    the order of the sums, which one running window over lines and looked-up sums finds for all lines of a stretch."""
    by_doc = Window.partitionBy(*_DOC).orderBy("line_no")
    stretch = repeated.withColumn("stretch", F.col("line_no") - F.row_number().over(by_doc))
    along = Window.partitionBy(*_DOC, "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = stretch.withColumn("to", F.sum("size").over(along)).withColumn("from", F.col("to") - F.col("size"))

    def point(forwards: bool, key, looked_up: bool):
        at = F.col("line_no")
        return F.struct(F.lit(forwards).alias("forwards"), key.cast("long").alias("key"), F.lit(looked_up).alias("looked_up"),
                        (-at if forwards else at).alias("tie"))

    points = sums.select(*_DOC, "stretch", "line_no", F.explode(F.array(
        point(True, -F.col("to"), False), point(True, -F.col("from") - least, True),
        point(False, F.col("from"), False), point(False, F.col("to") - least, True))).alias("p"))
    order = (Window.partitionBy(*_DOC, "stretch", "p.forwards").orderBy("p.key", "p.looked_up", "p.tie")
             .rowsBetween(Window.unboundedPreceding, 0))
    reached = F.last(F.when(~F.col("p.looked_up"), F.col("line_no")), ignorenulls=True).over(order)
    found = points.withColumn("other", reached).where("p.looked_up and other is not null")
    return (found.select(*_DOC, F.least("line_no", "other").alias("first"),
                         (F.abs(F.col("line_no") - F.col("other")) + 1).alias("n")).distinct())


def later_runs(runs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, version, first, n) of those ``runs`` that are not the first suffix of their interval. ``ranks`` holds the
    ranks of all depths: a run is named by those of its first and its last ``depth`` lines, the largest power of 2 within it."""
    power = F.lit(1)
    for k in range(1, 31):
        power = F.when(F.col("n") >= 1 << k, 1 << k).otherwise(power)
    runs = runs.withColumn("depth", power).withColumn("at", F.col("first") + F.col("n") - F.col("depth"))
    heads = ranks.select(*_DOC, F.col("line_no").alias("first"), "depth", F.col("rank").alias("head"))
    tails = ranks.select(*_DOC, F.col("line_no").alias("at"), "depth", F.col("rank").alias("tail"))
    named = runs.join(heads, [*_DOC, "first", "depth"]).join(tails, [*_DOC, "at", "depth"])
    place = F.struct(*_DOC, "first")
    origin = (named.groupBy("n", "head", "tail").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("places"))
              .where("places > 1").drop("places"))
    return named.join(origin, ["n", "head", "tail"]).where(place > F.col("origin")).select(*_DOC, "first", "n")


def copied_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, version, runs array of struct(first, past)): maximal runs of lines that are covered by runs of ``least``
    characters or more that occur earlier (smaller doc_id, then version, then line)."""
    d = documents(docs).where("doc_id is not null")
    lines = d.select("doc_id", _version(), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = written(lines.select(*_DOC, "line_no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line"),
                                 F.length("line").alias("size")).distinct())
    ranks = repeated_lines(lines)
    runs = written(shortest_runs(ranks, least))
    longest = runs.agg(F.max("n")).first()[0] or 1
    depth, depths = 1, [ranks.select(*_DOC, "line_no", "rank", F.lit(1).alias("depth"))]
    while 2 * depth <= longest:
        ranks = doubled(ranks, depth)
        depth *= 2
        depths.append(ranks.withColumn("depth", F.lit(depth)))
    copies = written(later_runs(runs, functools.reduce(DataFrame.union, depths)))
    before = Window.partitionBy(*_DOC).orderBy("first", "past").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*_DOC).orderBy("first", "past").rowsBetween(Window.unboundedPreceding, 0)
    joined = (copies.select(*_DOC, "first", (F.col("first") + F.col("n")).alias("past"))
              .withColumn("new", F.coalesce(F.col("first") > F.max("past").over(before), F.lit(True)).cast("int"))
              .withColumn("run", F.sum("new").over(so_far)).groupBy(*_DOC, "run")
              .agg(F.min("first").alias("first"), F.max("past").alias("past")))
    return joined.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("runs"))


def remove_copied_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_text (kept lines joined by a line feed), runs
    (array of struct(first, past)).

    Lines are what line feeds separate (a null or empty text is one empty line). A line goes if consecutive lines
    that include it, together of ``least`` (1 or more) characters or more, occur earlier: in a document with a smaller doc_id
    or higher up in the same one; judged on the input. A row without doc_id is kept whole and is no reference. Rows
    that repeat a doc_id: fully repeated ones are one document and don't remove each other; of different texts, the one with
    the smaller hash comes earlier. An empty table gives no rows."""
    lines = F.split("text", "\n")
    runs = copied_runs(docs, least)
    d = documents(docs).select("doc_id", _version(), "text").join(runs, _DOC, "left").withColumn("lines", lines)
    none = F.array().cast("array<struct<first: int, past: int>>")
    d = d.withColumn("runs", F.coalesce("runs", none))
    n = F.size("runs")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(
        F.col("lines"), F.when(k == 0, 0).otherwise(F.get("runs", k - 1)["past"]) + 1,
        F.coalesce(F.get("runs", k)["first"], F.size("lines")) - F.when(k == 0, 0).otherwise(
            F.get("runs", k - 1)["past"]))))
    gone = F.aggregate("runs", F.lit(0), lambda s, r: s + r["past"] - r["first"])
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"),
                    F.array_join(kept, "\n").alias("kept_text"), "runs")
