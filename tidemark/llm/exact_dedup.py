"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Misra-Gries counters (``DataFrame.stat.freqItems``) name at most ``1 / SUPPORT`` digests that can be frequent; their
groups are counted exactly, and the verified ones, with the row that stays, are broadcast (a list of at most
``1 / SUPPORT`` rows at any input size), so a group that holds a third of all rows is settled where its rows are.
Every other digest has fewer than ``SUPPORT`` of the rows and goes through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

SPACE = r"[\x20\x09-\x0D]+"
#: Share of all rows from which a digest counts as heavy.
SUPPORT = 1 / 1024


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, n_points, copies): SHA-256 of the text without white space and its code points; fully
    repeated rows of a document are one row with their number."""
    d = documents(docs)
    return (d.select("doc_id", F.sha2(F.regexp_replace("text", SPACE, ""), 256).alias("text_sha256"),
                     F.char_length("text").alias("n_points"))
            .groupBy("doc_id", "text_sha256", "n_points").agg(F.count(F.lit(1)).alias("copies")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]`` (null counts as empty; all empty texts are
    one group). The longest original text stays, ties go to the smallest doc_id; a null doc_id sorts last. Rows
    that repeat both doc_id and text are one document: one output row, counted with their number in group_size.
    An empty table gives no rows."""
    rows = written(digests(docs))
    n = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # n_points descending, doc_id ascending with nulls last
    rank = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
    frequent = (rows.select("text_sha256").stat.freqItems(["text_sha256"], SUPPORT)
                .select(F.explode("text_sha256_freqItems").alias("text_sha256")))
    heavy = (rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256")
             .agg(F.sum("copies").alias("group_size"), F.min(rank).alias("best"))
             .where(F.col("group_size") >= F.lit(SUPPORT * n)).where("group_size > 1"))
    heavy = F.broadcast(written(heavy))
    settled = rows.join(heavy, "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = (rows.join(heavy, "text_sha256", "left_anti")
            .withColumn("group_size", F.sum("copies").over(group)).withColumn("best", F.min(rank).over(group)))
    cols = ["doc_id", "text_sha256", "n_points", "group_size", "best"]
    return (settled.select(cols).unionByName(rest.select(cols))
            .select("doc_id", F.col("best.i").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
                    (rank == F.col("best")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever their names.

    The row that stays is that of ``exact_groups``: longest original text (null counts as empty), then smallest doc_id
    (null last). Of rows that repeat its doc_id and text one stays, the same in every run also where other columns
    differ. An empty table stays empty."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))      # own names can't clash with the row's
    d = d.withColumn("own", F.sha2(F.regexp_replace(text, SPACE, ""), 256))
    d = d.join(kept, (d["own"] == kept["sha"]) & F.col("row.doc_id").cast("long").eqNullSafe(kept["id"]), "left_semi")
    # equal id and digest: rows of one document; those that are equal altogether need no order
    first = Window.partitionBy("own").orderBy(F.char_length(text).desc(), F.xxhash64("row"))
    return d.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
