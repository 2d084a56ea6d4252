"""A search index that takes changed documents: generations, deletion marks, compaction.

A batch of documents becomes a generation: its document rows (with field lengths), its postings, and marks that name
the older generations in which its snapshots stood. A read leaves marked rows out, so the newest generation of a
snapshot wins in documents, postings and statistics alike, and nothing already written is rewritten. One commit of the
document table's ledger makes all three visible. ``compact`` writes the live rows as one generation without marks.

Layout: ``<path>/gen=...`` postings, ``<path>/_docs`` the document table (``operators.versioned``), ``<path>/_marks``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.search import document_postings, with_field_lengths, write_postings
from tidemark.operators.versioned import State, VersionedTable
from tidemark.session import shuffles_dropped

POSTINGS = "snapshot string, field string, token string, tf long, dl long, positions array<int>, shard int"
MARKS = "snapshot string, old string"


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, f"{self.path}/_docs", ["snapshot"])

    # ---- reading ------------------------------------------------------------------------------------------------

    def _generations(self, folder: str, schema: str, gens: list[str]) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], f"{schema}, gen string")
        return (self.spark.read.schema(f"{schema}, gen string").option("basePath", folder)
                .parquet(*[f"{folder}/gen={g}" for g in gens]))

    def _stale(self, state: State) -> DataFrame:
        """(snapshot, gen) whose rows a later generation has replaced or deleted."""
        marks = self._generations(f"{self.path}/_marks", MARKS, state.live)
        return marks.select("snapshot", F.col("old").alias("gen")).distinct()

    def _live(self, state: State, read) -> DataFrame | None:
        """The rows of ``read(generations)`` that no later generation has replaced. Generations that no mark names (the
        newest one never is) are read as they are, wholly replaced ones not at all; only those replaced in part meet
        their marks. A snapshot stands once in a generation."""
        stale = self._stale(state)
        marked = dict(stale.groupBy("gen").count().collect())                       # a row per live generation at most
        rows = self.table.rows_by_generation(state) if marked else {}
        whole = [g for g in state.live if g not in marked]
        part = [g for g in state.live if g in marked and marked[g] < rows[g]]
        if not part:
            return read(whole)
        met = read(part).join(stale, ["snapshot", "gen"], "left_anti")
        return read(whole).unionByName(met) if whole else met

    def docs(self, state: State | None = None) -> DataFrame | None:
        """The newest row of every document (None before the first batch)."""
        state = state or self.table.ledger.state()
        if state.schema is None:
            return None
        return self._live(state, lambda gens: self.table.read(replace(state, live=gens))).drop("gen", "bucket")

    def postings(self, state: State | None = None) -> DataFrame:
        """Postings (per document) of the newest rows."""
        state = state or self.table.ledger.state()
        return self._live(state, lambda gens: self._generations(self.path, POSTINGS, gens)).drop("gen")

    # ---- writing ------------------------------------------------------------------------------------------------

    def _write(self, gen: str, docs: DataFrame) -> DataFrame:
        """Writes document rows, and postings from the rows as they are stored: what ``docs`` comes from is computed once,
        and the texts need no copy beside the generation's own."""
        self.table.write_generation(docs, gen)
        own = self.spark.read.schema(docs.schema).parquet(f"{self.table.path}/gen={gen}").drop("bucket")
        write_postings(document_postings(own), f"{self.path}/gen={gen}")
        return own

    def _mark(self, gen: str, marks: DataFrame) -> None:
        marks.write.mode("overwrite").parquet(f"{self.path}/_marks/gen={gen}")

    def apply(self, batch: DataFrame, source: str | None = None, epoch: int | None = None,
              order: tuple[str, ...] = ("captured_at",)) -> State:
        """Indexes a batch of documents (snapshot, title, content, ...): new ones are added, known ones replaced, and
        rows with a true ``deleted`` column only taken out. Of several rows of a snapshot in the batch the last in
        ``order`` counts. An epoch that has been applied already is a no-op."""
        cols, row = batch.columns, [F.col(c) for c in batch.columns]
        at = F.struct(*order, F.xxhash64(*cols))
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in cols else F.lit(False)
        if "deleted" in cols:               # of a row that goes, only the key is needed
            row = [F.col(c) if c == "snapshot" else F.when(~gone, F.col(c)).alias(c) for c in cols if c != "deleted"]
        rows = batch.select("snapshot", F.struct(*row).alias("row"), gone.alias("gone"), at.alias("at"))
        last = (rows.groupBy("snapshot").agg(F.max_by(F.struct("row", "gone"), "at").alias("last"))
                .where("NOT last.gone").select("last.row.*"))
        docs = with_field_lengths(last.drop("title_dl", "content_dl"))

        def write(state: State, gen: str):
            nonlocal docs                   # written again, after a conflict, from the rows that lost
            docs = self._write(gen, docs)
            keys = docs.select("snapshot")
            if "deleted" in cols:
                keys = keys.unionByName(rows.groupBy("snapshot").agg(F.max_by("gone", "at").alias("gone"))
                                        .where("gone").select("snapshot"))
            self._mark(gen, self.table.present(keys, state).select("snapshot", F.col("gen").alias("old")))
            return 1, (), docs.schema.json()                                      # 1: a generation of marks alone is live, too

        with shuffles_dropped(self.spark), shuffles_dropped(batch.sparkSession):
            return self.table.commit_batch(write, source, epoch)

    def compact(self) -> State:
        """Rewrites the live documents and their postings as one generation. Postings follow from the documents, which
        are a fraction of their size, so they are made anew and not joined with the marks."""
        def write(state: State, gen: str):
            docs = self.docs(state)
            if docs is None:
                return 0, (), None
            self._write(gen, docs)
            self._mark(gen, self.spark.createDataFrame([], MARKS))
            return 1, state.live, state.schema

        with shuffles_dropped(self.spark):
            return self.table.commit_batch(write)
