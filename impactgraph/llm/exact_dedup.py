"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A new batch is reduced to one row per digest,
anti-joined to the index by sort-merge (the index side is neither moved nor sorted anew while each
bucket is one file), and what is new is appended.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_ascii, keep_one_each, materialize


#: Digests that a bucket should hold at most, and the buckets of an index made without a count.
BUCKET_ROWS, BUCKETS = 4_000_000, 32


def buckets_for(digests: int) -> int:
    """Buckets for an index that is to hold so many digests: one task sorts and merges a bucket at a time."""
    return max(BUCKETS, -(-digests // BUCKET_ROWS))


@dataclass
class DigestIndex:
    """A bucketed, sorted table (digest, keep_id, batch). buckets is that of a new table; rebuild changes it.

    Each batch is written under a name of its own. A batch that is given again, after a failure or
    by mistake, does not see its own digests and adds only those that are not there yet.
    """

    spark: SparkSession
    table: str
    buckets: int = BUCKETS

    def ensure(self, id_type: str) -> None:
        """Makes the table where it is missing; a rebuild that broke off before its last step is finished first."""
        if not self.spark.catalog.tableExists(self.table) and self.spark.catalog.tableExists(f"{self.table}_rebuilt"):
            self.spark.sql(f"ALTER TABLE {self.table}_rebuilt RENAME TO {self.table}")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        described = self.spark.sql(f"DESCRIBE FORMATTED {self.table}").where("col_name = 'Num Buckets'").first()
        self.buckets = int(described.data_type)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Adds the batch's digests that the index does not hold yet, one file a bucket."""
        there = self.rows().where(F.col("batch") == batch).select("digest").hint("merge")
        new = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        new.join(there, "digest", "left_anti").sortWithinPartitions("digest").write.insertInto(self.table)

    def rebuild(self, buckets: int | None = None) -> None:
        """One file a bucket again, after many batches, with buckets for what the index holds or as given."""
        buckets = buckets or buckets_for(self.rows().count())
        again = f"{self.table}_rebuilt"
        self.spark.sql(f"DROP TABLE IF EXISTS {again}")
        self.rows().repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").saveAsTable(again)
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {again} RENAME TO {self.table}")
        self.buckets = buckets

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Decides on every row of a batch and appends the batch's new digests to the index.

    Returns (id, digest, keep_id, group_size, kept). Of equal texts the row with the largest id
    stays, unless an earlier batch holds the text: then none stays and keep_id is the earlier one.
    group_size counts the batch's rows. Null texts equal empty ones; null ids lose to any id; of
    rows that repeat both id and text one is kept. An empty batch gives no rows. Other columns
    are not read, so their names cannot clash. A batch given again under the same name gets the
    same answer; without a name it is taken as new. The result does not read the index any more.
    """
    batch = batch or uuid.uuid4().hex
    index.ensure(docs.schema[id_col].dataType.simpleString())
    rows = materialize(text_digests(docs, id_col, text_col), "digests")
    groups = rows.groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("group_size")).repartition(index.buckets, "digest")
    others = index.rows().where(F.col("batch") != batch).select("digest", "keep_id").hint("merge")
    fresh = groups.join(others, "digest", "left_anti").select("digest", F.col("newest").alias("keep_id"))
    fresh = materialize(fresh.withColumn("fresh", F.lit(True)), "fresh")
    earlier = groups.join(others, "digest").groupBy("digest").agg(F.min("keep_id").alias("keep_id")).withColumn("fresh", F.lit(False))
    known = materialize(groups.select("digest", "group_size").join(fresh.unionByName(earlier), "digest"), "known")
    index.append(fresh, batch)
    single = rows.groupBy("digest", "id").agg(F.count("*").cast("int").alias("copies"))
    placed = single.join(known, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("fresh") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return placed.select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with their columns unchanged.

    Of equal texts one row stays, that of the largest id, any id before a null one; null texts
    equal empty ones, and of rows that repeat id and text one with a text stays before one without.
    Inner names never clash with columns of docs. An empty table stays empty.
    """
    kept = exact_dedup(docs, index, id_col, text_col, batch).where("kept").select("id", "digest")
    return keep_one_each(docs, kept, id_col, text_col, F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256)))
