"""Helpers that the operators share: text folding, shared tables, key-safe joins."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty. Pure ASCII takes the fast built-in, which is the same there."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(filled) == F.char_length(filled), F.lower(filled)).otherwise(
        F.translate(filled, string.ascii_uppercase, string.ascii_lowercase)
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own; a cluster must set one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        found = tempfile.mkdtemp(prefix="impactgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Ends the shuffle files of a query with the query, not with the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The shuffle files of the write go when it is done: nothing reads them any more.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote. Call it only when all that is read from them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for inner columns that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        found.append(stem)
    return found


def keep_one_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str, digest: Column) -> DataFrame:
    """One row of docs, all columns as they are, for each (id, digest) of kept. Null ids match null.

    Of rows that agree in both, one with a text stays before one without. Rows meet kept by (id,
    digest), and the choice among repeats is made where they met.
    """
    own, nth, key, mark = free_names(docs, "own", "nth", "kept_id", "kept_digest")
    told = kept.select(F.col(kept.columns[0]).alias(key), F.col(kept.columns[1]).alias(mark))
    marked = docs.withColumn(own, digest)
    stay = marked.join(told, docs[id_col].eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark)), "left_semi")
    first = Window.partitionBy(F.col(id_col), F.col(own)).orderBy(F.col(text_col).isNull())
    return stay.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)


def columns_as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal key columns, as one table each; rows must come sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Rolling 64-bit hashes of all k-grams of words, by position, as signed longs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * _MUL + one[i : i + n])
    return h.view(np.int64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def deal_groups(rows: DataFrame, item: str, chunk: int, split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds (chunk, a, b) to rows(key, item, ...) and drops keys that one row has alone.

    With split, rows of a key with more than chunk rows first get smaller keys from it; it returns
    the columns of rows but those that only it needs. A key that still has more than chunk rows is
    dealt into m chunks by a hash of item; every row goes to the m groups (key, a, b) that pair its
    chunk with each, so every pair of rows meets and no group exceeds two chunks.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1")
    if split is not None:
        sizes = materialize(sizes, "sizes")
        finer = split(rows.join(sizes.where(F.col("__n") > chunk).select("key"), "key", "left_semi"))
        rows = rows.select(*finer.columns)
        if not sizes.where(F.col("__n") > chunk).isEmpty():
            finer = materialize(finer, "finer")
            rows = rows.unionByName(finer)
            sizes = sizes.where(F.col("__n") <= chunk).unionByName(finer.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"))
    met = rows.join(sizes, "key").withColumn("__m", F.ceil(F.col("__n") / chunk).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64(item), F.col("__m")).cast("int"))
    met = met.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    pair = met.withColumn("a", F.least("chunk", "__with")).withColumn("b", F.greatest("chunk", "__with"))
    return pair.drop("__n", "__m", "__with").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", item)
