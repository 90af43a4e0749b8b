"""Unified diffs as (path, line) rows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,([0-9]+))? @@"


def changed_lines(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, text) to (diff_id, path, line): new-side lines of every hunk.

    '+++ b/<path>' opens a file; /dev/null does not, so the file before stays; a length of 0 gives no line.
    Opening a file again forgets what it had.
    """
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("pos", "row"))
    path = F.regexp_extract("row", r"^[+]{3} b/(.*)$", 1)
    opened = rows.withColumn("path", F.when(path != "", F.trim(path))).withColumn("opening", F.when(path != "", F.col("pos")))
    w = Window.partitionBy("diff_id").orderBy("pos")
    placed = opened.withColumn("path", F.last("path", True).over(w)).withColumn("opening", F.last("opening", True).over(w))
    last = Window.partitionBy("diff_id", "path")
    hunks = placed.withColumn("__last", F.max("opening").over(last)).where("path is not null and opening = __last").where(F.col("row").rlike(_HUNK))
    start, count = F.regexp_extract("row", _HUNK, 1).cast("int"), F.regexp_extract("row", _HUNK, 2)
    size = F.when(count == "", 1).otherwise(count.try_cast("int"))
    told = hunks.select("diff_id", "path", start.alias("start"), size.alias("size")).where("size > 0")
    return told.select("diff_id", "path", F.explode(F.expr("sequence(start, start + size - 1)")).alias("line"))


def git_diff(spark: SparkSession, repo: str, staged: bool = False, base: str = "HEAD") -> DataFrame:
    """The working tree against base, or the staged changes, as one diff."""
    command = ["git", "-C", repo, "diff", "--unified=0", *(["--staged"] if staged else [base])]
    text = subprocess.run(command, capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([("git", text)], "diff_id string, text string")
