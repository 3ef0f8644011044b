"""Listing of a folder's files by name, files of no bytes included.

Spark's own scans leave out files of no bytes.  An empty image is still an
image that is there (S8), and an empty JSON document is a malformed one
(S1, S2), so both need the names.  The file system is asked once, through
Hadoop, so any store that Spark reads works.  The listing passes through the
driver like the one that every Spark scan of the folder makes.
"""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession

# How Hadoop writes a file's status as text (a folder has no length there).
_STATUS = re.compile(r"path=(.*?); isDirectory=(?:true|false; length=(\d+));", re.S)


def folder_entries(spark: SparkSession, folder: str) -> list[tuple[str, int | None]]:
    """(path, length) of all that is directly in ``folder``; a folder's length
    is None.  Raises ``FileNotFoundError`` where there is no such folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    # All entries in one call across the bridge, not one call each.
    entries = jvm.scala.runtime.ScalaRunTime.genericWrapArray(fs.listStatus(path)).mkString("\0").split("\0")
    return [(m[1], None if m[2] is None else int(m[2])) for m in filter(None, map(_STATUS.search, entries))]


def folder_files(spark: SparkSession, folder: str, pattern: str = "*", only_empty: bool = False) -> DataFrame:
    """``(path, length)`` of the files directly in ``folder`` whose names match
    a shell pattern; hidden ones (``_x``, ``.x``) are left out, as in Spark's
    scans.  With ``only_empty`` those of no bytes alone.  Raises
    ``FileNotFoundError`` where there is no such folder."""
    rows = []
    for path, length in folder_entries(spark, folder):
        name = path.rsplit("/", 1)[-1]
        if (length is not None and name[:1] not in ("_", ".") and fnmatch.fnmatchcase(name, pattern)
                and not (only_empty and length)):
            rows.append((path, length))
    return spark.createDataFrame(rows, "path string, length bigint")
