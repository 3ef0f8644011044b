"""Overwriting a folder so that readers see the old rows or the new ones.

A plain overwrite deletes first, so a write that breaks off loses both.
Here the new files are written beside the old ones (Spark gives them names of
their own), then a manifest that lists them is published by one rename, then
the old files go.  Readers follow the newest manifest: until it is there they
read the old version, whichever step the write has reached, and a repeated
write removes what a broken one has left.  A folder without a manifest reads
as it is.  One writer at a time."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from lethe.sources.listing import folder_entries

# Hidden from Spark's scans by its first letter; the number rises with each version.
_MANIFEST = re.compile(r"_manifest-(\d+)$")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _data_files(spark: SparkSession, folder: str) -> set[str]:
    """Paths of the data files below ``folder`` (a call a folder)."""
    out = set()
    for path, length in folder_entries(spark, folder):
        if path.rsplit("/", 1)[-1][:1] not in ("_", "."):
            out |= _data_files(spark, path) if length is None else {path}
    return out


def _manifests(spark: SparkSession, folder: str) -> dict[int, str]:
    return {int(m[1]): path for path, _ in folder_entries(spark, folder) if (m := _MANIFEST.search(path))}


def committed_files(spark: SparkSession, folder: str) -> list[str] | None:
    """The files of the version that readers see; None for a folder without versions."""
    manifests = _manifests(spark, folder)
    if not manifests:
        return None
    stream = _file_system(spark, folder).open(_path(spark, manifests[max(manifests)]))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return sorted(line for line in text.split("\n") if line)


def read_version(spark: SparkSession, folder: str, read: Callable[[object], DataFrame]) -> DataFrame:
    """``read`` of the files that readers of ``folder`` see."""
    files = committed_files(spark, folder) if _file_system(spark, folder).exists(_path(spark, folder)) else None
    if files is None:
        return read(folder)
    # A version without files: the folder gives the columns, and no rows.
    return read(files) if files else read(folder).limit(0)


def write_beside(df: DataFrame, folder: str, fmt: str, partition_by: Sequence[str] = ()) -> set[str]:
    """The first step: the rows as new files beside the old; their paths."""
    spark = df.sparkSession
    before = _data_files(spark, folder) if _file_system(spark, folder).exists(_path(spark, folder)) else set()
    df.write.mode("append").partitionBy(*partition_by).format(fmt).save(folder)
    return _data_files(spark, folder) - before


def publish(spark: SparkSession, folder: str, files: set[str]) -> None:
    """The second step: a manifest of ``files`` by one rename, then everything else goes."""
    fs, old = _file_system(spark, folder), _manifests(spark, folder)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    out = fs.create(_path(spark, draft))
    out.write(bytearray("".join(f"{f}\n" for f in sorted(files)), "utf-8"))
    out.close()
    if not fs.rename(_path(spark, draft), _path(spark, f"{folder}/_manifest-{max(old, default=0) + 1:09d}")):
        raise OSError(f"{folder}: the manifest could not be published")
    for path in (_data_files(spark, folder) - files) | set(old.values()):
        fs.delete(_path(spark, path), False)


def overwrite(df: DataFrame, folder: str, fmt: str, partition_by: Sequence[str] = ()) -> None:
    """``folder`` holds the rows of ``df`` from here on; readers see the old
    ones until all new ones are there.  ``df`` must not read the folder."""
    publish(df.sparkSession, folder, write_beside(df, folder, fmt, partition_by))
