"""S1/S2 with every document checked: malformed and ill-typed documents.

A document is good when it is one JSON object and every declared field has
the declared type (a scalar of another type reads as its text; an absent key
as null; keys beyond the schema are ignored).  The others have a problem:

* ``empty``: a file of no bytes or blanks only,
* ``malformed``: not exactly one JSON value (cut off, trailing data, NaN, ...),
* ``schema``: JSON, but no object, or a field of another type than declared.

``strict`` reading raises at the first of them and names its file, like a
loader that parses each file.  ``quarantine`` reading leaves them out of the
result and writes them, with file, position and raw text, to a folder of
their own.  Documents are checked inside the scan's tasks; strict reading
starts no job of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.text import last_path_segment
from lethe.sources.listing import folder_files
from lethe.sources.versions import overwrite, read_version

# What the quarantine holds: position = line number from 1 (1 for a file that is one document).
QUARANTINE = "file_name STRING, position BIGINT, problem STRING, raw STRING"

_CORRUPT = "_corrupt_document"


def _one_value(raw: Column) -> Column:
    """Whether the text is exactly one JSON value.  The parser stops at the end
    of a value, so the text is put into an array and into an object: what
    follows the value breaks one of them or shows as a second entry."""
    in_array = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]")))
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.coalesce((in_array == 1) & (F.size(in_object) == 1), F.lit(False))


def checked_documents(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.json",
                      lines: bool = False) -> DataFrame:
    """Every document of the folder, good or not: the schema's columns,
    ``file_name``, ``_problem`` (null for a good one), ``_raw`` and where it
    stands (``_block``, ``_row``).  Blank lines are no documents."""
    text = lambda paths: (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", False)
                          .text(paths, wholetext=not lines))
    scan = read_version(spark, folder, text)
    x = scan.select(F.col("value").alias("_raw"), last_path_segment(F.col("_metadata.file_path")).alias("file_name"),
                    F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    if not lines:
        none = folder_files(spark, folder, pattern, only_empty=True)
        # Their text is made of a column: a constant would let the optimizer raise before any row is read.
        x = x.unionByName(none.select(F.repeat(F.lit(" "), F.col("length").cast("int")).alias("_raw"), last_path_segment("path").alias("file_name"),
                                      F.col("length").alias("_block"), F.col("length").alias("_row")))
    asked = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}
    x = x.withColumn("_doc", F.from_json("_raw", asked, options))
    problem = (F.when(~F.col("_raw").rlike(r"\S"), "empty").when(~_one_value(F.col("_raw")), "malformed")
               .when(F.col(f"_doc.{_CORRUPT}").isNotNull(),
                     F.when(F.try_parse_json("_raw").isNull(), "malformed").otherwise("schema")))
    return x.select(*[F.col("_doc")[f.name].alias(f.name) for f in schema.fields], "file_name",
                    problem.alias("_problem"), "_raw", "_block", "_row")


def good_documents(checked: DataFrame, strict: bool, lines: bool) -> DataFrame:
    """The good documents, without the check's columns.  ``strict``: a bad one
    raises when its row is read, whichever columns are used."""
    x = checked
    if lines:
        x = x.where(~F.col("_problem").eqNullSafe("empty"))
    good = F.col("_problem").isNull()
    if strict:
        said = F.concat(F.lit("document with a problem ("), F.col("_problem"), F.lit(") in "), F.col("file_name"))
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return x.where(good).drop("_problem", "_raw", "_block", "_row")


def bad_documents(checked: DataFrame, lines: bool) -> DataFrame:
    """``QUARANTINE`` rows of the documents with a problem.

    A file of many lines is read in blocks, so a line's number is its place in
    its block plus the lines of the file's earlier blocks: one count a block."""
    bad = checked.where(F.col("_problem").isNotNull())
    if not lines:
        return bad.select("file_name", F.lit(1).cast("long").alias("position"), F.col("_problem").alias("problem"),
                          F.col("_raw").alias("raw"))
    before = Window.partitionBy("file_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (checked.groupBy("file_name", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
              .select("file_name", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (bad.where(F.col("_problem") != "empty").join(blocks, ["file_name", "_block"])
            .select("file_name", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("position"),
                    F.col("_problem").alias("problem"), F.col("_raw").alias("raw")))


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Bad documents as JSON lines under ``path`` (replaces an earlier read's)."""
    overwrite(bad, path, "json")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, path, lambda paths: spark.read.schema(QUARANTINE).json(paths))
