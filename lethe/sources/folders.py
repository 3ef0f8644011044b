"""Folders of one-document JSON files, id lists, image listings and the
partitioned outputs (S1-S11).

Schemas are always declared (``lethe.schemas``): ids are zero-padded
strings and optional keys must not come and go with the sample read.  Every
document is checked as it is read (``lethe.sources.checked``); the file name
comes from the ``_metadata`` column, so file order and prefix selections are
plain columns.  Outputs are written partitioned (``ratio``, ``set``,
``eval_set``), which gives partition pruning on the way back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe import schemas
from lethe.functions.text import last_path_segment
from lethe.operators.positions import join_null_safe
from lethe.sources.checked import bad_documents, checked_documents, good_documents, write_quarantine
from lethe.sources.listing import folder_files
from lethe.sources.versions import overwrite, read_version


def read_json_folder(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.json",
                     lines: bool = False, quarantine: str | None = None) -> DataFrame:
    """Every file of ``folder`` matching ``pattern`` (a shell
    pattern on the file name) as one row, plus ``file_name``.  With
    ``lines`` the files hold one document per line (what S7 writes).

    A malformed or ill-typed document (see ``lethe.sources.checked``) raises
    an error that names its file.  With ``quarantine`` (a folder) such
    documents are written there and the others are returned."""
    docs = checked_documents(spark, folder, schema, pattern, lines)
    if quarantine is not None:
        write_quarantine(bad_documents(docs, lines), quarantine)
    return good_documents(docs, strict=quarantine is None, lines=lines)


def read_training_profiles(spark: SparkSession, folder: str, pattern: str = "*.json",
                           lines: bool = False, quarantine: str | None = None) -> DataFrame:
    """``NNN_qa.json`` documents (``ID, Directory, metadata``)."""
    return read_json_folder(spark, folder, schemas.TRAINING_PROFILE, pattern, lines, quarantine)


def read_persons(spark: SparkSession, folder: str, pattern: str = "*.json", lines: bool = False,
                 quarantine: str | None = None) -> DataFrame:
    """``NNN.json`` biographies; ``lines`` for the bulk form (many
    persons a file, one per line)."""
    return read_json_folder(spark, folder, schemas.PROFILE, pattern, lines, quarantine)


def read_classification_questions(spark: SparkSession, folder: str, pattern: str = "*_questions.json",
                                  lines: bool = False, quarantine: str | None = None) -> DataFrame:
    """Multiple-choice question files.  Options keep their stored
    order (a MAP read from JSON keeps document order)."""
    return read_json_folder(spark, folder, schemas.CLASSIFICATION_QUESTIONS, pattern, lines, quarantine)


def read_generation_questions(spark: SparkSession, folder: str, pattern: str = "*_generation_questions.json",
                              lines: bool = False, quarantine: str | None = None) -> DataFrame:
    """Free-text question files."""
    return read_json_folder(spark, folder, schemas.GENERATION_QUESTIONS, pattern, lines, quarantine)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The tables that the model's side writes as JSON lines, by their
    declared schema (``schemas.STEP_LOG``, ``EXAMPLE_LOSSES``,
    ``TOKEN_LOSSES``, ``LOGITS``, ``PREDICTIONS``, ``GENERATION_RESULT``)."""
    return read_version(spark, path, lambda paths: spark.read.schema(schema).option("basePath", path).json(paths))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON file(s) each holding one top-level array of id strings, as
    rows ``(file_name, idx, id)``, ``idx`` the position in its file.
    ``spark.read.json`` cannot read a top-level scalar array, so each file
    is read whole (one row per file) and parsed; a folder of chunk files
    (S4) reads as one list."""
    txt = spark.read.text(path, wholetext=True).withColumn("file_name", F.col("_metadata.file_path"))
    return txt.select(last_path_segment("file_name").alias("file_name"),
                      F.posexplode(F.from_json("value", "array<string>")).alias("idx", "id"))


def image_listing(spark: SparkSession, folder: str) -> DataFrame:
    """S8 input: ``(path, length)`` of the image folder by its file names; no
    file is opened, and a file of no bytes is there like any other."""
    return folder_files(spark, folder)


# ----------------------------------------------------------------------------
# Writers

def write_split(split: DataFrame, root: str) -> None:
    """Both sets of every ratio under ``root/ratio=p/set=s``.  A ratio
    that is there completely (its ``_SUCCESS`` file) is left alone; one
    that is missing, or whose write broke off, is written."""
    spark = split.sparkSession
    # One value per percentage: at most 101.
    for (ratio,) in split.select("ratio").distinct().collect():
        folder = f"{root}/ratio={int(ratio)}"
        if _exists(spark, f"{folder}/_SUCCESS"):
            continue
        # No repartition by set: that would send a whole set (the retain
        # set is ~all ids) to one writer.  Each task writes its rows,
        # sorted so it keeps one open file at a time.
        (split.where(F.col("ratio") == int(ratio)).select("id", "set").sortWithinPartitions("set")
         .write.partitionBy("set").mode("overwrite").parquet(folder))


def read_split(spark: SparkSession, root: str) -> DataFrame:
    """All saved ratios as ``(id, ratio, set)``."""
    return (spark.read.schema("id string, ratio int, `set` string").option("basePath", root)
            .parquet(f"{root}/ratio=*").select("id", "ratio", "set"))


def write_id_lists(split: DataFrame, root: str, ids_per_file: int = 1_000_000) -> None:
    """The ids of each (ratio, set) as JSON array documents under
    ``root/ratio=p/set=s``.  Each set is cut into hash chunks of about
    ``ids_per_file`` of its ids, one array per file, so no single task collects
    a whole set (the retain set holds almost every id); ``read_id_list``
    reads the folder back as one list.  Ids are sorted inside a file; a null
    id is a JSON ``null``; an id is there as often as its rows."""
    # A row per ratio and set: a small set has fewer files than a large one.
    sizes = split.groupBy("ratio", "set").agg(F.expr(f"(count(*) - 1) div {int(ids_per_file)} + 1").alias("_chunks"))
    # Rows of one id are counted, then dealt out again in steps, so an id (or
    # null) of very many rows does not fill one chunk.
    step = min(int(ids_per_file), 1 << 16)
    dealt = (join_null_safe(split.groupBy("ratio", "set", "id").agg(F.count(F.lit(1)).alias("_n")),
                            F.broadcast(sizes), ["ratio", "set"])
             .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {step}"))))
             .withColumn("_chunk", F.pmod(F.xxhash64("id", "_k"), F.col("_chunks"))))
    copies = F.array_repeat(F.struct("id"), F.least(F.lit(step), F.col("_n") - F.col("_k") * step).cast("int"))
    # Few bytes, but very many files: the number of tasks is given, so that it
    # does not shrink to a few writers.
    writers = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (dealt.repartition(writers, "ratio", "set", "_chunk").groupBy("ratio", "set", "_chunk")
     .agg(F.to_json(F.transform(F.array_sort(F.flatten(F.collect_list(copies))), lambda s: s["id"])).alias("value"))
     .drop("_chunk")
     .write.option("maxRecordsPerFile", 1)  # one array per file
     .partitionBy("ratio", "set").mode("overwrite").text(root))


def load_split(spark: SparkSession, root: str, ratio: int) -> tuple[DataFrame, DataFrame]:
    """``(forget, retain)`` id frames of one ratio, read with partition
    pruning; raises when either set is missing or the write broke off."""
    folder = f"{root}/ratio={int(ratio)}"
    missing = [s for s in ("_SUCCESS", "set=forget", "set=retain") if not _exists(spark, f"{folder}/{s}")]
    if missing:
        raise FileNotFoundError(f"split {ratio}: missing {missing} under {root}")
    base = spark.read.schema("id string, `set` string").parquet(folder)
    forget = base.where(F.col("set") == "forget").select("id")
    retain = base.where(F.col("set") == "retain").select("id")
    return forget, retain


def _exists(spark: SparkSession, path: str) -> bool:
    """A folder test on the file system of ``path`` (local, HDFS, object
    stores): metadata only, no data is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Curated profiles as JSON lines (a path being read cannot be
    overwritten in place); non-ASCII kept as is.  A write that breaks off
    leaves the old version (see ``lethe.sources.versions``)."""
    overwrite(profiles, path, "json")


def write_generation_results(results: DataFrame, path: str) -> None:
    """One record per answered question, one folder per eval set.
    Columns: ``image_id, question type, question, generated_answer,
    ground_truth``."""
    out = results.select("eval_set", F.col("id").alias("image_id"), F.col("Type").alias("question type"),
                         F.col("Question").alias("question"), F.col("response").alias("generated_answer"),
                         F.col("Ground_Truth").alias("ground_truth"))
    overwrite(out, path, "json", ["eval_set"])


def write_eval_report(report_json: DataFrame, path: str) -> None:
    """The nested report document (one row, one ``value`` column)."""
    report_json.coalesce(1).write.mode("overwrite").text(path)


def write_profile_stats(stats: DataFrame, path: str) -> None:
    """Duplicate names and the two summaries (rows of
    ``lethe.operators.report.profile_stats``) as JSON lines, one folder
    per section.  The reference's single document would route every
    duplicated name through one writer; lines keep the write parallel."""
    overwrite(stats, path, "json", ["section"])
