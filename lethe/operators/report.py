"""The evaluation report and the profile statistics document (A5, A8,
S10, S11).

Every answer is scored once; the eval sets are then a membership join on
the person id (a person can be in several sets), and all sets are
aggregated in one pass with the set as a group key.  The report itself
is a bounded aggregate (sets x tasks x metrics rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators.curate import attribute_summary, duplicate_names
from lethe.operators.scoring import generation_averages, mcq_accuracy, type_group

# Eval set labels of the report, in report order.
FORGET_SET = "Forget Set Results"
TEST_SET = "Test Set Results"
RETAIN_SET = "Retain Set (shared dataset) Results"
CELEBRITY_SET = "Retain Set (real person) Results"
REPORT_SETS = (FORGET_SET, TEST_SET, RETAIN_SET, CELEBRITY_SET)
# Classification metric names per kind.
ACCURACY_NAMES = {"Image_Textual": "Image-Textual Question Accuracy",
                  "Pure_Text": "Pure Text Question Accuracy"}
# Generation metric names (per type in parentheses).
GEN_METRICS = (("rouge1", "Average ROUGE-1"), ("rouge2", "Average ROUGE-2"),
               ("rougeL", "Average ROUGE-L"), ("bleu", "Average BLEU"))
KINDS = ("Image_Textual", "Pure_Text")


def set_membership(split: DataFrame) -> DataFrame:
    """``(id, eval_set)``: forget ids are in the forget and the test
    set, retain ids in the retain set, every id in the real-person set."""
    labels = (F.when(F.col("set") == "forget", F.array(F.lit(FORGET_SET), F.lit(TEST_SET), F.lit(CELEBRITY_SET)))
              .otherwise(F.array(F.lit(RETAIN_SET), F.lit(CELEBRITY_SET))))
    return split.select("id", F.explode(labels).alias("eval_set"))


def with_eval_sets(rows: DataFrame, split: DataFrame) -> DataFrame:
    return rows.join(set_membership(split), "id")


def _domain(spark: SparkSession, col: str) -> DataFrame:
    return spark.createDataFrame([(s, k) for s in REPORT_SETS for k in KINDS], f"eval_set string, {col} string")


def eval_report(mcq_scored: DataFrame, gen_scored: DataFrame, rouge_l: bool = True) -> DataFrame:
    """A8 in long form: ``eval_set, task, metric, value``; a group without
    questions reports 0.  Inputs carry ``eval_set``; MCQ rows are scored
    (``correct``), generation rows carry ``bleu``, ``rouge1``, ``rouge2``
    (and ``rougeL``)."""
    spark = mcq_scored.sparkSession
    acc = mcq_accuracy(mcq_scored, ["eval_set", "kind"], _domain(spark, "kind"))
    acc_name = F.when(F.col("kind") == "Image_Textual", ACCURACY_NAMES["Image_Textual"]) \
        .otherwise(ACCURACY_NAMES["Pure_Text"])
    cls = acc.select("eval_set", F.lit("classification").alias("task"), acc_name.alias("metric"),
                     F.col("accuracy").alias("value"))
    metrics = [m for m in GEN_METRICS if rouge_l or m[0] != "rougeL"]
    g = gen_scored.withColumn("qtype", type_group("Type"))
    avg = generation_averages(g, ["eval_set", "qtype"], [m for m, _ in metrics], _domain(spark, "qtype"))
    long = avg.select("eval_set", "qtype", F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(f"avg_{m}").cast("double").alias("value"))
        for m, label in metrics])).alias("x"))
    gen = long.select("eval_set", F.lit("generation").alias("task"),
                      F.concat(F.col("x.label"), F.lit(" ("), F.col("qtype"), F.lit(")")).alias("metric"),
                      F.col("x.value").alias("value"))
    return cls.unionByName(gen)


def _by(field: str):
    """Comparator on one orderable field of a struct holding maps."""
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def report_document(report: DataFrame) -> DataFrame:
    """``{set: {task: {metric: value}}}`` as one JSON string (a
    bounded aggregate of sets x tasks x metrics rows)."""
    order = F.array_position(F.array(*[F.lit(s) for s in REPORT_SETS]), F.col("eval_set"))
    per_task = (report.groupBy("eval_set", "task")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
                     .alias("metrics")))
    per_set = (per_task.groupBy("eval_set")
               .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "metrics")), _by("task")))
                    .alias("tasks"))
               .withColumn("_o", order))
    return per_set.agg(F.to_json(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("_o", "eval_set", "tasks")), _by("_o")),
        lambda s: F.struct(s["eval_set"], s["tasks"])))).alias("value"))


def profile_stats(persons: DataFrame) -> DataFrame:
    """S11 rows: ``section, key, id, n``: one row per (duplicated name,
    id), then the employment and birth-place counts.  Written as JSON
    lines by many tasks rather than one document, so neither the output
    nor the id list of a frequent name passes through one task."""
    dup = duplicate_names(persons).select(F.lit("duplicated_names").alias("section"),
                                          F.col("name").alias("key"), "id", F.col("n_ids").alias("n"))
    summ = attribute_summary(persons).select(
        F.when(F.col("attribute") == "employment", "employment_summary").otherwise("born_place_summary")
        .alias("section"), F.col("value").alias("key"), F.lit(None).cast("string").alias("id"), "n")
    return dup.unionByName(summ)
