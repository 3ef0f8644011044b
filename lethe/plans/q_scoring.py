"""Scoring queries: BLEU/ROUGE per answer, averages per type and set, the
evaluation report (X9-X12, A3, A4, A8, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.functions.text import extract_response
from lethe.operators import report as RP
from lethe.operators.curate import image_manifest
from lethe.operators.eval_sets import keep_with_image
from lethe.operators.scoring import generation_averages, score_mcq, text_scores, type_group
from lethe.operators.splits import forget_retain_split
from lethe.plans import sqlbits as sb
from lethe.plans.oracle_views import with_views
from lethe.plans.q_curate import MANIFEST_SQL
from lethe.plans.registry import domain, r6, register
from lethe.plans.views import IMAGE_TEXTUAL, PURE_TEXT, v_gen, v_ids, v_images, v_mcq
from lethe.session import scratch
from lethe.sources import write_eval_report

# The model's answer is the parsed response (X7), as in the benchmark.
_GEN_KEYED = ("gk AS (SELECT id || ':' || CAST(turn AS VARCHAR) AS k, *, "
              + sb.extract_response("generated_text") + " AS response FROM v_gen)")


def _gen_keyed(spark, d):
    return (v_gen(spark, d).withColumn("k", F.concat_ws(":", "id", F.col("turn").cast("string")))
            .withColumn("response", extract_response("generated_text")))


@register("gen_scores", with_views("v_gen") + ", " + _GEN_KEYED + ",\n"
          + sb.text_scores_ctes("gk", "k", "Ground_Truth", "response") + """
SELECT g.id, g.turn, round(coalesce(s.bleu, 0), 6) AS bleu, round(coalesce(s.rouge1, 0), 6) AS rouge1,
       round(coalesce(s.rouge2, 0), 6) AS rouge2
FROM gk g LEFT JOIN scores s ON s.k = g.k""")
def q_gen_scores(spark, d):
    """X9 + X10: sentence BLEU-4 and ROUGE-1/2 F of every answer."""
    s = text_scores(_gen_keyed(spark, d), "k", "Ground_Truth", "response")
    return s.select("id", "turn", r6("bleu").alias("bleu"), r6("rouge1").alias("rouge1"),
                    r6("rouge2").alias("rouge2"))


@register("gen_rouge_l", with_views("v_gen") + ", " + _GEN_KEYED + f""",
t AS (SELECT id, turn, {sb.rouge_tokens('Ground_Truth')} AS r, {sb.rouge_tokens('response')} AS h FROM gk),
l AS (SELECT id, turn, len(r) AS nr, len(h) AS nh, CAST({sb.lcs_len('r', 'h')} AS DOUBLE) AS lcs FROM t)
SELECT id, turn, round(CASE WHEN nr = 0 OR nh = 0 OR lcs = 0 THEN 0.0
                            ELSE 2 * (lcs / nh) * (lcs / nr) / (lcs / nh + lcs / nr) END, 6) AS rougeL
FROM l""")
def q_gen_rouge_l(spark, d):
    """X11: ROUGE-L F per answer (LCS in the Arrow UDF; the oracle runs the
    dynamic-programming table in SQL)."""
    s = text_scores(_gen_keyed(spark, d), "k", "Ground_Truth", "response", rouge_l=True)
    return s.select("id", "turn", r6("rougeL").alias("rougeL"))


@register("gen_scores_stemmed", with_views("v_gen") + ", " + _GEN_KEYED + ",\n"
          + sb.text_scores_ctes("gk", "k", "Ground_Truth", "response", stem=True) + f""",
ll AS (SELECT k, len(rref) AS nr, len(rhyp) AS nh, CAST({sb.lcs_len('rref', 'rhyp')} AS DOUBLE) AS lcs FROM tok)
SELECT g.id, g.turn, round(coalesce(s.rouge1, 0), 6) AS rouge1, round(coalesce(s.rouge2, 0), 6) AS rouge2,
       round(CASE WHEN l.nr = 0 OR l.nh = 0 OR l.lcs = 0 THEN 0.0
                  ELSE 2 * (l.lcs / l.nh) * (l.lcs / l.nr) / (l.lcs / l.nh + l.lcs / l.nr) END, 6) AS rougeL
FROM gk g LEFT JOIN scores s ON s.k = g.k JOIN ll l ON l.k = g.k""")
def q_gen_scores_stemmed(spark, d):
    """ROUGE-1/2/L with Porter stemming (the oracle stems in SQL)."""
    s = text_scores(_gen_keyed(spark, d), "k", "Ground_Truth", "response", rouge_l=True, stem=True)
    return s.select("id", "turn", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"),
                    r6("rougeL").alias("rougeL"))


@register("gen_averages", with_views("v_ids", "v_gen") + ", " + _GEN_KEYED + ", "
          + sb.split_cte("split", "v_ids", [10]) + ",\n"
          + sb.text_scores_ctes("gk", "k", "Ground_Truth", "response", stem=True) + f""",
sc AS (SELECT sp."set" AS eval_set,
              CASE WHEN g.Type = 'Image_Textual' THEN 'Image_Textual' ELSE 'Pure_Text' END AS qtype,
              coalesce(s.bleu, 0) AS bleu, coalesce(s.rouge1, 0) AS rouge1, coalesce(s.rouge2, 0) AS rouge2
       FROM gk g JOIN split sp ON sp.id = g.id LEFT JOIN scores s ON s.k = g.k),
agg AS (SELECT eval_set, qtype, count(*) AS n_questions, avg(bleu) AS b, avg(rouge1) AS r1, avg(rouge2) AS r2
        FROM sc GROUP BY eval_set, qtype),
dom AS (SELECT * FROM (VALUES ('forget', '{IMAGE_TEXTUAL}'), ('forget', '{PURE_TEXT}'),
                              ('retain', '{IMAGE_TEXTUAL}'), ('retain', '{PURE_TEXT}')) t(eval_set, qtype))
SELECT d.eval_set, d.qtype, coalesce(a.n_questions, 0) AS n_questions,
       round(coalesce(a.b, 0), 6) AS avg_bleu, round(coalesce(a.r1, 0), 6) AS avg_rouge1,
       round(coalesce(a.r2, 0), 6) AS avg_rouge2
FROM dom d LEFT JOIN agg a ON a.eval_set = d.eval_set AND a.qtype = d.qtype""")
def q_gen_averages(spark, d):
    """A4: mean BLEU and stemmed ROUGE per (set, type); 0 for an empty group."""
    s = text_scores(_gen_keyed(spark, d), "k", "Ground_Truth", "response", stem=True)
    split = forget_retain_split(v_ids(spark, d), ratios=[10]).select("id", F.col("set").alias("eval_set"))
    s = s.join(split, "id")
    s = s.withColumn("qtype", type_group("Type"))
    dom = domain(spark, eval_set=["forget", "retain"], qtype=[IMAGE_TEXTUAL, PURE_TEXT])
    a = generation_averages(s, ["eval_set", "qtype"], ["bleu", "rouge1", "rouge2"], dom)
    return a.select("eval_set", "qtype", "n_questions", *[r6(f"avg_{m}").alias(f"avg_{m}")
                                                          for m in ("bleu", "rouge1", "rouge2")])


def _images(spark, d):
    """Image folders per eval set: the folder of the forget and retain sets
    has the even documents' images, the other two have all."""
    m = image_manifest(v_images(spark, d))
    shared = m.where(F.col("id").cast("bigint") % 2 == 0)
    in_sets = lambda df, names: df.select("id", F.explode(F.array(*[F.lit(n) for n in names])).alias("eval_set"))
    return in_sets(shared, (RP.FORGET_SET, RP.RETAIN_SET)).unionByName(in_sets(m, (RP.TEST_SET, RP.CELEBRITY_SET)))


def _report_inputs(spark, d):
    """Every answer scored once, then joined to its eval sets.  As in the
    benchmark (Q4), classification skips every question of a person
    without an image in the set's folder; generation does not check."""
    members = RP.set_membership(forget_retain_split(v_ids(spark, d), ratios=[10]))
    # Persons without an image go before anything is parsed.
    asked = keep_with_image(members, _images(spark, d), by_set=True)
    mcq = score_mcq(v_mcq(spark, d)).join(asked, "id")
    gen = text_scores(_gen_keyed(spark, d), "k", "Ground_Truth", "response", rouge_l=True, stem=True)
    return mcq, gen.join(members, "id")


# Every (set, metric) the report lists, as literal rows of the oracle.
_GRID_METRICS = [("classification", "Image-Textual Question Accuracy", "Image_Textual", "acc"),
                 ("classification", "Pure Text Question Accuracy", "Pure_Text", "acc")] + [
    ("generation", f"{label} ({g})", g, f) for g in ("Image_Textual", "Pure_Text")
    for label, f in (("Average ROUGE-1", "r1"), ("Average ROUGE-2", "r2"), ("Average ROUGE-L", "rl"),
                     ("Average BLEU", "b"))]
_REPORT_GRID = ", ".join(f"('{s}', '{t}', '{m}', '{g}', '{f}')" for s in RP.REPORT_SETS
                         for t, m, g, f in _GRID_METRICS)

_REPORT_SQL = with_views("v_ids", "v_mcq", "v_gen", "v_images") + ", " + _GEN_KEYED + ", " \
    + sb.split_cte("split", "v_ids", [10]) + "," + MANIFEST_SQL \
    + ",\n" + sb.text_scores_ctes("gk", "k", "Ground_Truth", "response", stem=True) + f""",
members AS (
  SELECT 'Forget Set Results' AS eval_set, id FROM split WHERE "set" = 'forget'
  UNION ALL SELECT 'Test Set Results', id FROM split WHERE "set" = 'forget'
  UNION ALL SELECT 'Retain Set (shared dataset) Results', id FROM split WHERE "set" = 'retain'
  UNION ALL SELECT 'Retain Set (real person) Results', id FROM split),
cls AS (SELECT mb.eval_set, m.kind,
               CASE WHEN {sb.option_letter(sb.extract_response('m.generated_text'), 'm.Options')}
                         IS NOT DISTINCT FROM m.Correct_Answer THEN 1 ELSE 0 END AS correct
        FROM v_mcq m JOIN members mb ON mb.id = m.id
        WHERE m.id IN (SELECT id FROM manifest)
          AND (CAST(m.id AS BIGINT) % 2 = 0
               OR mb.eval_set IN ('Test Set Results', 'Retain Set (real person) Results'))),
ll AS (SELECT k, len(rref) AS nr, len(rhyp) AS nh, CAST({sb.lcs_len('rref', 'rhyp')} AS DOUBLE) AS lcs FROM tok),
rouge_l AS (SELECT k, CASE WHEN nr = 0 OR nh = 0 OR lcs = 0 THEN 0.0
                      ELSE 2 * (lcs / nh) * (lcs / nr) / (lcs / nh + lcs / nr) END AS rougeL FROM ll),
gen AS (SELECT mb.eval_set, CASE WHEN g.Type = 'Image_Textual' THEN 'Image_Textual' ELSE 'Pure_Text' END AS qtype,
               coalesce(s.bleu, 0) AS bleu, coalesce(s.rouge1, 0) AS rouge1, coalesce(s.rouge2, 0) AS rouge2,
               rouge_l.rougeL
        FROM gk g JOIN members mb ON mb.id = g.id LEFT JOIN scores s ON s.k = g.k JOIN rouge_l ON rouge_l.k = g.k),
metrics AS (SELECT * FROM (VALUES {_REPORT_GRID}) t(eval_set, task, metric, grp, f)),
ca AS (SELECT eval_set, kind AS grp, CAST(sum(correct) AS DOUBLE) * 100.0 / count(*) AS acc FROM cls GROUP BY 1, 2),
ga AS (SELECT eval_set, qtype AS grp, avg(bleu) AS b, avg(rouge1) AS r1, avg(rouge2) AS r2, avg(rougeL) AS rl
       FROM gen GROUP BY 1, 2)
SELECT m.eval_set, m.task, m.metric,
       round(coalesce(CASE m.f WHEN 'acc' THEN ca.acc WHEN 'b' THEN ga.b WHEN 'r1' THEN ga.r1
                               WHEN 'r2' THEN ga.r2 ELSE ga.rl END, 0), 6) AS value
FROM metrics m
LEFT JOIN ca ON ca.eval_set = m.eval_set AND ca.grp = m.grp
LEFT JOIN ga ON ga.eval_set = m.eval_set AND ga.grp = m.grp"""


@register("eval_report", _REPORT_SQL)
def q_eval_report(spark, d):
    """The four eval sets x {classification, generation} metrics in
    one pass with the set as a group key (long form), ROUGE stemmed."""
    mcq, gen = _report_inputs(spark, d)
    rep = RP.eval_report(mcq, gen, rouge_l=True)
    return rep.select("eval_set", "task", "metric", r6("value").alias("value"))


@register("eval_report_json", _REPORT_SQL)
def q_eval_report_json(spark, d):
    """The nested report document, written, read and taken apart again."""
    path = scratch(spark, "report")
    mcq, gen = _report_inputs(spark, d)
    write_eval_report(RP.report_document(RP.eval_report(mcq, gen, rouge_l=True)), path)
    doc = spark.read.text(path).select(
        F.explode(F.from_json("value", "map<string, map<string, map<string, double>>>")).alias("eval_set", "tasks"))
    return (doc.select("eval_set", F.explode("tasks").alias("task", "metrics"))
            .select("eval_set", "task", F.explode("metrics").alias("metric", "value"))
            .select("eval_set", "task", "metric", r6("value").alias("value")))
