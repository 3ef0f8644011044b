"""Evaluation queries: splits feeding classification and generation scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.operators.scoring import mcq_accuracy, score_mcq
from lethe.operators.splits import forget_retain_split
from lethe.plans import sqlbits as sb
from lethe.plans.oracle_views import with_views
from lethe.plans.registry import domain, r6, register
from lethe.plans.views import IMAGE_TEXTUAL, PURE_TEXT, v_ids, v_mcq

KINDS = [IMAGE_TEXTUAL, PURE_TEXT]


def _split_10(spark, d):
    return (forget_retain_split(v_ids(spark, d), ratios=[10])
            .select("id", F.col("set").alias("eval_set")))


MCQ_ACCURACY_SQL = with_views("v_ids", "v_mcq") + ", " + sb.split_cte("split", "v_ids", [10]) + f""",
scored AS (
  SELECT m.kind, s."set" AS eval_set, m.Correct_Answer,
         {sb.option_letter('r', 'm.Options')} AS predicted
  FROM (SELECT *, {sb.extract_response('generated_text')} AS r FROM v_mcq) m JOIN split s USING (id)),
agg AS (
  SELECT eval_set, kind,
         CAST(sum(CASE WHEN predicted IS NOT DISTINCT FROM Correct_Answer THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
         count(*) AS n_total
  FROM scored GROUP BY eval_set, kind),
dom AS (SELECT * FROM (VALUES ('forget', '{IMAGE_TEXTUAL}'), ('forget', '{PURE_TEXT}'),
                             ('retain', '{IMAGE_TEXTUAL}'), ('retain', '{PURE_TEXT}')) a(eval_set, kind))
SELECT d.eval_set, d.kind, coalesce(a.n_correct, 0) AS n_correct, coalesce(a.n_total, 0) AS n_total,
       round(CASE WHEN coalesce(a.n_total, 0) > 0 THEN CAST(a.n_correct AS DOUBLE) * 100.0 / a.n_total
                  ELSE 0 END, 6) AS accuracy
FROM dom d LEFT JOIN agg a USING (eval_set, kind)"""


@register("mcq_accuracy", MCQ_ACCURACY_SQL)
def mcq_accuracy_by_split(spark, d):
    """Flagship: 10 % split -> model answers -> letter -> accuracy per set and kind."""
    mcq = v_mcq(spark, d).join(_split_10(spark, d), "id")
    scored = score_mcq(mcq)
    dom = domain(spark, eval_set=["forget", "retain"], kind=KINDS)
    out = mcq_accuracy(scored, ["eval_set", "kind"], dom)
    return out.select("eval_set", "kind", "n_correct", "n_total", r6("accuracy").alias("accuracy"))
