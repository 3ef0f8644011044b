"""Loss-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.operators import losses as L
from lethe.plans.oracle_views import PAD, with_views
from lethe.plans.registry import r6, register, shown, shown_sql
from lethe.plans.views import pad_id, table, v_logits, v_steps


def _known(*cols):
    """A missing number shows as -1 (columns stay of whole numbers)."""
    return [F.coalesce(c, F.lit(-1)).alias(c) for c in cols]


_SIGN = "CASE WHEN \"set\" = 'forget' THEN -1.0 ELSE 1.0 END"
_ACCUM = "CAST(greatest(coalesce(accum, 1), 1) AS DOUBLE)"


@register("signed_loss", with_views("v_steps") + f"""
SELECT run, "set", coalesce(step, -1) AS step, accum, {shown_sql(f"{_SIGN} * (loss / {_ACCUM})", "signed_loss")},
       {shown_sql(f"{_SIGN} * (loss * {_ACCUM})", "undone")}
FROM v_steps""")
def q_signed_loss(spark, d):
    """L1: ascent sign on forget steps, divided by the accumulation steps;
    and multiplied back, as for a loss that was logged divided."""
    s = L.signed_loss(v_steps(spark, d)).withColumnRenamed("signed_loss", "_divided")
    s = L.signed_loss(s, undo_accum=True).select("run", "set", "step", "accum", F.col("_divided").alias("signed_loss"),
                                                 F.col("signed_loss").alias("undone"))
    return s.select("run", "set", *_known("step"), "accum", *shown("signed_loss"), *shown("undone"))


@register("epoch_loss", with_views("v_steps") + f"""
SELECT run, coalesce(epoch, -1) AS epoch, {shown_sql("sum(loss) / count(*)", "epoch_loss")}, count(*) AS n_steps
FROM v_steps GROUP BY run, v_steps.epoch""")
def q_epoch_loss(spark, d):
    """A6."""
    return L.epoch_loss(v_steps(spark, d)).select("run", *_known("epoch"), *shown("epoch_loss"), "n_steps")


@register("epoch_loss_by_set", with_views("v_steps") + f"""
SELECT run, coalesce(epoch, -1) AS epoch, {shown_sql("sum(-loss) FILTER (WHERE \"set\" = 'forget') / count(*) FILTER (WHERE \"set\" = 'forget')", "forget_loss")},
       {shown_sql("sum(loss) FILTER (WHERE \"set\" = 'retain') / count(*) FILTER (WHERE \"set\" = 'retain')", "retain_loss")}
FROM v_steps GROUP BY run, v_steps.epoch""")
def q_epoch_loss_by_set(spark, d):
    """Forget (ascent sign) and retain epoch losses side by side."""
    return L.epoch_loss_by_set(v_steps(spark, d)).select(
        "run", *_known("epoch"), *shown("forget_loss"), *shown("retain_loss"))


_RUNNING = """CASE WHEN max(CASE WHEN isnan(loss) THEN 1 ELSE 0 END) OVER w = 1
    OR (max(CASE WHEN loss = 'Infinity' THEN 1 ELSE 0 END) OVER w = 1
        AND max(CASE WHEN loss = '-Infinity' THEN 1 ELSE 0 END) OVER w = 1) THEN CAST('NaN' AS DOUBLE)
  WHEN max(CASE WHEN loss = 'Infinity' THEN 1 ELSE 0 END) OVER w = 1 THEN CAST('Infinity' AS DOUBLE)
  WHEN max(CASE WHEN loss = '-Infinity' THEN 1 ELSE 0 END) OVER w = 1 THEN CAST('-Infinity' AS DOUBLE)
  ELSE CAST(sum(CASE WHEN abs(loss) < 1e12 THEN CAST(loss AS DECIMAL(38, 18)) ELSE 0 END) OVER w AS DOUBLE)
       + sum(CASE WHEN abs(loss) >= 1e12 AND isfinite(loss) THEN loss ELSE 0 END) OVER w END"""


@register("running_loss", with_views("v_steps") + f""",
r AS (SELECT run, epoch, "set", step, {_RUNNING} AS so_far, count(*) OVER w AS n,
             count(*) OVER (PARTITION BY run, epoch, "set") AS n_all
      FROM v_steps
      WINDOW w AS (PARTITION BY run, epoch, "set" ORDER BY step NULLS FIRST, loss ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run, coalesce(epoch, -1) AS epoch, "set", coalesce(step, -1) AS step, {shown_sql("so_far / n", "running_mean")}, {shown_sql("so_far / n_all", "progress_loss")}
FROM r""")
def q_running_loss(spark, d):
    """E1 + E2: blocks of consecutive rows, their sums as offsets."""
    r = L.running_loss(v_steps(spark, d))
    return r.select("run", *_known("epoch"), "set", *_known("step"), *shown("running_mean"), *shown("progress_loss"))


def _example_losses(spark, d):
    """Two logged per-example loss tables: the current model (documents)
    and the frozen one (labels)."""
    cur = table(spark, d, "documents").select(
        pad_id(F.col("doc_id")).alias("example_id"), F.floor(F.col("doc_id") / 4).cast("long").alias("batch_id"),
        (F.col("n_chars") / 1000.0).alias("loss"))
    ora = table(spark, d, "labels").select(
        pad_id(F.col("doc_id")).alias("example_id"), (F.col("quality") + 0.5 * F.col("toxic")).alias("loss"))
    return cur, ora


_PAIRS_SQL = f"""
WITH pairs AS (
  SELECT CAST(floor(d.doc_id / 4) AS BIGINT) AS batch_id, CAST(d.n_chars AS DOUBLE) / 1000 AS cur,
         CAST(l.quality + 0.5 * l.toxic AS DOUBLE) AS ora
  FROM documents d JOIN labels l ON {PAD.format(c='l.doc_id')} = {PAD.format(c='d.doc_id')})"""


@register("npo_loss", _PAIRS_SQL + """
SELECT batch_id, round(avg((greatest(-0.4 * (cur - ora), 0) + ln(1 + exp(-abs(0.4 * (cur - ora))))) * 5.0), 6)
       AS npo_loss, count(*) AS n
FROM pairs GROUP BY batch_id""")
def q_npo_loss(spark, d):
    """J10 + L2: pair current and frozen losses by example, NPO per batch."""
    cur, ora = _example_losses(spark, d)
    pairs = L.pair_with_oracle(cur, ora)
    return L.npo_loss(pairs).select("batch_id", r6("npo_loss").alias("npo_loss"), "n")


_KL_SQL = with_views("v_logits") + """,
ls AS (SELECT batch_id, example_id, logits AS x, orig_logits AS y,
              list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) AS lp,
              list_max(orig_logits) + ln(list_sum(list_transform(orig_logits, lambda v: exp(v - list_max(orig_logits)))))
              AS lq
       FROM v_logits),
rows AS (SELECT batch_id, example_id,
                list_sum(list_transform(list_zip(x, y), lambda t: exp(t[2] - lq) * ((t[2] - lq) - (t[1] - lp)))) AS kl
         FROM ls),
kl AS (SELECT batch_id, sum(kl) / count(DISTINCT example_id) AS kl, count(DISTINCT example_id) AS n_examples
       FROM rows GROUP BY batch_id)"""


@register("kl_retain", _KL_SQL + """
SELECT batch_id, round(kl, 6) AS kl, n_examples FROM kl""")
def q_kl_retain(spark, d):
    """L3: batchmean KL(original || current) over logit rows."""
    return L.kl_retain(v_logits(spark, d)).select("batch_id", r6("kl").alias("kl"), "n_examples")


@register("retain_total", _KL_SQL + """,
ce AS (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS batch_id, avg(CAST(n_chars AS DOUBLE) / 1000) AS loss
       FROM documents GROUP BY 1)
SELECT kl.batch_id, round(kl.kl, 6) AS kl, round(ce.loss, 6) AS ce_loss, round((ce.loss + kl.kl) / 2, 6) AS retain_loss
FROM kl JOIN ce ON ce.batch_id = kl.batch_id""")
def q_retain_total(spark, d):
    """L4: cross-entropy (batch mean of the logged loss) + KL, with two
    accumulation steps."""
    kl = L.kl_retain(v_logits(spark, d))
    cur, _ = _example_losses(spark, d)
    ce = cur.groupBy("batch_id").agg(F.avg("loss").alias("loss"))
    t = L.retain_total(kl, ce, accum=2)
    return t.select("batch_id", r6("kl").alias("kl"), r6("ce_loss").alias("ce_loss"),
                    r6("retain_loss").alias("retain_loss"))
