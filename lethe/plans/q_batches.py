"""Token and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.functions.text import py_split
from lethe.operators import batching as B
from lethe.operators.losses import answer_loss_expr
from lethe.operators.splits import shuffled_batches
from lethe.plans import sqlbits as sb
from lethe.plans.oracle_views import with_views
from lethe.plans.registry import r6, register
from lethe.plans.views import spread, table, v_docs, v_profile

_join = lambda c: F.array_join(F.col(c), " ")

_TOK_SQL = with_views("v_docs") + f""",
words AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
          FROM (SELECT doc_id, {sb.py_split('text')} AS w FROM v_docs) t),
vocab AS (SELECT token, count(*) AS count,
                 CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS BIGINT) AS token_id
          FROM words GROUP BY token),
found AS (SELECT w.doc_id, list(v.token_id ORDER BY w.pos) AS input_ids
          FROM words w JOIN vocab v ON v.token = w.token GROUP BY w.doc_id),
ids AS (SELECT d.example_id, d.text, coalesce(f.input_ids, []) AS input_ids
        FROM v_docs d LEFT JOIN found f ON f.doc_id = d.doc_id)"""


def _ids(spark, d, max_length=None):
    docs = v_docs(spark, d)
    tied = docs.withColumn("text_hash", F.md5("text"))
    return B.token_ids(tied, B.vocabulary(docs), ["example_id", "text_hash"], max_length=max_length)


@register("vocabulary", _TOK_SQL + """
SELECT token, count, token_id FROM vocab""")
def q_vocabulary(spark, d):
    """Word vocabulary of whole documents, ids by frequency."""
    return B.vocabulary(v_docs(spark, d))


@register("token_ids", _TOK_SQL + """
SELECT example_id, CAST(len(input_ids) AS INTEGER) AS n_tokens, array_to_string(input_ids, ' ') AS ids FROM ids""")
def q_token_ids(spark, d):
    """The token ids of every whole document, also of those without words."""
    return _ids(spark, d).select("example_id", F.size("input_ids").alias("n_tokens"), _join("input_ids").alias("ids"))


_BATCH_SQL = _TOK_SQL + """,
b AS (SELECT example_id, input_ids[1:384] AS input_ids, CAST(least(384, len(input_ids)) AS INTEGER) AS n_tokens,
             CAST(row_number() OVER (ORDER BY md5('42:0' || coalesce(':' || example_id, '')), example_id NULLS FIRST,
                                              md5(text)) - 1 AS BIGINT) AS pos
      FROM ids),
bb AS (SELECT *, CAST(floor(pos / 4) AS BIGINT) AS batch_id FROM b),
m AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS batch_len FROM bb),
p AS (SELECT *, list_resize(input_ids, batch_len, 0) AS padded,
             list_resize(list_transform(input_ids, lambda x: 1), batch_len, 0) AS mask FROM m)"""


def _batches(spark, d):
    ids = _ids(spark, d, B.MAX_LENGTH)  # X14's cut, before the words are looked up
    # Documents that share an id, or have none, follow one another by their texts.
    rows = shuffled_batches(ids.withColumn("_size", F.size("input_ids")), ["example_id"], batch_size=4, epochs=[0],
                            tie_cols=["text_hash"], size_col="_size")
    return B.padded_batches(rows)


@register("padded_batches", _BATCH_SQL + """
SELECT example_id, 0 AS epoch, batch_id, pos, n_tokens, batch_len,
       array_to_string(padded, ' ') AS input_ids, array_to_string(mask, ' ') AS attention_mask,
       array_to_string(list_transform(padded, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels
FROM p""")
def q_padded_batches(spark, d):
    """E5 + X14 + X15 + X16: shuffled batches of 4, padded to the batch
    maximum, attention mask and labels."""
    b = _batches(spark, d)
    return b.select("example_id", "epoch", "batch_id", "pos", "n_tokens", "batch_len",
                    _join("input_ids").alias("input_ids"), _join("attention_mask").alias("attention_mask"),
                    _join("labels").alias("labels"))


@register("preview", _BATCH_SQL + """
SELECT example_id, pos, n_tokens FROM p WHERE batch_id = 0 ORDER BY pos LIMIT 3""")
def q_preview(spark, d):
    """The first three rows of the first batch."""
    return B.preview(_batches(spark, d), epoch=0).select("example_id", "pos", "n_tokens")


@register("answer_loss", _BATCH_SQL + """,
lab AS (SELECT batch_id, example_id, padded,
               list_transform(range(1, batch_len + 1), lambda k: CASE WHEN k - 1 < n_tokens // 3 OR padded[k] = 0
                                                           THEN -100 ELSE padded[k] END) AS labels
        FROM p),
al AS (SELECT batch_id,
              list_sum(list_transform(range(2, len(padded) + 1),
                       lambda k: CASE WHEN labels[k] <> -100 THEN ln(1 + padded[k]) / 10 ELSE 0 END)) AS num,
              len(list_filter(labels[2:], lambda y: y <> -100)) AS den
       FROM lab)
SELECT batch_id, round(avg(CASE WHEN den > 0 THEN num / den ELSE 0 END), 6) AS answer_loss_gd,
       round(avg(-(CASE WHEN den > 0 THEN num / den ELSE 0 END)), 6) + 0.0 AS answer_loss_ga, count(*) AS n
FROM al GROUP BY batch_id""")
def q_answer_loss(spark, d):
    """Answer-part loss per batch; the first third of every sequence
    is the prompt (labels -100), the per-position loss is ln(1+next id)/10."""
    b = _batches(spark, d)
    lab = F.transform("labels", lambda y, i: F.when(i < F.floor(F.col("n_tokens") / 3), F.lit(-100)).otherwise(y))
    nxt = F.when(F.size("input_ids") > 1, F.sequence(F.lit(1), F.size("input_ids") - 1)) \
        .otherwise(F.array().cast("array<int>"))
    pos_loss = F.transform(nxt,
                           lambda k: F.log1p(F.get(F.col("input_ids"), k).cast("double")) / 10)
    t = b.select("batch_id", lab.alias("labels"), pos_loss.alias("position_loss"))
    # Both operations in one pass over the batch table.
    t = (t.withColumn("gd", answer_loss_expr(F.col("labels"), F.col("position_loss"), "gd"))
         .withColumn("ga", answer_loss_expr(F.col("labels"), F.col("position_loss"), "ga")))
    out = t.groupBy("batch_id").agg(F.avg("gd").alias("answer_loss_gd"), F.avg("ga").alias("answer_loss_ga"),
                                    F.count(F.lit(1)).alias("n"))
    return out.select("batch_id", r6("answer_loss_gd").alias("answer_loss_gd"),
                      r6("answer_loss_ga").alias("answer_loss_ga"), "n")


def _dialogs(spark, d):
    """Llama-style id sequences from conversations: per turn a header
    (start, role, end), word ids (1000 + word length, every word) and
    the end-of-turn id; conv_id % 3 = 0 leaves the last turn open,
    conv_id % 5 = 0 ends with an assistant header (generation prompt)."""
    c = spread(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))
    role = (F.when(F.col("role") == "system", B.SYSTEM_ROLE_ID).when(F.col("role") == "user", B.USER_ROLE_ID)
            .otherwise(B.ASSISTANT_ROLE_ID))
    words = F.transform(py_split("text"), lambda w: F.length(w) + 1000)
    seg = F.concat(F.array(F.lit(B.HEADER_START_ID), role, F.lit(B.HEADER_END_ID)), words,
                   F.array(F.lit(B.END_OF_TURN_ID)))
    seqs = c.groupBy("conv_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x["s"])).alias("ids"))
    ids = F.when(F.col("conv_id") % 3 == 0, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.col("ids"))
    seqs = seqs.withColumn("ids", ids)
    tail = F.array(F.lit(B.HEADER_START_ID), F.lit(B.ASSISTANT_ROLE_ID), F.lit(B.HEADER_END_ID))
    return seqs.withColumn("ids", F.when(F.col("conv_id") % 5 == 0, F.concat("ids", tail)).otherwise(F.col("ids")))


@register("dialog_labels", f"""
WITH segs AS (
  SELECT conv_id, turn,
         [128006, CASE role WHEN 'system' THEN 9125 WHEN 'user' THEN 882 ELSE 78191 END, 128007]
         || list_transform({sb.py_split('text')}, lambda w: 1000 + length(w)) || [128009] AS seg
  FROM conversations),
s1 AS (SELECT conv_id, flatten(list(seg ORDER BY turn)) AS s FROM segs GROUP BY conv_id),
s2 AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN s[1:len(s) - 1] ELSE s END AS s FROM s1),
s3 AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN s || [128006, 78191, 128007] ELSE s END AS s FROM s2),
pos AS (SELECT conv_id, CAST(len(s) AS INTEGER) AS n, unnest(s) AS id, generate_subscripts(s, 1) - 1 AS p FROM s3),
sp AS (SELECT *, coalesce(sum(CASE WHEN id = 128009 THEN 1 ELSE 0 END) OVER
                          (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span,
              (id = 128006 AND lead(id, 1) OVER w IN (9125, 882) AND lead(id, 2) OVER w = 128007) AS hdr
       FROM pos WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
ends AS (SELECT conv_id, span, min(p) FILTER (WHERE id = 128009) AS e FROM sp GROUP BY conv_id, span),
msk AS (SELECT s.conv_id, s.span FROM sp s JOIN ends e ON e.conv_id = s.conv_id AND e.span = s.span
        WHERE e.e IS NOT NULL AND s.hdr AND s.p <= e.e - 3 GROUP BY s.conv_id, s.span),
l1 AS (SELECT sp.conv_id, sp.n, sp.p,
              CASE WHEN m.span IS NOT NULL THEN -100 ELSE sp.id END AS lab
       FROM sp LEFT JOIN msk m ON m.conv_id = sp.conv_id AND m.span = sp.span),
a AS (SELECT *, (lab = 128006 AND lead(lab, 1) OVER w = 78191 AND lead(lab, 2) OVER w = 128007 AND p <= n - 4) AS ah
      FROM l1 WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
l2 AS (SELECT conv_id, n, p,
              CASE WHEN ah OR coalesce(lag(ah, 1) OVER w, false) OR coalesce(lag(ah, 2) OVER w, false)
                        OR lab = 0 OR lab = 128256 THEN -100 ELSE lab END AS lab
       FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY p))
SELECT conv_id, n, string_agg(CAST(lab AS VARCHAR), ' ' ORDER BY p) AS labels FROM l2 GROUP BY conv_id, n""")
def q_dialog_labels(spark, d):
    """Prompt-span and assistant-header masking of llama dialogs
    (row-local higher-order functions; the oracle uses windows)."""
    s = _dialogs(spark, d)
    return s.select("conv_id", F.size("ids").alias("n"), _join_col(B.mask_prompt_spans(F.col("ids"))).alias("labels"))


def _join_col(c):
    return F.array_join(c, " ")


@register("json_to_token", with_views("v_profile_el") + """,
el AS (SELECT ID, Directory, pos,
              coalesce('<s_Question>' || Question || '</s_Question>', '') || coalesce('<s_ID>' || eID || '</s_ID>', '')
              || coalesce('<s_Answer>' || Answer || '</s_Answer>', '')
              || coalesce('<s_Additional_question>' || Additional_question || '</s_Additional_question>', '')
              || coalesce('<s_Additional_answer>' || Additional_answer || '</s_Additional_answer>', '')
              || coalesce('<s_Additional_ID>' || Additional_ID || '</s_Additional_ID>', '') AS t
       FROM v_profile_el)
SELECT ID, '<s_metadata>' || string_agg(t, '<sep/>' ORDER BY pos) || '</s_metadata>' || '<s_ID>' || ID || '</s_ID>'
           || '<s_Directory>' || Directory || '</s_Directory>' AS token_text
FROM el GROUP BY ID, Directory""")
def q_json_to_token(spark, d):
    """Each training profile as one token string (keys descending)."""
    p = v_profile(spark, d).select("ID", "Directory", "metadata")
    dtype = p.schema
    return p.select("ID", B.json_to_token(F.struct(*[F.col(f.name) for f in dtype.fields]), dtype)
                    .alias("token_text"))
