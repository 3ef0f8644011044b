"""Prompt and eval-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.functions import prompts as P
from lethe.operators import eval_sets as ES
from lethe.operators.splits import forget_retain_split
from lethe.plans import sqlbits as sb
from lethe.plans.oracle_views import PAD, with_views
from lethe.plans.registry import register
from lethe.plans.views import pad_id, table, v_customer_ids, v_gen, v_ids, v_images, v_mcq, v_qa

LLAVA_ID = "llava-hf/llava-1.5-7b-hf"
LLAMA_ID = "meta-llama/Llama-3.2-11B-Vision-Instruct"
IDEFICS_ID = "HuggingFaceM4/idefics2-8b"


def _nest_by_idx(df, kind_filter, el):
    """Per id: elements in ``question_idx`` order (a person's own rows)."""
    return F.transform(
        F.array_sort(F.collect_list(F.when(kind_filter, F.struct("question_idx", el.alias("e")))),
                     lambda a, b: a["question_idx"] - b["question_idx"]),
        lambda s: s["e"])


@register("flatten_mcq", with_views("v_mcq") + f"""
SELECT id, kind, question_idx, Question, Correct_Answer, {sb.options_text('Options')} AS options_text
FROM v_mcq""")
def q_flatten_mcq(spark, d):
    """P5: nest V_MCQ into question documents (an empty array stays
    missing), flatten back."""
    m = v_mcq(spark, d)
    el = F.struct("Question", "Options", "Correct_Answer")
    docs = m.groupBy(F.col("id").alias("ID")).agg(
        _nest_by_idx(m, F.col("kind") == ES.IMAGE_TEXTUAL, el).alias("Image_Textual_Questions"),
        _nest_by_idx(m, F.col("kind") == ES.PURE_TEXT, el).alias("Pure_Text_Questions"))
    docs = docs.select("ID", *[F.when(F.size(c) > 0, F.col(c)).alias(c)
                               for c in ("Image_Textual_Questions", "Pure_Text_Questions")])
    flat = ES.flatten_mcq(docs)
    return flat.select("id", "kind", "question_idx", "Question", "Correct_Answer",
                       P.options_text("Options").alias("options_text"))


@register("flatten_generation", with_views("v_gen") + """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn) AS INTEGER) AS question_idx,
       Type, Question, Ground_Truth
FROM v_gen""")
def q_flatten_generation(spark, d):
    """Nest V_GEN per person, flatten back."""
    g = v_gen(spark, d)
    docs = g.groupBy(F.col("id").alias("ID")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("Type", "Question", "Ground_Truth")
                                                         .alias("e")))), lambda s: s["e"])
        .alias("Generation_Questions"))
    return ES.flatten_generation(docs)


def _files(spark, d):
    p = table(spark, d, "pages").select("page_id")
    suffix = (F.when(F.col("page_id") % 3 == 0, "_questions.json")
              .when(F.col("page_id") % 3 == 1, "_generation_questions.json").otherwise(".json"))
    return p.select(F.concat(pad_id(F.col("page_id")), suffix).alias("file_name"))


@register("select_by_prefix", with_views("v_customer_ids") + ", "
          + sb.split_cte("split", "v_customer_ids", [10]) + f""",
files AS (SELECT {PAD.format(c='page_id')} || CASE page_id % 3 WHEN 0 THEN '_questions.json'
                   WHEN 1 THEN '_generation_questions.json' ELSE '.json' END AS file_name FROM pages)
SELECT file_name FROM files f
WHERE regexp_full_match(file_name, '.*_questions\\.json')
  AND EXISTS (SELECT 1 FROM split s WHERE s."set" = 'forget' AND starts_with(f.file_name, s.id))""")
def q_select_by_prefix(spark, d):
    """Question files of the forget ids (prefix test, pattern
    ``*_questions.json``, which also matches generation files)."""
    ids = forget_retain_split(v_customer_ids(spark, d), ratios=[10]).where(F.col("set") == "forget")
    return ES.select_by_id_prefix(_files(spark, d), ids, pattern="*_questions.json").select("file_name")


def _mcq_prompts(spark, d, model_id, sets):
    """All requested eval sets in one pass: the split's set names the eval
    sets of a person (forget ids -> forget, test; retain ids ->
    retain_shared; everyone -> retain_celebrity), joined once to the
    questions."""
    m = v_mcq(spark, d).select("id", "kind", "question_idx", "Question", "Options", "Correct_Answer")
    split = forget_retain_split(v_ids(spark, d), ratios=[10])
    chosen = ES.sample_exemplar_ids(split.where(F.col("set") == "retain").select("id"), model_id)
    labels = (F.when(F.col("set") == "forget",
                     F.array(F.lit("forget"), F.lit("test"), F.lit("retain_celebrity")))
              .otherwise(F.array(F.lit("retain_shared"), F.lit("retain_celebrity"))))
    wanted = F.filter(labels, lambda x: x.isin(list(sets)))
    out = ES.classification_prompts_by_set(m, split.select("id", F.explode(wanted).alias("eval_set")), model_id,
                                           chosen, m)
    return out.select("eval_set", "id", "kind", "question_idx", "prompt")


_MCQ_SETS_SQL = with_views("v_ids", "v_mcq") + ", " + sb.split_cte("split", "v_ids", [10]) + """,
chosen AS (SELECT id, md5('42:fewshot:' || id) AS h FROM split WHERE "set" = 'retain'
           ORDER BY h, id LIMIT {k}),
sets AS (
  SELECT 'forget' AS eval_set, m.* FROM v_mcq m WHERE id IN (SELECT id FROM split WHERE "set" = 'forget')
  UNION ALL
  SELECT 'test', m.* FROM v_mcq m WHERE id IN (SELECT id FROM split WHERE "set" = 'forget')
  UNION ALL
  SELECT 'retain_shared', m.* FROM v_mcq m
  WHERE id IN (SELECT id FROM split WHERE "set" = 'retain') AND id NOT IN (SELECT id FROM chosen)
  UNION ALL
  SELECT 'retain_celebrity', m.* FROM v_mcq m)"""

# The prompt pieces of the oracles, written out apart from those
# of the operators.
_LLAVA_TAIL = sb.lit("\nAnswer with the option's letter from the given choices directly.\nASSISTANT:")
_IDEFICS_TAIL = sb.lit("\nJust give ONE letter representing the answer directly.\nASSISTANT:")
_LLAMA_IMAGE_HEAD = sb.lit(
    "<|image|><|begin_of_text|> ###Instruction: You are a helpful assistant that will answer all following multiple "
    "choice questions in letter from A, B, C, D \n###Question: ")
_LLAMA_TEXT_TAIL = sb.lit("\nPlease only generate ONE letter representing the answer!\n### Answer:")
_GEN_IMAGE_TAIL = sb.lit(
    "\nAnswer the question based on your trained knowledge in one sentence accurately in ENGLISH!!.\nASSISTANT: ")
_GEN_TEXT_TAIL = sb.lit(
    "\nAnswer the question based on your trained knowledge in one sentence in ENGLISH!!\nASSISTANT:")


@register("mcq_prompts_llava", _MCQ_SETS_SQL.format(k=2) + f""",
ex AS (SELECT m.kind, string_agg({sb.few_shot_item('m.Question', 'm.Options', 'm.Correct_Answer', 'm.kind')},
                                 '' ORDER BY c.h, c.id) AS few_shot
       FROM v_mcq m JOIN chosen c ON c.id = m.id WHERE m.question_idx = 1 GROUP BY m.kind)
SELECT s.eval_set, s.id, s.kind, s.question_idx,
       CASE WHEN s.eval_set IN ('forget', 'retain_shared', 'test') THEN coalesce(e.few_shot, '') ELSE '' END
       || CASE WHEN s.kind = 'Image_Textual' THEN {sb.lit('USER: <image>' + chr(10))} ELSE {sb.lit('USER:' + chr(10))} END
       || {sb.mcq_prompt('s.Question', 's.Options')} || {_LLAVA_TAIL} AS prompt
FROM sets s LEFT JOIN ex e ON e.kind = s.kind""")
def q_mcq_prompts_llava(spark, d):
    """J7 + J8 + J9 + X1 + X2 + X5 + E6 + E9: classification prompts of
    the four eval sets for llava (two exemplars from the retain ids)."""
    return _mcq_prompts(spark, d, LLAVA_ID, ("forget", "test", "retain_shared", "retain_celebrity"))


@register("mcq_prompts_idefics", _MCQ_SETS_SQL.format(k=1) + f""",
ex AS (SELECT m.kind, string_agg({sb.few_shot_item('m.Question', 'm.Options', 'm.Correct_Answer', 'm.kind')},
                                 '' ORDER BY c.h, c.id) AS few_shot
       FROM v_mcq m JOIN chosen c ON c.id = m.id WHERE m.question_idx = 1 GROUP BY m.kind)
SELECT s.eval_set, s.id, s.kind, s.question_idx,
       CASE WHEN s.eval_set IN ('forget', 'retain_shared', 'test') THEN coalesce(e.few_shot, '') ELSE '' END
       || CASE WHEN s.kind = 'Image_Textual' THEN {sb.lit('USER: <image>' + chr(10))} ELSE {sb.lit('USER:' + chr(10))} END
       || {sb.mcq_prompt('s.Question', 's.Options')}
       || {_IDEFICS_TAIL} AS prompt
FROM sets s LEFT JOIN ex e ON e.kind = s.kind WHERE s.eval_set IN ('forget', 'retain_shared')""")
def q_mcq_prompts_idefics(spark, d):
    """As above for idefics (one exemplar), forget and retain_shared."""
    return _mcq_prompts(spark, d, IDEFICS_ID, ("forget", "retain_shared"))


@register("mcq_prompts_llama", _MCQ_SETS_SQL.format(k=1) + f"""
SELECT s.eval_set, s.id, s.kind, s.question_idx,
       CASE WHEN s.kind = 'Image_Textual'
            THEN {_LLAMA_IMAGE_HEAD} || {sb.mcq_prompt('s.Question', 's.Options', True)}
                 || {sb.lit(chr(10) + '###Answer:')}
            ELSE '<|begin_of_text|>### Question: ' || {sb.mcq_prompt('s.Question', 's.Options', True)}
                 || {_LLAMA_TEXT_TAIL} END AS prompt
FROM sets s WHERE s.eval_set IN ('forget', 'retain_shared')""")
def q_mcq_prompts_llama(spark, d):
    """llama: the choices form of X1 and no exemplar block (Q18); the
    retain set still excludes the sampled exemplar persons."""
    return _mcq_prompts(spark, d, LLAMA_ID, ("forget", "retain_shared"))


@register("few_shot_items", with_views("v_mcq") + f"""
SELECT id, kind, question_idx, {sb.few_shot_item('Question', 'Options', 'Correct_Answer', 'kind')} AS llava,
       {sb.few_shot_item('Question', 'Options', 'Correct_Answer', 'kind', True)} AS llama
FROM v_mcq""")
def q_few_shot_items(spark, d):
    """Every question as an exemplar, in the llava and the llama form."""
    item = lambda model_id: F.when(
        F.col("kind") == ES.IMAGE_TEXTUAL, P.few_shot_item("Question", "Options", "Correct_Answer", model_id, True)) \
        .otherwise(P.few_shot_item("Question", "Options", "Correct_Answer", model_id, False))
    return v_mcq(spark, d).select("id", "kind", "question_idx", item(LLAVA_ID).alias("llava"), item(LLAMA_ID).alias("llama"))


@register("extract_json_prompts", with_views("v_images") + f"""
SELECT path, {sb.lit('USER: <image>' + chr(10) + 'Extract JSON.' + chr(10) + 'ASSISTANT:')} AS prompt FROM v_images""")
def q_extract_json_prompts(spark, d):
    """The structured-answer prompt of every image."""
    return v_images(spark, d).select("path", P.extract_json_prompt().alias("prompt"))


def _gen_sql(llama: bool) -> str:
    if llama:
        img = f"{sb.lit('<|image|><|begin_of_text|>### Question:')} || {sb.show('Question')} || {sb.lit(chr(10) + '### Answer:')}"
        txt = f"{sb.lit('<|begin_of_text|>### Question: ')} || {sb.show('Question')} || {sb.lit(chr(10) + '### Answer:')}"
    else:
        img = f"{sb.lit('USER: <image>' + chr(10))} || {sb.show('Question')} || {_GEN_IMAGE_TAIL}"
        txt = f"'USER: ' || {sb.show('Question')} || {_GEN_TEXT_TAIL}"
    return with_views("v_gen") + f"""
SELECT id, turn, Type, CASE WHEN Type = 'Image_Textual' THEN {img} ELSE {txt} END AS prompt FROM v_gen"""


@register("gen_prompts_llava", _gen_sql(False))
def q_gen_prompts_llava(spark, d):
    """X5, generation, llava/idefics form."""
    return ES.generation_prompts(v_gen(spark, d), LLAVA_ID).select("id", "turn", "Type", "prompt")


@register("gen_prompts_llama", _gen_sql(True))
def q_gen_prompts_llama(spark, d):
    """X5, generation, llama form."""
    return ES.generation_prompts(v_gen(spark, d), LLAMA_ID).select("id", "turn", "Type", "prompt")


@register("train_prompts", with_views("v_qa") + f"""
SELECT id, turn,
       {sb.lit('USER: <image>' + chr(10))} || question || {sb.lit(chr(10) + 'ASSISTANT: ')} || answer AS llava,
       'USER: <image>' || question || {sb.lit(chr(10) + 'ASSISTANT: ')} || answer AS legacy,
       '<|image|><|begin_of_text|>### Question:' || question || '### Answer:' || answer || '<|end_of_text|>' AS llama,
       {sb.lit('USER: <image>' + chr(10))} || question || {sb.lit(chr(10) + 'ASSISTANT:')} AS eval_llava
FROM v_qa""")
def q_train_prompts(spark, d):
    """X3 (three training forms) and the llava evaluation form of X5."""
    qa = v_qa(spark, d)
    return qa.select("id", "turn", P.train_prompt("question", "answer", "llava").alias("llava"),
                     P.train_prompt("question", "answer", "legacy").alias("legacy"),
                     P.train_prompt("question", "answer", "llama").alias("llama"),
                     P.eval_question_prompt("question").alias("eval_llava"))


@register("chat_messages", with_views("v_qa") + """
SELECT id, turn, 0 AS msg, 'user' AS role, 0 AS item, 'image' AS type, CAST(NULL AS VARCHAR) AS text FROM v_qa
UNION ALL SELECT id, turn, 0, 'user', 1, 'text', question FROM v_qa
UNION ALL SELECT id, turn, 1, 'assistant', 0, 'text', answer FROM v_qa""")
def q_chat_messages(spark, d):
    """The nested user/assistant messages, checked after an inline."""
    m = v_qa(spark, d).select("id", "turn", P.chat_messages("question", "answer").alias("m"))
    msgs = m.select("id", "turn", F.posexplode("m").alias("msg", "x"))
    items = msgs.select("id", "turn", "msg", F.col("x.role").alias("role"),
                        F.posexplode("x.content").alias("item", "c"))
    return items.select("id", "turn", "msg", "role", "item", F.col("c.type").alias("type"),
                        F.col("c.text").alias("text"))
